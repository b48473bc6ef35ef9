"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and every run of characters that aren't letters or digits becomes a space.
A test item of m characters may differ by k = int(ERRORS * m) edits.  It is split into k + 1
pieces; a passage within k edits holds one of them unchanged.  One automaton finds all pieces of
all items, and each hit's surroundings are verified by Myers' bit-parallel edit distance.

The items are broadcast in slices of at most ``SLICE_CHARS`` characters; larger benchmarks take
several passes instead of a larger broadcast.

Items shorter than ``MIN_CHARS`` after cleaning are found without edits and at word boundaries
only; letters of scripts written without spaces are words of their own.

Defined cases: null or empty text holds nothing; null items, and items without a letter or digit,
are in no text; an item whose id is null is reported with a null id; equal items are reported each;
of several passages the one with the fewest edits, then the first, is reported; repeated rows are
judged alike; a null id is passed through; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K

#: Replacing a word of up to nine letters by another such, in a test item of 80 characters, is within the edits.
ERRORS, MIN_CHARS, SLICE_CHARS = 0.12, 24, 2_000_000
_gaps = re.compile(r"[\W_]+")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_unspaced = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def clean(text: str | None) -> str:
    return _gaps.sub(" ", text.lower()).strip() if text else ""


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """(place, piece) of the k + 1 pieces, whose lengths differ by one at most."""
    n = int(errors * len(item)) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """Fewest edits of the pattern to any part of the text, and that part's end; None beyond ``most``."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << m - 1
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = ones, 0, m, (most + 1, 0)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best[0]:
            best = (score, j + 1)
        ph, mh = ph << 1 & ones, mh << 1 & ones  # a match may start anywhere
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
    return best if best[0] <= most else None


def between_words(text: str, at: int) -> bool:
    """Whether a word ends or starts at this place of a cleaned text."""
    around = text[max(0, at - 1) : at + 1]
    return len(around) < 2 or " " in around or bool(_unspaced.search(around))


@lru_cache(None)
def ranges(n: int, p: int) -> tuple[tuple[int, int], ...]:
    """The ranges of pieces around piece p, smallest first, that halving n pieces again and again gives; not p alone, not all."""
    out, i, j = [], 0, n
    while j - i > 1:
        out.append((i, j))
        mid = (i + j) // 2
        i, j = (i, mid) if p < mid else (mid, j)
    return tuple(out[:0:-1])


def beside(item: str, edges: list[int], p: int) -> tuple[int, list[tuple[int, str]]]:
    """The budget of the smallest range around piece p, and (place, part) of the range's other pieces, cut once more
    into budget + 1 parts: one of them is near piece p unchanged if the range is within its budget."""
    around = ranges(len(edges) - 1, p)
    if not around:
        return 0, []
    (i, j) = around[0]
    a, b = (edges[p + 1], edges[j]) if p == i else (edges[i], edges[p])
    cut = [a + (b - a) * x // (j - i) for x in range(j - i + 1)]
    return j - i - 1, [(x, item[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


class Matcher:
    """Finds a hit's item by way of growing ranges of pieces.

    A range of r pieces may differ by r - 1 edits.  If it does not differ by more, one of its halves does
    not either, so a passage is reached from one of its unchanged pieces with every range on the way
    within its budget: a chance hit ends at the first range, and no passage is lost.
    """

    def __init__(self, items: list[tuple[int | None, str]], errors: float = ERRORS, min_chars: int = MIN_CHARS):
        import ahocorasick

        self.items, self.errors, self.min_chars = items, errors, min_chars
        places: dict[str, list[tuple[int, int, int, int, list[tuple[int, str]]]]] = {}
        self.edges: list[list[int]] = []
        for n, (_, item) in enumerate(items):
            cut = pieces(item, errors if len(item) >= min_chars else 0.0)
            self.edges.append([at for at, _ in cut] + [len(item)])
            for p, (at, piece) in enumerate(cut):
                places.setdefault(piece, []).append((n, at, p, *beside(item, self.edges[n], p)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def _plausible(self, n: int, p: int, start: int, text: str, seen: dict[tuple[int, int, int, int], bool]) -> bool:
        """Whether every range of pieces around piece p, but for the whole item, is within its budget near its place."""
        item, edges = self.items[n][1], self.edges[n]
        for i, j in ranges(len(edges) - 1, p):
            key, most, a, b = (n, i, j, start), j - i - 1, edges[i], edges[j]
            ok = seen.get(key)
            if ok is None:
                ok = seen[key] = myers(item[a:b], text[max(0, start + a - most) : max(0, start + b + most)], most) is not None
            if not ok:
                return False
        return True

    def __call__(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, edits, about the start, end) of the best passage of every item within its budget."""
        found: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        seen: dict[tuple[int, int, int, int], bool] = {}
        if not self.any:
            return []
        for end, (size, where) in self.automaton.iter(text):
            for n, at, p, near, parts in where:
                start = end + 1 - size - at
                if parts and not any(part in text[max(0, start + x - near) : max(0, start + x + len(part) + near)] for x, part in parts):
                    continue
                item, most = self.items[n][1], len(self.edges[n]) - 2
                if found.get(n, (1,))[0] == 0 or (n, start) in tried:
                    continue
                if len(item) < self.min_chars:
                    if between_words(text, start) and between_words(text, end + 1):
                        found[n] = (0, start, end + 1)
                    continue
                if not self._plausible(n, p, start, text, seen):
                    continue
                tried.add((n, start))
                if text.startswith(item, max(0, start)) and start >= 0:
                    found[n] = (0, start, start + len(item))
                    continue
                low = max(0, start - most)
                told = myers(item, text[low : start + len(item) + most], most)
                if told and (n not in found or told[0] < found[n][0]):
                    found[n] = (told[0], max(low, low + told[1] - len(item)), low + told[1])
        return [(self.items[n][0], *f) for n, f in sorted(found.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, min_chars: int = MIN_CHARS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every document that holds a passage of an item.

    Places are in the cleaned text.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-2 * chars // slice_chars) or 1
    kind = "doc_id long, item_id long, edits int, start int, end int"
    schema = K.columns(kind)

    def passage(n: int) -> DataFrame:
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).collect() if parts > 1 else items.collect()
        cleaned = {(r["item_id"], clean(r["text"])) for r in own}
        shared = spark.sparkContext.broadcast(sorted((x for x in cleaned if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches):
            match = Matcher(shared.value, errors, min_chars)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for hit in match(clean(t))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema.types, strict=True)], schema=schema)

        return text.mapInArrow(run, kind)

    out = passage(0)
    for n in range(1, parts):
        out = out.union(passage(n))
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
