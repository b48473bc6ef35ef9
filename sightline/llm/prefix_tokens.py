"""Token counts by prefix dynamic programming over a byte-fallback BPE vocabulary.

For every prefix of a text the table holds the exact number of tokens of that prefix.  The last
token of a prefix is the one that is stable beside the last token of what stands before it, so a
prefix's count is one more than an earlier prefix's; no prefix is encoded anew.  No piece of the
vocabulary crosses from a word into the space mark of the next one, so the table is kept as
running sums at segment ends plus one short table for each distinct segment.

Counting, truncation and budget questions are answered from the table alone.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; special strings inside a text
are ordinary text; repeated rows give repeated results; a null id is passed through; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K

MARK = "▁"


class PrefixCounter:
    """Exact token counts of all prefixes for one SentencePiece BPE model with an identity normalizer."""

    def __init__(self, model_file: str, remember: int = 300_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece crosses a word boundary")
        own = [chr(10)] if not any("\n" in p and len(p) > 1 for p in self.score) else []
        stop = "".join([MARK, *own])
        self.segments = re.compile("|".join([*own, f"{MARK}*[^{stop}]+", f"{MARK}+"])).findall
        self.stable = {p for p in self.score if self.merge(p) == [p]}
        ends: dict[str, set[int]] = {}
        for p in self.stable:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}  # of pieces by their last two characters
        self.pairs: dict[tuple[str, str], bool] = {}
        self.total: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.remember = remember

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours join first, the left ones on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, left: str, right: str) -> bool:
        """Whether plain BPE leaves two neighbouring tokens as they are."""
        if len(self.pairs) > 4 * self.remember:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def table(self, segment: str) -> list[int]:
        """Token counts of the segment's prefixes of 0, 1, 2, ... characters."""
        counts, last = [0], [""]
        stable, pairs, lengths = self.stable, self.pairs, self.lengths
        for i in range(1, len(segment) + 1):
            for n in lengths.get(segment[i - 2 : i], ()):
                if n <= i:
                    j = i - n
                    piece = segment[j:i]
                    if piece in stable:
                        if j:
                            known = pairs.get((last[j], piece))
                            if not (self.beside(last[j], piece) if known is None else known):
                                continue
                        counts.append(counts[j] + 1)
                        last.append(piece)
                        break
            else:  # one character: a piece, or else its bytes
                piece = segment[i - 1]
                counts.append(counts[i - 1] + (1 if piece in stable else len(piece.encode())))
                last.append(piece)
        return counts

    def tokens(self, segment: str) -> int:
        """The count of a whole segment, remembered for two generations."""
        known = self.older.get(segment)
        if known is None:
            known = self.table(segment)[-1]
        if len(segment) <= 64:
            if len(self.total) >= self.remember:
                self.older, self.total = self.total, {}
            self.total[segment] = known
        return known

    def sums(self, text: str) -> tuple[list[str], list[int]]:
        """The segments of the marked text and the running token counts at their ends."""
        if not text:
            return [], []
        parts = self.segments(MARK + text.replace(" ", MARK))
        counts = list(map(self.total.get, parts))
        if None in counts:
            counts = [self.tokens(p) if c is None else c for p, c in zip(parts, counts, strict=True)]
        return parts, list(accumulate(counts))

    def count(self, text: str, chars: int | None = None) -> int:
        """Tokens of the first ``chars`` characters (all of them if None)."""
        if chars is not None and chars <= 0:
            return 0
        parts, ends = self.sums(text)
        if chars is None or chars >= len(text):
            return ends[-1] if ends else 0
        places = list(accumulate(map(len, parts)))
        at = bisect_right(places, chars + 1)  # one more for the mark in front
        before, rest = (ends[at - 1], chars + 1 - places[at - 1]) if at else (0, chars + 1)
        return before + (self.table(parts[at])[rest])

    def fitting(self, text: str, budget: int, sums: tuple[list[str], list[int]] | None = None) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        parts, ends = sums or self.sums(text)
        at = bisect_right(ends, budget)
        if at == len(parts):
            return len(text)
        chars, left = sum(map(len, parts[:at])), budget - (ends[at - 1] if at else 0)
        table = self.table(parts[at])
        chars += max(i for i, c in enumerate(table) if c <= left)
        return max(0, chars - 1)


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter for each model in a process; its tables are shared by all batches."""
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the longest prefix within the limit."""
    schema = K.columns("doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

    def run(batches):
        table = counter(model_file)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            sizes, tokens, fits = [], [], []
            for t in texts:
                sums = table.sums(t)
                sizes.append(len(t.encode()))
                tokens.append(sums[1][-1] if sums[1] else 0)
                fits.append(table.fitting(t, limit, sums))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())], schema=schema)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
