"""Near-duplicate documents by a signature-coordinate inverted join.

* A document is the set of its distinct k-word shingles.  Documents with equal sets, by the sums of
  two independent hashes of their shingles, form a class, represented by the least id; only
  representatives go on.
* A signature has ``COORDS`` min-hash coordinates.  Each (coordinate, value) pair is a token, and
  documents are posted under their tokens.  Two documents are candidates when at least
  ``MATCHES`` tokens collide.  At similarity 0.8 a pair misses that with a chance of 4e-5, at 0.82 of 6e-6.
* Skipping: a token that only one document holds can't collide, so documents with fewer than
  ``MATCHES`` other tokens drop out.  Prefix: of the tokens in order of (frequency, token), two
  candidates share one of the first COORDS - MATCHES + 1, so only those are posted.
* Short posting lists give all their pairs; lists with equal members are merged first.  Lists
  longer than ``SHORT`` are cut into blocks; each pair of blocks is compared as matrices and gives
  a spanning forest of its best-matching pairs, so a group of copies never gives all its pairs.
* Candidates are confirmed on the full sets of their words; hashes only sift before.  Where a long list still holds several components after
  that, all its matching pairs across components are confirmed in the same tasks, each pair under
  one of its common tokens only, so no link is lost and only links that join are returned.

Defined cases: null, empty or blank text has an empty set and links with nothing; fewer words than
k make one shingle; repeated rows of one id share its result; a null id links with nothing and is
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.operators.components import connected_components
from sightline.plans.store import bounded, materialize, settled

COORDS, MATCHES, SHORT, BLOCK, BROADCAST_IDS, KEPT_SETS = 64, 38, 32, 1024, 1_000_000, 64
_FACTORS = K.mix(np.arange(1, 2 * COORDS + 1, dtype=K.U64) * K.U64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, concatenated, a second independent hash of each, and their bounds."""
    told = [K.word_hashes(data, offsets, seed) for seed in (0, 1)]
    bounds = told[0][1]
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    count = max(0, len(doc) - k + 1)
    whole = np.flatnonzero(doc[:count] == doc[k - 1 :]) if count else np.zeros(0, dtype=np.int64)
    few = np.flatnonzero((n > 0) & (n < k))
    owner = np.concatenate([doc[whole], few])
    values, second = (np.concatenate([K.gram_hashes(words, k)[whole], *(K.gram_hashes(words[bounds[i] : bounds[i + 1]], int(n[i])) for i in few)]) for words, _ in told)
    order = np.lexsort((values, owner))
    values, second, owner = values[order], second[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], second[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def word_sets(raw: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; fewer words than k make one."""
    words = raw.split()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} - {()}


def linked(a, b, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two Python sets."""
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def signatures(values: np.ndarray, bounds: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """A row of (coordinate << 32 | value) tokens for each set that isn't empty."""
    full = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(full), coords), dtype=np.int64)
    if len(full):
        for c in range(coords):
            least = np.minimum.reduceat((values * (_FACTORS[c] | K.U64(1)) + _FACTORS[coords + c]) >> K.U64(32), full)
            out[:, c] = least.astype(np.int64) | c << 32
    return out


def _sketch(k: int):
    schema = K.columns("doc_id long, n_shingles long, s1 long, s2 long, tokens longs")

    def run(batches):
        for batch in batches:
            for at, n, data, offsets in K.slices(batch["text"], lower=True):
                values, second, bounds = shingle_sets(data, offsets, k)
                full = np.diff(bounds) > 0
                sums = np.zeros((2, n), dtype=K.U64)
                if full.any():
                    sums[0, full] = np.add.reduceat(K.mix(values), bounds[:-1][full])
                    sums[1, full] = np.add.reduceat(K.mix(second ^ _FACTORS[0]), bounds[:-1][full])
                tokens = K.long_lists(signatures(values, bounds).reshape(-1), np.concatenate([[0], np.cumsum(full * COORDS)]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array(np.diff(bounds)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), tokens], schema=schema)

    return run, "doc_id long, n_shingles long, s1 long, s2 long, tokens array<long>"


def _squeeze(batches):
    squeeze, schema = zstandard.ZstdCompressor(level=3).compress, K.columns("doc_id long, blob binary")
    for batch in batches:
        for at, n, data, offsets in K.slices(batch["text"], lower=True):
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array([squeeze(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], schema=schema)


def _confirm(k: int, percent: int):
    """Rows (a, b, blob_a, blob_b) to the pairs with 100 * intersection >= percent * union."""
    schema = K.columns("src long, dst long")

    def sets(blobs):
        open_ = zstandard.ZstdDecompressor().decompress
        texts = [open_(x) for x in blobs]
        values, _, bounds = shingle_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]), k)
        return texts, values, bounds

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                (ta, va, ba), (tb, vb, bb) = (sets(part[c].to_pylist()) for c in ("blob_a", "blob_b"))
                good = []
                for i in range(part.num_rows):
                    a, b = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
                    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                        good.append(False)
                        continue
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    likely = 100 * both >= percent * (len(a) + len(b) - both)  # by hashes; the words decide
                    good.append(likely and linked(word_sets(ta[i], k), word_sets(tb[i], k), percent))
                yield pa.RecordBatch.from_arrays([part[c].filter(pa.array(good)) for c in ("a", "b")], schema=schema)

    return run, "src long, dst long"


def _matrix(lists: pa.Array) -> np.ndarray:
    """One row a document, one column a coordinate; a coordinate that isn't posted equals none."""
    values = lists.flatten().to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = -1 - np.arange(len(sizes), dtype=np.int64)[:, None] * np.ones(COORDS, dtype=np.int64)
    out[owner, values >> 32] = values & 0xFFFFFFFF
    return out


def _forest(ids, m, side, floor):
    """Spanning forest of the documents by their highest matches; only pairs between two sides if there are two."""
    n, cross = len(ids), side.min() != side.max()
    best, link, todo = np.full(n, -1), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    src, dst = [], []
    at = 0
    for _ in range(n):
        todo[at] = False
        match = (m == m[at]).sum(axis=1)
        if cross:
            match[side == side[at]] = -1
        better = todo & (match > best)
        best[better], link[better] = match[better], at
        if not todo.any():
            break
        at = int(np.flatnonzero(todo)[np.argmax(best[todo])])
        if best[at] >= floor:
            src.append(ids[at])
            dst.append(ids[link[at]])
    return src, dst


def _densest(matches: int):
    """One pair of blocks of one posting list to the pairs of its spanning forest."""
    schema = K.columns("a long, b long")

    def run(key, rows):
        ids, side = rows["doc_id"].to_numpy(), rows["side"].to_numpy()
        src, dst = (np.array(x, dtype=np.int64) for x in _forest(ids, _matrix(rows["tokens"].combine_chunks()), side, matches))
        return pa.Table.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], schema=schema)

    return run


def _joining(k: int, percent: int, matches: int):
    """One pair of blocks of one posting list to the links, confirmed on full sets, that join its components."""
    schema = K.columns("src long, dst long")
    places = np.arange(COORDS) * 37

    def run(key, rows):
        open_, sets = zstandard.ZstdDecompressor().decompress, {}
        ids, side, comp = (rows[c].to_numpy() for c in ("doc_id", "side", "comp"))
        m, short, long_ = (_matrix(rows[c].combine_chunks()) for c in ("tokens", "rare", "often"))
        own, blobs = key[0].as_py() >> 32, rows["blob"]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        def full(i: int) -> set:
            if i not in sets:
                while len(sets) >= KEPT_SETS:
                    sets.pop(next(iter(sets)))
                sets[i] = word_sets(open_(blobs[i].as_py()), k)
            return sets[i]

        src, dst = [], []
        for i in range(len(ids) - 1):
            ok = (comp[i + 1 :] != comp[i]) & (side[i + 1 :] != side[i] if key[1] != key[2] else True)
            near = np.flatnonzero(ok) + i + 1
            near = near[(m[near] == m[i]).sum(axis=1) >= matches]
            near = near[~(short[near] == short[i]).any(axis=1)]  # those were candidates before
            turn = (places + ((ids[near] ^ ids[i]) % COORDS)[:, None]) % COORDS
            near = near[np.where(long_[near] == long_[i], turn, COORDS).argmin(axis=1) == own] if len(near) else near
            for j in near.tolist():
                if root(int(comp[i])) != root(int(comp[j])):
                    if linked(full(i), full(j), percent):
                        parent[root(int(comp[i]))] = root(int(comp[j]))
                        src.append(int(ids[i]))
                        dst.append(int(ids[j]))
        return pa.Table.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], schema=schema)

    return run


def _blocks(rows: DataFrame, block: int, *more: str) -> DataFrame:
    """Rows (token, df, doc_id, ...) dealt to pairs of blocks of at most about ``block`` documents."""
    dealt = rows.withColumn("n", F.ceil(F.col("df") / block).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "doc_id", *more)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    return settled(docs.sparkSession, "near", lambda: _near_duplicates(docs, k, percent, short, block))


def _near_duplicates(docs: DataFrame, k: int, percent: int, short: int, block: int) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _sketch(k)
    base = materialize(text.mapInArrow(run, schema), "sketch")
    real = base.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("tokens", "doc_id").alias("tokens")), "classes")
    posted = classes.select("rep", "n_shingles", F.explode("tokens").alias("token"))
    common = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = posted.join(common, "token").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).filter(F.size("t") >= MATCHES)
    room = F.size("t") - (MATCHES - 1)
    prefix = materialize(lists.select(F.col("rep").alias("doc_id"), F.slice("t", F.lit(1), room).alias("prefix"), F.sort_array(F.transform("t", lambda x: x["token"])).alias("tokens"), F.col("n_shingles").alias("n")), "prefix")
    under = prefix.select("doc_id", "n", F.explode("prefix").alias("p")).filter(F.col("p.df") <= short)
    groups = under.groupBy("p.token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n"))).alias("ds")).filter(F.size("ds") > 1).select("ds").distinct()
    fit = lambda x, y: (y["doc_id"] > x["doc_id"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    ahead = F.flatten(F.transform("ds", lambda x: F.transform(F.filter("ds", lambda y: fit(x, y)), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))))
    pairs = groups.select(F.explode(ahead).alias("p")).select("p.a", "p.b")
    tokens_of = lambda keep: F.transform(F.filter("prefix", keep), lambda x: x["token"])
    parts = prefix.select("doc_id", "tokens", tokens_of(lambda x: x["df"] <= short).alias("rare"), tokens_of(lambda x: x["df"] > short).alias("often"), F.explode("prefix").alias("p"))
    long_lists = materialize(parts.filter(F.col("p.df") > short).select("doc_id", "tokens", "rare", "often", "p.token", "p.df"), "long")
    some = long_lists.limit(1).count() > 0
    if some:
        pairs = pairs.union(_blocks(long_lists, block, "tokens").groupBy("token", "i", "j").applyInArrow(_densest(MATCHES), "a long, b long"))
    wanted = prefix.select("doc_id")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted  # else both sides are shuffled
    blobs = materialize(wanted.join(text.filter("doc_id is not null").mapInArrow(_squeeze, "doc_id long, blob binary"), "doc_id").dropDuplicates(["doc_id"]), "blobs")
    run, schema = _confirm(k, percent)

    a = blobs.select(F.col("doc_id").alias("a"), F.col("blob").alias("blob_a"))
    b = blobs.select(F.col("doc_id").alias("b"), F.col("blob").alias("blob_b"))
    links = materialize(pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "blob_a", "blob_b").mapInArrow(run, schema), "links")
    found = connected_components(links)
    if some:
        now = long_lists.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        mixed = bounded(now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"), "mixed", BROADCAST_IDS)
        dealt = _blocks(now.join(mixed, "token").join(blobs, "doc_id"), block, "tokens", "rare", "often", "comp", "blob")
        more = materialize(dealt.groupBy("token", "i", "j").applyInArrow(_joining(k, percent, MATCHES), "src long, dst long"), "joining")
        if more.limit(1).count():
            found = connected_components(links.union(more))
    labels = classes.select("s1", "s2", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return base.select("doc_id", "n_shingles", "s1", "s2").join(labels, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)
), r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT z.v, r.c FROM r JOIN (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e) z ON z.u = r.v
), c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id
"""


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
