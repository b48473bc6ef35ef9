"""Substring deduplication over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document.  A word goes when it is covered by a
window whose word sequence also starts in a document with a smaller id.

* Every window has an anchor, the least hash among its ``GRAM``-word grams.  Equal windows have
  equal anchors, so only documents that share an anchor can share a window.  Anchors are a
  twentieth of all windows.
* The index holds three levels of immutable sorted runs: anchors with their least document, digests
  of the words of windows with their least document, and compressed texts.  A window is in the
  index once its anchor is shared; until then its text stands for it.
* A batch becomes a run of each level.  Its anchors are merge-joined with earlier runs.  Where an
  anchor is shared, its holders in the batch, and its only earlier holder if it had just one, are
  opened and their windows under it are digested.  These digests are merge-joined with earlier
  runs: a window of the batch whose least document is smaller goes.  More than ``max_runs`` runs of
  a level are compacted before a batch meets them.
* The digest is 128 bits of BLAKE2 over a window's words themselves, not over hashes of them.

Documents with equal word sequences form a class; only its least document is indexed, the others
are wholly repeated.  Runs hold a key once, so a very common passage is one row of a run, and a
batch's rows are combined before any shuffle by their key.

Defined cases: null or blank text has 0 words; a null id is never removed nor seen by others;
documents of fewer words than a window lose nothing; repeated rows of one id do not remove each
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.llm.runs import RunStore, merging
from sightline.plans.store import materialize, settled

#: A table is indexed in BATCHES ranges of ids; a batch meets MAX_RUNS runs of a level at most.
WINDOW, GRAM, BATCHES, MAX_RUNS = 50, 10, 3, 1


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w and len(a) > have:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    if have < w:
        a = np.minimum(a[: have - w], a[w - have :]) if len(a) > w - have else a[:0]
    return a


def _windows(words: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, documents and anchors of all windows that stay inside one document."""
    n = len(words) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(K.U64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    anchors = sliding_min(K.gram_hashes(words, gram), window - gram + 1)
    return starts, doc[starts], anchors[starts]


def _scan(window: int, gram: int):
    kind = "doc_id long, seq string, n_words long, anchors array<long>, blob binary"
    schema = K.columns("doc_id long, seq string, n_words long, anchors longs, blob binary")

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at, n, data, offsets in K.slices(batch["text"]):
                words, bounds = K.word_hashes(data, offsets)
                _, doc, anchors = _windows(words, bounds, window, gram)
                order = np.lexsort((anchors, doc))
                doc, anchors = doc[order], anchors[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchors[1:] != anchors[:-1])
                doc, anchors = doc[new], anchors[new]
                raw, counts = data.tobytes(), np.diff(bounds)
                joined = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                seqs = [hashlib.sha256(x).hexdigest() for x in joined]
                blobs = [squeeze(x) if c >= window else None for x, c in zip(joined, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), pa.array(seqs), pa.array(counts), K.long_lists(anchors, np.searchsorted(doc, np.arange(n + 1))), pa.array(blobs, pa.binary())], schema=schema)

    return run, kind


def _opened(batch: pa.RecordBatch, window: int, gram: int, size: int = 256):
    """Documents of a batch by slices: (first row, texts, word bounds, windows under the row's anchors by document).

    A slice's windows come as (start words, documents, digests as rows of two 64-bit numbers).
    """
    open_ = zstandard.ZstdDecompressor().decompress
    lists = batch["anchors"]
    values, ends = lists.flatten().to_numpy().view(K.U64), np.cumsum([0, *np.diff(lists.offsets.to_numpy())])
    at = 0
    while at < batch.num_rows:
        texts, total = [], 0
        while at + len(texts) < batch.num_rows and len(texts) < size and total < K.SLICE:
            texts.append(open_(batch["blob"][at + len(texts)].as_py()))
            total += len(texts[-1])
        offsets = np.cumsum([0, *map(len, texts)])
        raw = b"".join(texts)
        data = np.frombuffer(raw, dtype=np.uint8)
        words, bounds = K.word_hashes(data, offsets)
        first, last, _ = K.word_spans(data, offsets)
        starts, doc, anchors = _windows(words, bounds, window, gram)
        cut, shared = np.searchsorted(doc, np.arange(len(texts) + 1)), np.zeros(len(starts), dtype=bool)
        for i in range(len(texts)):
            shared[cut[i] : cut[i + 1]] = np.isin(anchors[cut[i] : cut[i + 1]], values[ends[at + i] : ends[at + i + 1]])
        starts, doc = starts[shared], doc[shared]
        told = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first[starts].tolist(), last[starts + window - 1].tolist(), strict=True)]
        yield at, texts, bounds, starts, doc, np.frombuffer(b"".join(told), dtype="<i8").reshape(-1, 2)
        at += len(texts)


def _digests(window: int, gram: int):
    """Each window once a document."""
    schema = K.columns("h1 long, h2 long, doc_id long")

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for at, _, _, _, doc, told in _opened(batch, window, gram):
                order = np.lexsort((told[:, 1], told[:, 0], doc))
                doc, told = doc[order], told[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (told[1:] != told[:-1]).any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(told[new, 0]), pa.array(told[new, 1]), pa.array(ids[at + doc[new]])], schema=schema)

    return run, "h1 long, h2 long, doc_id long"


def _removed(window: int, gram: int):
    schema = K.columns("doc_id long, seq string, n_removed long, kept_text string, kept_sha256 string")

    def run(batches):
        for batch in batches:
            hits = batch["hits"]
            pairs, ends = hits.flatten(), np.cumsum([0, *np.diff(hits.offsets.to_numpy())])
            h1, h2 = pairs.field("h1").to_numpy(), pairs.field("h2").to_numpy()
            for at, texts, bounds, starts, doc, told in _opened(batch, window, gram):
                n, cut = len(texts), np.searchsorted(doc, np.arange(len(texts) + 1))
                gone, kept = [], []
                for i in range(n):
                    own = set(zip(h1[ends[at + i] : ends[at + i + 1]].tolist(), h2[ends[at + i] : ends[at + i + 1]].tolist(), strict=True))
                    here = slice(cut[i], cut[i + 1])
                    hit = starts[here][np.fromiter((tuple(t) in own for t in told[here].tolist()), dtype=bool, count=cut[i + 1] - cut[i])] - bounds[i]
                    change = np.zeros(bounds[i + 1] - bounds[i] + 1, dtype=np.int64)
                    change[hit] += 1
                    change[hit + window] -= 1
                    cover = np.cumsum(change)[:-1] > 0
                    gone.append(int(cover.sum()))
                    kept.append(b" ".join(w for w, c in zip(texts[i].split(), cover, strict=True) if not c))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), batch["seq"].slice(at, n), pa.array(gone), pa.array([x.decode() for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], schema=schema)

    return run, "doc_id long, seq string, n_removed long, kept_text string, kept_sha256 string"


#: Columns, keys, and how columns of two runs are merged; ``holders`` is 1 or 2 for more.
LEVELS = {
    "anchors": ("anchor bigint, least bigint, holders int", ["anchor"], {"least": "least({a}, {b})", "holders": "least(2, coalesce({a}, 0) + coalesce({b}, 0))"}),
    "windows": ("h1 bigint, h2 bigint, least bigint, last bigint", ["h1", "h2"], {"least": "least({a}, {b})", "last": "greatest({a}, {b})"}),
    "texts": ("doc_id bigint, seq string, blob binary", ["doc_id"], {}),
}


def open_index(spark: SparkSession, path: str | None = None) -> RunStore:
    """A fingerprint index; with the path of an earlier one, its state after the last whole batch."""
    return RunStore(spark, LEVELS, path)


def add_batch(index: RunStore, batch: DataFrame, rows: int, window: int = WINDOW, gram: int = GRAM, max_runs: int = MAX_RUNS) -> DataFrame:
    """Judges (doc_id, seq, anchors, blob) against the index and itself, then makes it part of the index.

    Returns (doc_id, seq, n_removed, kept_text, kept_sha256) of the documents that lose words.  A
    batch that is given again, as after a crash, gives the same result.
    """
    return settled(index.spark, "partly", lambda: _add_batch(index, batch, rows, window, gram, max_runs))


def _add_batch(index: RunStore, batch: DataFrame, rows: int, window: int, gram: int, max_runs: int) -> DataFrame:
    for level in ("anchors", "windows"):
        index.compact(level, max_runs)
    posted = batch.select("doc_id", F.explode("anchors").alias("anchor"))
    several = F.when(F.min("doc_id") < F.max("doc_id"), 2).otherwise(1)
    added = {
        "texts": index.write("texts", batch.select("doc_id", "seq", "blob"), 24 * rows),
        "anchors": index.write("anchors", posted.groupBy("anchor").agg(F.min("doc_id").alias("least"), several.alias("holders")), 24 * rows),
    }
    with merging(index.spark):
        known = index.beside("anchors", added["anchors"]).filter("holders + coalesce(old_holders, 0) > 1")
        shared = materialize(known.select("anchor", F.when(F.col("old_holders") == 1, F.col("old_least")).alias("only")), "shared")
    holders = posted.join(shared.select("anchor"), "anchor").select("doc_id", "anchor")
    earlier = shared.filter("only is not null").select(F.col("only").alias("doc_id"), "anchor")
    flagged = holders.withColumn("new", F.lit(True)).union(earlier.withColumn("new", F.lit(False)))
    suspects = flagged.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.max("new").alias("now"), F.max(~F.col("new")).alias("before"))
    suspects, opened = materialize(suspects, "suspects"), None
    with merging(index.spark):
        for n, run in enumerate([added["texts"], *index.state["texts"]["runs"]]):
            own = suspects.filter("before" if n else "now").select("doc_id", "anchors", F.lit(n == 0).alias("new"))
            some = own.join(index.read("texts", run), "doc_id").select("doc_id", "seq", "blob", "anchors", "new")
            opened = some if opened is None else opened.union(some)
        opened = materialize(opened, "opened")
    run, schema = _digests(window, gram)
    found = opened.mapInArrow(run, schema)
    added["windows"] = index.write("windows", found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")), 48 * rows)
    with merging(index.spark):
        repeated = index.beside("windows", added["windows"]).withColumn("first", F.least("least", "old_least")).filter("first < last").select("h1", "h2", "first")
        repeated = materialize(repeated, "repeated")
    run, schema = _digests(window, gram)
    new = opened.filter("new")
    hits = new.mapInArrow(run, schema).join(repeated, ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hits"))
    run, schema = _removed(window, gram)
    out = materialize(new.select("doc_id", "seq", "blob", "anchors").join(hits, "doc_id").mapInArrow(run, schema), "partly")
    index.commit(added)  # only now, so that a crash before leaves the index as it was
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: RunStore | None = None, max_runs: int = MAX_RUNS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of ``docs``; kept_text is null where nothing goes.

    The table goes through the index in ``batches`` ranges of ids, the smallest ids first.  With an
    index that holds earlier documents, these are seen, and only ``docs`` are judged.
    """
    return settled(docs.sparkSession, "substrings", lambda: _substring_dedup(docs, window, gram, batches, index, max_runs))


def _substring_dedup(docs: DataFrame, window: int, gram: int, batches: int, index: RunStore | None, max_runs: int) -> DataFrame:
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = _scan(window, gram)
    base = materialize(text.mapInArrow(run, schema), "scan")
    full = base.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = materialize(full.groupBy("seq").agg(F.min("doc_id").alias("least")), "classes")
    low, high, rows = classes.agg(F.min("least"), F.max("least"), F.count("*")).first()
    indexed = full.select("doc_id", "seq", "anchors", "blob").join(classes.select("seq", F.col("least").alias("doc_id")), ["seq", "doc_id"], "left_semi")
    own, parts = index or RunStore(spark, LEVELS, private=True), []
    edges = [low + (high - low + 1) * i // batches for i in range(batches)] + [high + 1] if low is not None else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            parts.append(add_batch(own, indexed.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)), -(-rows // batches), window, gram, max_runs))
    if index is None:
        own.close()
    partly = spark.createDataFrame([], _removed(window, gram)[1])
    for part in parts:
        partly = partly.union(part)
    partly = partly.dropDuplicates(["doc_id", "seq"])
    nothing = hashlib.sha256(b"").hexdigest()
    copy = (F.col("n_words") >= window) & (F.col("least") < F.col("doc_id"))
    return (
        base.select("doc_id", "seq", "n_words")
        .join(classes, "seq", "left")
        .join(partly, ["doc_id", "seq"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "seq")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
    )


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50
), win AS (
  SELECT starts.doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM starts JOIN w USING (doc_id)
), dup AS (
  SELECT doc_id, s FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE f < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM dup
), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
