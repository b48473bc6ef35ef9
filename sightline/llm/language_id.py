"""Language identification by compression with per-language dictionaries.

Training fills one raw-content zstandard dictionary for each language from a bounded sample:
``sample_rows`` hash buckets a language, from each the row of least hash, short rows first, until
``dict_bytes`` are full.  A text's letters are lower-cased
(very short ones written six times), cut into blocks of ``BLOCK_BYTES``
and compressed with every dictionary; the language with the smallest total wins.  Blocks keep
long texts dependent on the dictionary instead of on their own past.  The score falls with the
bytes saved over the second language, and a narrow margin is rejected.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and rejected; so is
every text if no language was learned; one learned language always wins with score 1; ties go to
the first language in order; repeated rows are judged alike; a null id is passed through; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import kernels as K
from sightline.plans.store import materialize

DICT_BYTES, SAMPLE_ROWS, BLOCK_BYTES, SHORT_BYTES = 98_304, 48, 1024, 128
#: Up to so many languages have dictionaries of full size; those of more languages share their room.
FULL_LANGUAGES, LEAST_BYTES = 128, 1024
#: Saved bytes that make one language e times as likely as another.
SOFT_BYTES = 4.0
#: A text is rejected below this score.
ACCEPT = 0.5
#: Binary-tree search with short matches tells short blocks apart better than the stock levels do.
SEARCH = {"strategy": zstandard.STRATEGY_BTLAZY2, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 5, "min_match": 4, "target_length": 16}
_other = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased letters with single spaces between words."""
    return _other.sub(" ", text.lower()).strip().encode()


def train(rows: DataFrame, dict_bytes: int = DICT_BYTES, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """One dictionary for each language of (doc_id, text, lang), from at most ``sample_rows`` rows of each.

    Every label with 8 letters of text is learned.  Beyond FULL_LANGUAGES labels, dictionaries
    shrink, to LEAST_BYTES at least, and take an eighth of their size from a row, so that up to
    some 12,000 labels the driver gets at most FULL_LANGUAGES * sample_rows * dict_bytes / 8
    bytes, besides languages that have long texts only.
    """
    long_ = (F.octet_length("text") > dict_bytes // 8).cast("long")
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    rank = F.shiftleft(long_, 62) + F.shiftrightunsigned(hashed, 2)
    ranked = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", rank.alias("rank"), F.pmod(hashed, F.lit(sample_rows)).alias("bucket"))
    least = materialize(ranked.groupBy("lang", "bucket").agg(F.min("rank").alias("rank")), "least")
    languages = least.select("lang").distinct().count()
    each, most = dict_bytes, dict_bytes
    if languages > FULL_LANGUAGES:
        each = min(dict_bytes, max(LEAST_BYTES, FULL_LANGUAGES * dict_bytes // languages))
        most = each // 8
    chosen = F.broadcast(least) if languages * sample_rows <= 1_000_000 else least
    sample = ranked.join(chosen, ["lang", "bucket", "rank"]).select("lang", "rank", F.substring("text", 1, most).alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(sample.dropDuplicates(["lang", "rank"]).collect(), key=lambda r: (r["lang"], r["rank"])):
        piece, have = letters(r["text"]), out.get(r["lang"], b"")
        if not have or len(have) + len(piece) < each:
            out[r["lang"]] = piece + b" " + have
    return {k: v[-each:] for k, v in out.items() if len(v.strip()) >= 8}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.squeeze = []
        spare = max(0, (len(self.names) - 1) // FULL_LANGUAGES).bit_length()  # tables shrink with the dictionaries
        logs = {k: max(10, SEARCH[k] - spare) for k in ("hash_log", "chain_log")}
        for name in self.names:
            own = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            search = zstandard.ZstdCompressionParameters(write_content_size=False, write_dict_id=False, **SEARCH | logs)
            own.precompute_compress(compression_params=search)
            self.squeeze.append(zstandard.ZstdCompressor(dict_data=own, compression_params=search).compress)

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and bytes saved over the second language."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 0
        raw = letters(text)
        if not raw:
            return "und", 0.0, 0
        if len(raw) < SHORT_BYTES:  # else it would be stored uncompressed, alike for all dictionaries
            raw = b" ".join([raw] * 6)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.squeeze]
        best = min(sizes)
        score = 1.0 / sum(math.exp((best - s) / SOFT_BYTES) for s in sizes)
        return self.names[sizes.index(best)], score, (sorted(sizes)[1] - best if len(sizes) > 1 else len(raw))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], accept: float = ACCEPT) -> DataFrame:
    """(doc_id, lang_pred, score, margin_bytes, rejected) of every row of (doc_id, text)."""
    schema = K.columns("doc_id long, lang_pred string, score double, margin_bytes long, rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        judge = Classifier(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                told = [judge(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()), pa.array([t[2] for t in told], pa.int64()), pa.array([t[1] < accept for t in told], pa.bool_())], schema=schema)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, lang_pred string, score double, margin_bytes long, rejected boolean")


def relabel(docs: DataFrame, dictionaries: dict[str, bytes], accept: float = ACCEPT) -> DataFrame:
    """The rows that aren't rejected, with ``lang`` replaced by the prediction, in one pass and no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("lang")
    text_at = docs.columns.index("text")

    def run(batches):
        judge = Classifier(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                told = [judge(t) for t in part.column(text_at).to_pylist()]
                arrays = list(part.columns)
                arrays[at] = pa.array([t[0] for t in told], arrays[at].type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema).filter(pa.array([t[1] >= accept for t in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs, model).withColumn("held_out", held_out())
