"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  Decisions take effect:

1. language ID drops documents whose margin is narrow and writes the predicted language;
2. MinHash near-dedup keeps the least id of every group of near copies (five-word shingles);
3. substring dedup removes repeated passages of 50 words and drops documents left without words;
4. benchmark decontamination drops documents that hold a passage of a test item;
5. best-fit packing cuts what is left into sequences, with their token ids.

Rows with a null id pass stages 1 to 4 unless their text is rejected; an id that is repeated with
several texts is judged by all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, language_id, minhash_dedup, packing, substring_dedup
from sightline.plans.store import bounded, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    """The five columns, null where the input has none."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(KINDS[c]).alias(c) for c in COLUMNS])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return language_id.relabel(docs, language_id.train(docs.filter("doc_id is not null")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    gone = bounded(minhash_dedup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    cut = substring_dedup.substring_dedup(docs).filter("n_removed > 0").select("doc_id", "kept_text").dropDuplicates(["doc_id"])
    joined = docs.join(cut, "doc_id", "left")
    text = F.coalesce("kept_text", "text")
    left = joined.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))).withColumn("text", text)
    return left.filter(F.col("kept_text").isNull() | (F.col("kept_text") != "")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(bounded(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression, edit distance and tokenisation are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
