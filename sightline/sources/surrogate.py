"""Detection-shaped views over the star-schema test tables, so that every operator can run there.

An order is an image of 1280 x 960 pixels, its lines are labelled boxes; predictions are derived
from labels with planted misses, confusions, duplicates and background boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.plans.store import materialize, shuffled

WIDTH, HEIGHT = 1280, 960


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label_ix, label, x, y, w, h, x1, y1, x2, y2, pk, sk) of labelled boxes."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").withColumn("rid", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
    rows = rows.selectExpr(
        "l_orderkey image_id", "cast(rid as bigint) label_ix", "case when l_returnflag = 'R' then 'robot' else 'fuel' end label", "l_partkey pk", "l_suppkey sk",
        "cast((l_partkey * 37) % 1180 as double) x", "cast((l_suppkey * 53 + l_partkey * 11) % 860 as double) y",
        "cast(20 + cast(l_quantity as int) * 2 as double) w", "cast(20 + cast(l_quantity as int) * 2 - (l_partkey % 3) * 4 as double) h",
    )
    return rows.selectExpr("*", "x x1", "y y1", "x + w x2", "y + h y2")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pred_ix, label, conf, x1, y1, x2, y2)."""
    flip = "case when pk % 13 = 0 then (case label when 'fuel' then 'robot' else 'fuel' end) else label end"
    made = lambda when, ix, label, x1, y1, conf: F.expr(f"case when {when} then named_struct('pred_ix', label_ix * 10 + {ix}, 'label', {label}, 'conf', cast(({conf}) / 1000 as double), 'x1', cast({x1} as double), 'y1', cast({y1} as double)) end")
    three = F.array_compact(F.array(
        made("pk % 11 <> 0", 0, flip, "x + (pk % 5) * w / 20", "y + (sk % 4) * h / 20", "50 + (pk * 7919 + sk * 104729 + label_ix * 31) % 950"),
        made("pk % 6 = 0", 1, "label", "x + (sk % 6) * w / 10", "y", "10 + (pk * 31 + sk * 17 + label_ix * 7) % 700"),
        made("sk % 7 = 0", 2, "label", "x + 2 * w", "y + 1.5D * h", "10 + (pk * 13 + sk * 29 + label_ix * 3) % 900"),
    ))
    rows = labels(spark, sf_dir).select("image_id", "w", "h", F.explode(three).alias("p"))
    return rows.selectExpr("image_id", "p.pred_ix", "p.label", "p.conf", "p.x1", "p.y1", "p.x1 + w x2", "p.y1 + h y2")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, width, height, unit, priority): all orders, those without boxes too."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey image_id", f"cast({WIDTH} as double) width", f"cast({HEIGHT} as double) height", "concat('u', o_custkey % 50) unit", "o_orderpriority priority")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, frame, file_name, value, event_id): events of one user as frames of a recording."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("frame", F.row_number().over(w) - 1).selectExpr("concat('rec', user_id) recording", "frame", "value", "event_id")
    return rows.withColumn("file_name", F.concat("recording", F.lit("_"), F.lpad(F.col("frame").cast("string"), 4, "0"), F.lit(".jpg")))


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dataset, split, file_name, content, hash): a 64-bit hash of word buckets as the perceptual hash.

    Computed from the texts once and written; ``content`` is their SHA-256.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content"), F.col("source").alias("dataset"))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1))).alias("w"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring("h", i, 1)) - 1
    buckets = words.select("doc_id", F.md5("w").alias("h")).groupBy("doc_id", (digit(1) % 4 * 16 + digit(2)).alias("b")).agg(F.count("*").alias("n"))
    per = buckets.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    per = per.withColumn("a", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0))))
    ranked = F.array_sort("a")
    per = per.withColumn("mid", (ranked[31] + ranked[32]) / 2)
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(F.col("a")[b] > F.col("mid"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    hashes = per.select("doc_id", bits.alias("hash"))
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "valid").otherwise("test")
    joined = docs.drop("text").join(shuffled(hashes), "doc_id", "left").select("doc_id", "dataset", split.alias("split"), F.concat(F.lit("d"), "doc_id", F.lit(".jpg")).alias("file_name"), "content", F.coalesce("hash", F.lit(0)).alias("hash"))
    return materialize(joined, "hashed")


_GT = """k AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rid FROM lineitem
), gt0 AS (
  SELECT l_orderkey AS image_id, rid AS label_ix, CASE WHEN l_returnflag = 'R' THEN 'robot' ELSE 'fuel' END AS label, l_partkey AS pk, l_suppkey AS sk,
    ((l_partkey * 37) % 1180)::DOUBLE AS x, ((l_suppkey * 53 + l_partkey * 11) % 860)::DOUBLE AS y,
    (20 + trunc(l_quantity)::INT * 2)::DOUBLE AS w, (20 + trunc(l_quantity)::INT * 2 - (l_partkey % 3) * 4)::DOUBLE AS h FROM k
), gt AS (SELECT *, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM gt0)"""
_PD = """pd0 AS (
  SELECT image_id, label_ix * 10 AS pred_ix, CASE WHEN pk % 13 = 0 THEN (CASE label WHEN 'fuel' THEN 'robot' ELSE 'fuel' END) ELSE label END AS label,
    x + (pk % 5) * w / 20 AS x1, y + (sk % 4) * h / 20 AS y1, w, h, (50 + (pk * 7919 + sk * 104729 + label_ix * 31) % 950) / 1000.0::DOUBLE AS conf FROM gt WHERE pk % 11 <> 0
  UNION ALL SELECT image_id, label_ix * 10 + 1, label, x + (sk % 6) * w / 10, y, w, h, (10 + (pk * 31 + sk * 17 + label_ix * 7) % 700) / 1000.0::DOUBLE FROM gt WHERE pk % 6 = 0
  UNION ALL SELECT image_id, label_ix * 10 + 2, label, x + 2 * w, y + 1.5 * h, w, h, (10 + (pk * 13 + sk * 29 + label_ix * 3) % 900) / 1000.0::DOUBLE FROM gt WHERE sk % 7 = 0
), pd AS (SELECT image_id, pred_ix, label, conf::DOUBLE AS conf, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x1 + w)::DOUBLE AS x2, (y1 + h)::DOUBLE AS y2 FROM pd0)"""
_IMAGES = f"images AS (SELECT o_orderkey AS image_id, {WIDTH}.0::DOUBLE AS width, {HEIGHT}.0::DOUBLE AS height, 'u' || (o_custkey % 50) AS unit, o_orderpriority AS priority FROM orders)"
_FRAMES = """frames0 AS (
  SELECT 'rec' || user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_id FROM events
), frames AS (SELECT *, recording || '_' || lpad(frame::VARCHAR, 4, '0') || '.jpg' AS file_name FROM frames0)"""
_HASHES = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS w FROM documents),
buckets AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 2))::INT % 64 AS b, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT d.doc_id, s.b, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id FROM buckets) d CROSS JOIN (SELECT unnest(range(64)) AS b) s LEFT JOIN buckets USING (doc_id, b)),
mids AS (SELECT doc_id, median(n) AS mid FROM cells GROUP BY 1),
hashes AS (SELECT doc_id, sum(CASE WHEN n > mid THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END)::UBIGINT AS hash FROM cells JOIN mids USING (doc_id) GROUP BY 1),
docs AS (
  SELECT d.doc_id, source AS dataset, CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
    'd' || d.doc_id || '.jpg' AS file_name, text, coalesce(hash, 0)::UBIGINT AS hash FROM documents d LEFT JOIN hashes USING (doc_id))"""

#: The same views for DuckDB, to stand after WITH.
SQL = {"gt": _GT, "pd": f"{_GT}, {_PD}", "images": _IMAGES, "frames": _FRAMES, "docs": _HASHES}

IOU = """CASE WHEN greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) = 0 THEN 0.0 ELSE
  greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) /
  ((({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)) + (({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)) - greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) END"""


def greedy_sql(name: str, pairs: str, keys: str, order: str) -> str:
    """Common table expressions that walk each group's pairs in order; ``name`` holds the taken ones."""
    on = " AND ".join(f"p.{k} = g.{k}" for k in keys.split(", "))
    own = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({pairs})),
{name}_g AS (
  SELECT DISTINCT {keys}, 0::BIGINT AS rn, []::BIGINT[] AS ul, []::BIGINT[] AS up, false AS took FROM {name}_p
  UNION ALL
  SELECT {own}, p.rn, CASE WHEN list_contains(ul, label_ix) OR list_contains(up, pred_ix) THEN ul ELSE list_append(ul, label_ix) END,
    CASE WHEN list_contains(ul, label_ix) OR list_contains(up, pred_ix) THEN up ELSE list_append(up, pred_ix) END,
    NOT (list_contains(ul, label_ix) OR list_contains(up, pred_ix))
  FROM {name}_g g JOIN {name}_p p ON {on} AND p.rn = g.rn + 1
), {name} AS (SELECT p.* FROM {name}_p p JOIN {name}_g g ON {on} AND p.rn = g.rn WHERE took)"""
