"""The registered queries over the surrogate views, each with the SQL that DuckDB checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import bins as B
from sightline.functions import geometry as G
from sightline.functions import names as N
from sightline.operators import bootstrap as BS
from sightline.operators import diagnose as D
from sightline.operators import hamming as H
from sightline.operators import matching as M
from sightline.operators import merge as MG
from sightline.operators import metrics as X
from sightline.operators import reconcile as R
from sightline.operators import splits as SP
from sightline.operators import stats as ST
from sightline.operators import threshold as T
from sightline.sources import surrogate as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: For matching in DuckDB.
PAIRS = f"""SELECT l.image_id, l.label_ix, p.pred_ix, l.label AS l_label, p.label AS p_label, l.label = p.label AS same, p.conf, {S.IOU.format(a='l', b='p')} AS iou
  FROM gt l JOIN pd p ON l.image_id = p.image_id"""
MATCH = S.greedy_sql("m", f"SELECT * FROM ({PAIRS} WHERE p.conf >= 0.5) WHERE iou > 0.5", "image_id", "same DESC, iou DESC, label_ix, pred_ix")


def query(name: str, sql: str | None = None):
    """Registers a query, and its oracle if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _gt(spark: SparkSession, d: str) -> DataFrame:
    return S.labels(spark, d)


def _pd(spark: SparkSession, d: str, least: float | None = 0.5) -> DataFrame:
    return S.predictions(spark, d) if least is None else M.above(S.predictions(spark, d), least)


@query("match_counts", f"""WITH RECURSIVE {S.SQL['pd']}, {MATCH}
SELECT c.label, tp, np - tp AS fp, nl - tp AS fn FROM (SELECT label, count(*) AS nl FROM gt GROUP BY 1) c
JOIN (SELECT label, count(*) AS np FROM pd WHERE conf >= 0.5 GROUP BY 1) USING (label)
JOIN (SELECT l_label AS label, count(*) AS tp FROM m WHERE same GROUP BY 1) USING (label)""")
def match_counts(spark, d):
    gt, pd = _gt(spark, d), _pd(spark, d)
    return M.error_counts(gt, pd, M.match_boxes(gt, pd, 0.5))


@query("match_pairs", f"WITH RECURSIVE {S.SQL['pd']}, {MATCH} SELECT image_id, label_ix, pred_ix, same, round(iou, 6) AS iou FROM m")
def match_pairs(spark, d):
    return M.match_boxes(_gt(spark, d), _pd(spark, d), 0.5).select("image_id", "label_ix", "pred_ix", "same", F.round("iou", 6).alias("iou"))


@query("confusion_matrix", f"""WITH RECURSIVE {S.SQL['pd']}, {MATCH}
SELECT l_label AS true_label, p_label AS pred_label, count(*) AS n FROM m GROUP BY ALL
UNION ALL SELECT label, 'background', count(*) FROM gt g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = g.image_id AND m.label_ix = g.label_ix) GROUP BY 1
UNION ALL SELECT 'background', label, count(*) FROM pd p WHERE conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = p.image_id AND m.pred_ix = p.pred_ix) GROUP BY 2""")
def confusion_matrix(spark, d):
    gt, pd = _gt(spark, d), _pd(spark, d)
    return M.confusion_matrix(gt, pd, M.match_boxes(gt, pd, 0.5))


FUEL = S.greedy_sql("m", f"SELECT * FROM ({PAIRS} WHERE p.conf >= 0.5 AND l.label = 'fuel' AND p.label = 'fuel') WHERE iou > 0.5", "image_id", "iou DESC, label_ix, pred_ix")


@query("false_positive_kinds", f"""WITH RECURSIVE {S.SQL['pd']}, {FUEL}, fp AS (
  SELECT * FROM pd p WHERE conf >= 0.5 AND label = 'fuel' AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = p.image_id AND m.pred_ix = p.pred_ix)
), kinds AS (
  SELECT p.image_id, p.pred_ix, p.conf,
    bool_or(l.label = 'fuel' AND m.label_ix IS NOT NULL AND {S.IOU.format(a='l', b='p')} > 0.5) AS dup,
    bool_or(l.label = 'fuel' AND {S.IOU.format(a='l', b='p')} > 0.1) AS loc,
    bool_or(l.label = 'robot' AND (p.x1 + p.x2) / 2 BETWEEN l.x1 AND l.x2 AND (p.y1 + p.y2) / 2 BETWEEN l.y1 AND l.y2) AS held
  FROM fp p LEFT JOIN gt l ON l.image_id = p.image_id LEFT JOIN m ON m.image_id = l.image_id AND m.label_ix = l.label_ix GROUP BY ALL
) SELECT image_id, pred_ix, conf, CASE WHEN dup THEN 'duplicate' WHEN loc THEN 'localization' WHEN held THEN 'inside_unscored' ELSE 'background' END AS kind FROM kinds""")
def false_positive_kinds(spark, d):
    gt = _gt(spark, d)
    return M.false_positive_kinds(gt, _pd(spark, d), 0.5, 0.1, "fuel", M.restrict(gt, ["robot"]))


SAME = S.greedy_sql("m", f"SELECT * FROM ({PAIRS} WHERE p.conf >= 0.5 AND l.label = p.label) WHERE iou >= 0.5", "image_id", "iou DESC, label_ix, pred_ix")


@query("precision_recall", f"""WITH RECURSIVE {S.SQL['pd']}, {SAME}
SELECT label, tp, np - tp AS fp, nl - tp AS fn, round(tp / np, 6) AS precision, round(tp / nl, 6) AS recall FROM (SELECT label, count(*) AS nl FROM gt GROUP BY 1)
JOIN (SELECT label, count(*) AS np FROM pd WHERE conf >= 0.5 GROUP BY 1) USING (label) JOIN (SELECT l_label AS label, count(*) AS tp FROM m GROUP BY 1) USING (label)""")
def precision_recall(spark, d):
    out = X.precision_recall(_gt(spark, d), _pd(spark, d), 0.5)
    return out.select("label", "tp", "fp", "fn", X.round6("precision").alias("precision"), X.round6("recall").alias("recall"))


GRID = X.threshold_range(0.05, 0.95, 0.05)
CURVE = S.greedy_sql("m", f"SELECT * FROM (SELECT *, unnest([{', '.join(map(str, GRID))}])::DOUBLE AS t FROM ({PAIRS} WHERE l.label = p.label)) WHERE iou >= 0.5 AND conf >= t", "image_id, t", "iou DESC, label_ix, pred_ix")


@query("pr_curve", f"""WITH RECURSIVE {S.SQL['pd']}, {CURVE}, g AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS threshold)
SELECT threshold, label, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, nl - coalesce(tp, 0) AS fn,
  CASE WHEN np > 0 THEN round(coalesce(tp, 0) / np, 6) END AS precision, round(coalesce(tp, 0) / nl, 6) AS recall
FROM g CROSS JOIN (SELECT label, count(*) AS nl FROM gt GROUP BY 1) l
LEFT JOIN (SELECT t AS threshold, l_label AS label, count(*) AS tp FROM m GROUP BY ALL) USING (threshold, label)
LEFT JOIN (SELECT threshold, label, count(*) AS np FROM pd JOIN g ON conf >= threshold GROUP BY ALL) USING (threshold, label)""")
def pr_curve(spark, d):
    out = X.pr_curve(_gt(spark, d), _pd(spark, d, None), 0.5, GRID)
    return out.select("threshold", "label", "tp", "fp", "fn", X.round6("precision").alias("precision"), X.round6("recall").alias("recall"))


def _ap_sql(ious: list[float]) -> str:
    at = ", ".join(map(str, ious))
    walk = S.greedy_sql("m", f"SELECT * FROM (SELECT *, unnest([{at}])::DOUBLE AS iou_at FROM ({PAIRS} WHERE l.label = p.label)) WHERE iou >= iou_at", "image_id, l_label, iou_at", "conf DESC, pred_ix, iou DESC, label_ix")
    return f"""WITH RECURSIVE {S.SQL['pd']}, {walk}, f AS (
  SELECT p.label, g.iou_at, p.conf, p.image_id, p.pred_ix, CASE WHEN m.pred_ix IS NULL THEN 0 ELSE 1 END AS tp
  FROM pd p CROSS JOIN (SELECT unnest([{at}])::DOUBLE AS iou_at) g LEFT JOIN m ON m.image_id = p.image_id AND m.pred_ix = p.pred_ix AND m.iou_at = g.iou_at
), c AS (
  SELECT *, sum(tp) OVER w AS ctp, count(*) OVER w AS cn FROM f WINDOW w AS (PARTITION BY label, iou_at ORDER BY conf DESC, image_id, pred_ix ROWS UNBOUNDED PRECEDING)
), h AS (
  SELECT *, max(ctp / cn) OVER (PARTITION BY label, iou_at ORDER BY conf, image_id DESC, pred_ix DESC ROWS UNBOUNDED PRECEDING) AS hull FROM c
), n AS (SELECT label, count(*) AS n FROM gt GROUP BY 1)
SELECT label, iou_at, round(sum(hull * (ctp * 100 // n - (ctp - 1) * 100 // n + CASE WHEN ctp = 1 THEN 1 ELSE 0 END)) / 101, 6) AS ap FROM h JOIN n USING (label) WHERE tp = 1 GROUP BY ALL"""


#: The ten thresholds of the COCO protocol.
IOUS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@query("average_precision", _ap_sql(IOUS))
def average_precision(spark, d):
    return X.average_precision(_gt(spark, d), _pd(spark, d, None), IOUS).select("label", "iou_at", X.round6("ap").alias("ap"))


@query("topk_predictions", f"""WITH {S.SQL['pd']} SELECT image_id, pred_ix, label, conf FROM pd
QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY conf DESC, pred_ix) <= 3""")
def topk_predictions(spark, d):
    return M.top_k(_pd(spark, d, None), 3, ["fuel", "robot"]).select("image_id", "pred_ix", "label", "conf")


@query("per_image_limit", f"""WITH {S.SQL['pd']}, f AS (SELECT image_id, label, min(conf) AS c FROM pd GROUP BY ALL HAVING count(*) >= 4),
i AS (SELECT image_id, bool_or(c >= 0.2) AS hot FROM f GROUP BY 1) SELECT count(*) AS images_at_limit, count(*) FILTER (hot) AS images_cut_above FROM i""")
def per_image_limit(spark, d):
    return M.per_image_limit(_pd(spark, d, None), 4, 0.2)


SMALLER = "greatest(0, least(l.x2, p.x2) - greatest(l.x1, p.x1)) * greatest(0, least(l.y2, p.y2) - greatest(l.y1, p.y1)) / least((l.x2 - l.x1) * (l.y2 - l.y1), (p.x2 - p.x1) * (p.y2 - p.y1))"


@query("edge_ignore", f"""WITH {S.SQL['pd']}, e AS (SELECT *, label = 'fuel' AND (x1 <= 40 OR y1 <= 40 OR x2 >= 1240 OR y2 >= 920) AS edge FROM gt)
SELECT 'label' AS side, image_id, label_ix AS ix FROM e WHERE NOT edge
UNION ALL SELECT 'prediction', image_id, pred_ix FROM pd p WHERE NOT (label = 'fuel'
  AND EXISTS (SELECT 1 FROM e l WHERE edge AND l.image_id = p.image_id AND l.label = p.label AND {SMALLER} > 0.5)
  AND NOT EXISTS (SELECT 1 FROM e l WHERE NOT edge AND l.image_id = p.image_id AND l.label = p.label AND {S.IOU.format(a='p', b='l')} >= 0.5))""")
def edge_ignore(spark, d):
    a, b = M.ignore_at_edge(_gt(spark, d), _pd(spark, d, None), S.images(spark, d), ["fuel"], 40, 0.5, 0.5)
    return a.select(F.lit("label").alias("side"), "image_id", F.col("label_ix").alias("ix")).union(b.select(F.lit("prediction").alias("side"), "image_id", F.col("pred_ix").alias("ix")))


@query("unit_counts", f"""WITH {S.SQL['gt']}, {S.SQL['images']}, b AS (SELECT image_id, count(*) AS n FROM gt GROUP BY 1)
SELECT unit, count(*) AS images, coalesce(sum(n), 0)::BIGINT AS boxes FROM images LEFT JOIN b USING (image_id) GROUP BY 1""")
def unit_counts(spark, d):
    return M.unit_counts(S.images(spark, d).select("image_id", "unit"), _gt(spark, d))


@query("box_geometry", f"""WITH {S.SQL['gt']}, t AS (SELECT *, w * h / (1280.0 * 960) AS share FROM gt)
SELECT image_id, label_ix, CASE WHEN share < 0.0025 THEN 'small' WHEN share < 0.0052 THEN 'medium' ELSE 'large' END AS bucket,
  w <= 0 OR h <= 0 OR x < -1 OR y < -1 OR x + w > 1281 OR y + h > 961 AS invalid, x1 <= 2 OR y1 <= 2 OR x2 >= 1278 OR y2 >= 958 AS edge, round(sqrt(share), 6) AS side FROM t""")
def box_geometry(spark, d):
    c, w, h = F.col, F.lit(1280.0), F.lit(960.0)
    return _gt(spark, d).select(
        "image_id", "label_ix", G.area_bucket(c("w"), c("h"), w, h, 0.0025, 0.0052).alias("bucket"), G.is_invalid(c("x"), c("y"), c("w"), c("h"), w, h, 1).alias("invalid"),
        G.at_edge(G.box(), w, h, 2).alias("edge"), F.round(G.relative_side(c("w"), c("h"), w, h), 6).alias("side"),
    )


# ---- duplicates, groups and splits -------------------------------------------------------------

NEAR = "SELECT a.doc_id AS id_a, b.doc_id AS id_b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM docs a JOIN docs b ON a.doc_id < b.doc_id AND bit_count(xor(a.hash, b.hash)) <= 4"


def _docs(spark, d):
    return S.hashed_documents(spark, d)


@query("near_duplicates", f"WITH {S.SQL['docs']} {NEAR}")
def near_duplicates(spark, d):
    return H.near_pairs(_docs(spark, d), 4, "doc_id").select("id_a", "id_b", F.col("distance").cast("int").alias("distance"))


@query("near_pair_summary", f"""WITH {S.SQL['docs']}, p AS ({NEAR}), s AS (
  SELECT CASE WHEN a.dataset <> b.dataset THEN 'cross_dataset' WHEN a.split <> b.split THEN 'cross_split' ELSE 'within_split' END AS kind,
    a.dataset || '/' || a.split AS x, b.dataset || '/' || b.split AS y FROM p JOIN docs a ON a.doc_id = id_a JOIN docs b ON b.doc_id = id_b)
SELECT kind, least(x, y) AS side_a, greatest(x, y) AS side_b, count(*) AS n FROM s GROUP BY ALL""")
def near_pair_summary(spark, d):
    return H.count_pairs(_docs(spark, d), 4)


@query("cross_dataset_pairs", f"WITH {S.SQL['docs']}, p AS ({NEAR}) SELECT count(*) AS pairs FROM p JOIN docs a ON a.doc_id = id_a JOIN docs b ON b.doc_id = id_b WHERE a.dataset <> b.dataset")
def cross_dataset_pairs(spark, d):
    return H.count_pairs(_docs(spark, d), 4).filter("kind = 'cross_dataset'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


@query("near_test", f"WITH {S.SQL['docs']} SELECT doc_id, split FROM docs a WHERE split <> 'test' AND EXISTS (SELECT 1 FROM docs b WHERE b.split = 'test' AND bit_count(xor(a.hash, b.hash)) <= 4)")
def near_test(spark, d):
    return H.near_test(_docs(spark, d), 4).select("doc_id", "split")


@query("near_any", f"""WITH {S.SQL['docs']} SELECT doc_id FROM docs a WHERE dataset <> 'src0' AND EXISTS (
  SELECT 1 FROM docs b WHERE b.dataset = 'src0' AND (bit_count(xor(a.hash, b.hash)) <= 4 OR bit_count(xor(xor(a.hash, 255::UBIGINT), b.hash)) <= 4))""")
def near_any(spark, d):
    docs = _docs(spark, d)
    views = F.array(F.col("hash"), F.col("hash").bitwiseXOR(F.lit(255).cast("long")))
    return H.near_any(docs.filter("dataset <> 'src0'").withColumn("views", views), docs.filter("dataset = 'src0'"), 4).select("doc_id")


@query("exact_duplicates", "SELECT sha256(text) AS sha256, doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS copies FROM documents QUALIFY copies > 1")
def exact_duplicates(spark, d):
    return H.exact_members(S.table(spark, d, "documents"), "text", "doc_id").withColumnRenamed("id", "doc_id")


#: Documents as images of one recording each: relatedness by equal text and by near hashes.
GROUPS = f"""{S.SQL['docs']}, edges AS (
  SELECT a.file_name AS a, b.file_name AS b FROM docs a JOIN docs b ON a.doc_id <> b.doc_id AND (a.text = b.text OR bit_count(xor(a.hash, b.hash)) <= 4)
), reach AS (SELECT file_name AS v, file_name AS c FROM docs UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.v
), units AS (SELECT v AS file_name, min(c) AS unit FROM reach GROUP BY 1)"""


def _images(spark, d):
    return _docs(spark, d).withColumnRenamed("content", "source_name")


@query("leak_groups", f"WITH RECURSIVE {GROUPS} SELECT file_name, unit FROM units")
def leak_groups(spark, d):
    return SP.leak_groups(_images(spark, d), None, 4).select("file_name", "unit")


ASSIGN = """sizes AS (SELECT unit, count(*) AS size, min(file_name) AS first FROM units GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, sha256('2026:' || first)) AS rn FROM sizes),
goal AS (SELECT 0.7::DOUBLE * sum(size) AS a, 0.15::DOUBLE * sum(size) AS b, 0.15::DOUBLE * sum(size) AS c FROM sizes),
walk AS (
  SELECT 0::BIGINT AS rn, 0::BIGINT AS fa, 0::BIGINT AS fb, 0::BIGINT AS fc, '' AS unit, '' AS split, 0::BIGINT AS size
  UNION ALL
  SELECT rn, fa + CASE WHEN s = 'train' THEN size ELSE 0 END, fb + CASE WHEN s = 'valid' THEN size ELSE 0 END, fc + CASE WHEN s = 'test' THEN size ELSE 0 END, unit, s, size
  FROM (SELECT r.rn, r.unit, r.size, fa, fb, fc, CASE WHEN (a - fa) / a >= (b - fb) / b AND (a - fa) / a >= (c - fc) / c THEN 'train' WHEN (b - fb) / b >= (c - fc) / c THEN 'valid' ELSE 'test' END AS s
    FROM walk w JOIN ranked r ON r.rn = w.rn + 1, goal))"""


@query("assign_groups", f"WITH RECURSIVE {GROUPS}, {ASSIGN} SELECT unit, size, split FROM walk WHERE rn > 0")
def assign_groups(spark, d):
    return SP.assign_groups(SP.leak_groups(_images(spark, d), None, 4), "2026")


@query("grouped_split", f"WITH RECURSIVE {GROUPS}, {ASSIGN} SELECT file_name, unit, split FROM units JOIN walk USING (unit)")
def grouped_split(spark, d):
    return SP.grouped_split(_images(spark, d), None, 4, "2026").select("file_name", "unit", "split")


@query("eval_only_split", f"WITH RECURSIVE {GROUPS} SELECT unit, 'test' AS split, count(*) AS images FROM units GROUP BY 1")
def eval_only_split(spark, d):
    return SP.eval_only_split(_images(spark, d), None, 4).groupBy("unit", "split").agg(F.count("*").alias("images"))


@query("drop_near_test", f"WITH {S.SQL['docs']} SELECT file_name, split, CASE WHEN split <> 'test' AND EXISTS (SELECT 1 FROM docs b WHERE b.split = 'test' AND bit_count(xor(a.hash, b.hash)) <= 4) THEN 'near_test' END AS dropped FROM docs a")
def drop_near_test(spark, d):
    return SP.drop_near_test(_docs(spark, d).withColumn("dropped", F.lit(None).cast("string")), 4).select("file_name", "split", "dropped")


TEMPORAL = f"""{S.SQL['frames']}, f AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY recording) AS n FROM frames WINDOW w AS (PARTITION BY recording ORDER BY frame, file_name)
), whole AS (SELECT *, n < 60 OR regexp_matches(recording, '^rec1') AS w FROM f),
cut0 AS (SELECT *, CASE WHEN w THEN n ELSE least(round_even(n * 0.7::DOUBLE, 0)::BIGINT, n - 2) END AS a FROM whole),
cut AS (SELECT *, CASE WHEN w THEN n ELSE least(greatest(a + round_even(n * 0.15::DOUBLE, 0)::BIGINT, a + 1), n - 1) END AS b FROM cut0),
ends AS (SELECT *, max(CASE WHEN i = a THEN frame END) OVER (PARTITION BY recording) AS fa, max(CASE WHEN i = b THEN frame END) OVER (PARTITION BY recording) AS fb FROM cut),
temporal AS (SELECT recording, frame, file_name, CASE WHEN i < a THEN 'train' WHEN i < b THEN 'valid' ELSE 'test' END AS split, recording AS unit,
  CASE WHEN (CASE WHEN i < a THEN fa WHEN i < b THEN fb END) - frame <= 2 THEN 'buffer' END AS dropped FROM ends)"""


def _temporal(spark, d):
    return SP.temporal_split(S.frames(spark, d), 2, 60, train_only="rec1")


@query("temporal_split", f"WITH {TEMPORAL} SELECT * FROM temporal")
def temporal_split(spark, d):
    return _temporal(spark, d)


@query("split_summary", f"""WITH {TEMPORAL}, u AS (SELECT split, unit, count(*) FILTER (dropped IS NULL) AS n, count(*) FILTER (dropped IS NOT NULL) AS gone FROM temporal GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS images, count(*) FILTER (n > 0) AS units, max(n) AS largest_unit, sum(gone)::BIGINT AS dropped FROM u GROUP BY 1""")
def split_summary(spark, d):
    return SP.split_summary(_temporal(spark, d))


COPIES = f"""{S.SQL['gt']}, im AS (
  SELECT o_orderkey AS image_id, 'set' || (o_orderkey % 3) AS dataset, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split,
    'i' || o_orderkey || '.rf.x.jpg' AS file_name, 's' || (o_custkey % 400) AS source_name, o_orderstatus AS status FROM orders
), hist AS (SELECT image_id, string_agg(label || n, ',' ORDER BY label) AS h FROM (SELECT image_id, label, count(*) AS n FROM gt GROUP BY ALL) GROUP BY 1),
ar AS (SELECT image_id, sum(w * h) AS area FROM gt GROUP BY 1),
cp AS (SELECT im.*, source_name || '|' || coalesce(h, '') AS ck, coalesce(area, 0) AS area FROM im LEFT JOIN hist USING (image_id) LEFT JOIN ar USING (image_id) WHERE split = 'train'),
kp AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY area, file_name) = 1 AS keep, dense_rank() OVER (ORDER BY ck) AS g FROM cp)"""


def _copy_images(spark, d):
    return S.table(spark, d, "orders").selectExpr(
        "o_orderkey image_id", "concat('set', o_orderkey % 3) dataset", "case when o_orderkey % 10 < 7 then 'train' when o_orderkey % 10 < 8 then 'valid' else 'test' end split",
        "concat('i', o_orderkey, '.rf.x.jpg') file_name", "concat('s', o_custkey % 400) source_name", "o_orderstatus status",
    )


@query("pick_copies", f"WITH {COPIES} SELECT file_name, keep, count(*) OVER (PARTITION BY ck) AS copies FROM kp")
def pick_copies(spark, d):
    gt = _gt(spark, d)
    picked = SP.pick_copies(SP.copy_groups(_copy_images(spark, d), gt), gt)
    return picked.select("file_name", "keep", F.count("*").over(W.partitionBy("copy_key")).alias("copies"))


PLAN = f"""{COPIES}, k2 AS (SELECT im.*, ck, coalesce(keep, true) AS keep, CASE WHEN im.image_id % 37 = 0 THEN 'source_name' WHEN im.image_id % 41 = 0 THEN 'same_scene' END AS reason FROM im LEFT JOIN kp USING (image_id)),
k3 AS (SELECT *, CASE WHEN ck IS NOT NULL THEN min(reason) OVER (PARTITION BY dataset, ck) END AS shared FROM k2),
planned AS (SELECT *, CASE WHEN ck IS NOT NULL AND coalesce(reason, shared) IS NOT NULL THEN coalesce(reason, shared) WHEN ck IS NOT NULL AND NOT keep THEN 'copy'
  WHEN (CASE WHEN dataset = 'set2' THEN 'train' ELSE split END) <> 'test' AND regexp_matches(source_name, '^s39') THEN 'excluded' WHEN dataset = 'set2' THEN reason END AS drop_reason,
  CASE WHEN dataset = 'set2' THEN 'train' ELSE split END AS target_split, dataset || '__' || replace(file_name, '.rf.', '_rf_') AS merged_name FROM k3)"""


def _planned(spark, d):
    gt, im = _gt(spark, d), _copy_images(spark, d)
    picked = SP.pick_copies(SP.copy_groups(im, gt), gt).select("image_id", "copy_key", "keep")
    reason = MG.block_reason(F.col("image_id") % 37 == 0, F.col("image_id") % 41 == 0, F.lit(False))
    rows = im.join(picked, "image_id", "left").withColumn("keep", F.coalesce("keep", F.lit(True))).withColumn("reason", reason)
    return MG.plan_merge(rows, ["set2"], "s39")


@query("plan_merge", f"WITH {PLAN} SELECT file_name, target_split, merged_name, drop_reason FROM planned")
def plan_merge(spark, d):
    return _planned(spark, d).select("file_name", "target_split", "merged_name", "drop_reason")


@query("merge_report", f"""WITH {PLAN}, c AS (SELECT dataset, target_split, drop_reason, count(*) AS n FROM planned GROUP BY ALL)
SELECT dataset, target_split, coalesce(sum(n) FILTER (drop_reason IS NULL), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (drop_reason IS NOT NULL), 0)::BIGINT AS dropped,
  coalesce(string_agg(drop_reason || '=' || n, ',' ORDER BY drop_reason || '=' || n) FILTER (drop_reason IS NOT NULL), '') AS reasons FROM c GROUP BY ALL""")
def merge_report(spark, d):
    return MG.merge_report(_planned(spark, d))


@query("drop_exact", f"""WITH {PLAN}, p AS (SELECT *, sha256(source_name || status) AS sha FROM planned WHERE drop_reason IS NULL)
SELECT merged_name, target_split FROM p QUALIFY target_split <> 'train' OR row_number() OVER (PARTITION BY target_split, sha ORDER BY merged_name) = 1""")
def drop_exact(spark, d):
    kept = _planned(spark, d).filter("drop_reason is null").withColumn("sha256", F.sha2(F.concat("source_name", "status"), 256))
    return MG.drop_exact(kept, "sha256").select("merged_name", "target_split")


@query("same_scene", f"""WITH {S.SQL['frames']}, held AS (SELECT recording, min(frame) AS f FROM frames WHERE frame >= 50 AND recording LIKE 'rec%7' GROUP BY 1)
SELECT file_name FROM frames a WHERE EXISTS (SELECT 1 FROM held h WHERE h.recording = a.recording AND a.frame >= f - 5)""")
def same_scene(spark, d):
    told = MG.read_scenes(S.frames(spark, d).select("file_name", F.col("file_name").alias("source_name")), [("a", r"(?P<recording>.+)_(?P<frame>\d+)\.jpg", True)])
    told = told.withColumn("dataset", F.col("scene_dataset"))
    return MG.same_scene(told, told.filter("frame >= 50 and recording like 'rec%7'"), 5).select("file_name")


# ---- statistics --------------------------------------------------------------------------------


@query("split_stats", f"""WITH {COPIES}, s AS (SELECT *, 1280 + 10 * (image_id % 2) AS width, 960 AS height FROM im),
b AS (SELECT gt.image_id, count(*) AS n, count(*) FILTER (w * h / (width * height) < 0.0025) AS sm, count(*) FILTER (w * h / (width * height) >= 0.0025 AND w * h / (width * height) < 0.0052) AS md,
  count(*) FILTER (w * h / (width * height) >= 0.0052) AS lg, count(*) FILTER (w <= 0 OR h <= 0 OR x < -1 OR y < -1 OR x + w > width + 1 OR y + h > height + 1) AS bad FROM gt JOIN s USING (image_id) GROUP BY 1),
r AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(sm, 0) AS sm, coalesce(md, 0) AS md, coalesce(lg, 0) AS lg, coalesce(bad, 0) AS bad FROM s LEFT JOIN b USING (image_id)),
t AS (SELECT dataset, split, width || 'x' || height AS res, count(*) AS c FROM r GROUP BY ALL),
t2 AS (SELECT dataset, split, count(*) AS resolutions, min({{'m': -c, 'r': res}}) AS m FROM t GROUP BY ALL)
SELECT dataset, split, count(*) AS images, count(DISTINCT source_name) AS source_images, sum(n)::BIGINT AS boxes, count(*) FILTER (n = 0) AS zero_label_images, round(avg(n), 6) AS boxes_mean,
  median(n)::DOUBLE AS boxes_median, max(n) AS boxes_max, min(width)::BIGINT AS width_min, max(width)::BIGINT AS width_max, min(height)::INT AS height_min, max(height)::INT AS height_max, round(sum(sm) / sum(n), 6) AS small_share,
  round(sum(md) / sum(n), 6) AS medium_share, round(sum(lg) / sum(n), 6) AS large_share, sum(bad)::BIGINT AS invalid_boxes, any_value(resolutions) AS resolutions, any_value(m.r) AS top_resolution, any_value(-m.m) AS top_images
FROM r JOIN t2 USING (dataset, split) GROUP BY ALL""")
def split_stats(spark, d):
    im = _copy_images(spark, d).withColumn("width", 1280 + 10 * (F.col("image_id") % 2)).withColumn("height", F.lit(960))
    out = ST.split_stats(im, _gt(spark, d), 0.0025, 0.0052, 1)
    for c in ("boxes_mean", "small_share", "medium_share", "large_share"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("class_counts", f"WITH {COPIES} SELECT dataset, split, label, count(*) AS instances, count(DISTINCT image_id) AS images FROM gt JOIN im USING (image_id) GROUP BY ALL")
def class_counts(spark, d):
    return ST.class_counts(_copy_images(spark, d), _gt(spark, d))


@query("class_coverage", f"""WITH {COPIES}, c AS (SELECT dataset, split, label, count(*) AS instances, count(DISTINCT image_id) AS images FROM gt JOIN im USING (image_id) GROUP BY ALL),
g AS (SELECT DISTINCT dataset, split, label FROM im, (SELECT unnest(['fuel', 'robot', 'bumper']) AS label))
SELECT dataset, split, label, coalesce(instances, 0) AS instances, coalesce(images, 0) AS images, bool_or(coalesce(instances, 0) > 0) OVER (PARTITION BY dataset, label) AS labeled FROM g LEFT JOIN c USING (dataset, split, label)""")
def class_coverage(spark, d):
    return ST.class_coverage(_copy_images(spark, d), _gt(spark, d), ["fuel", "robot", "bumper"])


MAPPING = [("click", "fuel"), ("view", "DROP"), ("purchase", "robot"), ("A", "fuel"), ("N", "DROP"), ("R", "robot")]


@query("label_map", "SELECT l_orderkey AS image_id, CASE l_returnflag WHEN 'A' THEN 'fuel' ELSE 'robot' END AS label, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def label_map(spark, d):
    mapping = spark.createDataFrame(MAPPING, "label string, target string")
    boxes = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label"))
    ST.check_mapped(boxes, mapping)
    return ST.map_labels(boxes, mapping).groupBy("image_id", "label").agg(F.count("*").alias("n"))


@query("label_counts", f"WITH {COPIES} SELECT dataset, split, l_returnflag AS label, CASE l_returnflag WHEN 'A' THEN 'fuel' WHEN 'N' THEN 'DROP' ELSE 'robot' END AS target, count(*) AS instances FROM lineitem JOIN im ON im.image_id = l_orderkey GROUP BY ALL")
def label_counts(spark, d):
    boxes = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("label"))
    return ST.label_counts(_copy_images(spark, d), boxes, spark.createDataFrame(MAPPING, "label string, target string"))


@query("source_overlap", f"WITH {COPIES} SELECT dataset, source_name, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM im GROUP BY ALL HAVING count(DISTINCT split) > 1")
def source_overlap(spark, d):
    return ST.source_overlap(_copy_images(spark, d))


@query("one_per_source", f"WITH {COPIES}, f AS (SELECT dataset, split, source_name, min(file_name) AS file_name FROM im GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY file_name)::INT AS rank FROM f QUALIFY rank <= 9")
def one_per_source(spark, d):
    return ST.one_per_source(_copy_images(spark, d), 9)


# ---- diagnosis and thresholds ------------------------------------------------------------------


@query("slices", f"""WITH RECURSIVE {S.SQL['pd']}, {S.SQL['images']}, {MATCH}, per AS (SELECT image_id, priority, coalesce(nl, 0) AS nl, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM images
  LEFT JOIN (SELECT image_id, count(*) AS nl FROM gt GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS np FROM pd WHERE conf >= 0.5 GROUP BY 1) USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS tp FROM m WHERE same GROUP BY 1) USING (image_id)),
kk AS (SELECT *, 'all' AS "by", 'all' AS name FROM per UNION ALL SELECT *, 'priority', priority FROM per UNION ALL SELECT *, 'crowding', CASE WHEN nl >= 5 THEN '5 or more' WHEN nl >= 2 THEN '2 to 4' WHEN nl >= 1 THEN '1' ELSE '0' END FROM per)
SELECT "by", name, count(*) AS images, sum(nl)::BIGINT AS labeled, sum(tp)::BIGINT AS hits, (sum(np) - sum(tp))::BIGINT AS false_positives, (sum(nl) - sum(tp))::BIGINT AS misses,
  CASE WHEN sum(np) > 0 THEN round(sum(tp) / sum(np), 6) END AS precision, CASE WHEN sum(nl) > 0 THEN round(sum(tp) / sum(nl), 6) END AS recall, round((sum(np) - sum(tp)) / count(*), 6) AS fp_per_image FROM kk GROUP BY ALL""")
def slices(spark, d):
    gt, pd = _gt(spark, d), _pd(spark, d)
    n = gt.groupBy("image_id").agg(F.count("*").alias("n"))
    images = S.images(spark, d).join(n, "image_id", "left").fillna(0, ["n"])
    keys = D.slice_keys(images, {"priority": F.col("priority"), "crowding": B.count_bin(F.col("n"), [0, 1, 2, 5])})
    out = D.slice_scores(keys, gt, pd, M.match_boxes(gt, pd, 0.5))
    for c in ("precision", "recall", "fp_per_image"):
        out = out.withColumn(c, F.round(c, 6))
    return out


BUCKET = "CASE WHEN (x2 - x1) * (y2 - y1) / (1280.0 * 960) < 0.0025 THEN 'small' WHEN (x2 - x1) * (y2 - y1) / (1280.0 * 960) < 0.0052 THEN 'medium' ELSE 'large' END"


@query("size_rows", f"""WITH RECURSIVE {S.SQL['pd']}, {MATCH}, a AS (SELECT {BUCKET} AS bucket, count(*) AS labeled, count(m.label_ix) AS hits FROM gt LEFT JOIN m ON m.image_id = gt.image_id AND m.label_ix = gt.label_ix AND m.same GROUP BY 1),
b AS (SELECT {BUCKET} AS bucket, count(*) AS f FROM pd p WHERE conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = p.image_id AND m.pred_ix = p.pred_ix AND m.same) GROUP BY 1)
SELECT bucket, coalesce(labeled, 0) AS labeled, coalesce(hits, 0) AS hits, CASE WHEN labeled > 0 THEN round(hits / labeled, 6) END AS recall, coalesce(f, 0) AS false_positives
FROM (SELECT unnest(['small', 'medium', 'large']) AS bucket) LEFT JOIN a USING (bucket) LEFT JOIN b USING (bucket)""")
def size_rows(spark, d):
    gt, pd = _gt(spark, d), _pd(spark, d)
    return D.size_rows(S.images(spark, d), gt, pd, M.match_boxes(gt, pd, 0.5), 0.0025, 0.0052).withColumn("recall", F.round("recall", 6))


@query("feature_quantiles", """SELECT event_type, 'value' AS feature, unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS quantile, round(unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95])), 6) AS value FROM events GROUP BY 1""")
def feature_quantiles(spark, d):
    return D.feature_summary(S.table(spark, d, "events"), "event_type", ["value"], [0.05, 0.25, 0.5, 0.75, 0.95]).withColumn("value", F.round("value", 6))


@query("quantile_bins", """WITH e AS (SELECT list_transform(quantile_cont(value, [0.25, 0.5, 0.75]), lambda x: round(x, 1)) AS es FROM events)
SELECT event_id, len(list_filter(es, lambda c: c <= value))::INT AS bin FROM events, e""")
def quantile_bins(spark, d):
    events = S.table(spark, d, "events")
    edges = B.quantile_edges(events, "value", 4, round_=B.half_away)
    return events.select("event_id", B.bin_index(F.col("value"), F.array(*[F.lit(e) for e in edges])).alias("bin"))


@query("source_of", "SELECT page_id, CASE WHEN regexp_matches(url, 'blog') THEN 'blog' WHEN regexp_matches(url, '/(en|fr)/') THEN 'west' ELSE 'other' END AS source FROM pages")
def source_of(spark, d):
    return S.table(spark, d, "pages").select("page_id", N.first_source(F.col("url"), [("blog", "blog"), ("west", "/(?P<lang>en|fr)/")]).alias("source"))


@query("match_keys", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\.rf\.[0-9a-f]{32}', '', 'g'), '(?i)\.(?:jpe?g|png)$', ''), '(?i)_jpe?g$', '') AS key FROM (SELECT page_id, url || '_jpg.rf.0123456789abcdef0123456789abcdef.JPG' AS url FROM pages)")
def match_keys(spark, d):
    return S.table(spark, d, "pages").select("page_id", N.match_key(F.concat("url", F.lit("_jpg.rf.0123456789abcdef0123456789abcdef.JPG"))).alias("key"))


STEPS = X.threshold_range(0.05, 0.95, 0.01)
COST = S.greedy_sql("m", f"SELECT * FROM (SELECT *, unnest([{', '.join(map(str, STEPS))}])::DOUBLE AS t FROM ({PAIRS} WHERE l.label = 'fuel' AND p.label = 'fuel')) WHERE iou > 0.5 AND conf >= t", "image_id, t", "iou DESC, label_ix, pred_ix")
COSTS = f"""{S.SQL['pd']}, {S.SQL['images']}, {COST}, st AS (SELECT image_id, CASE WHEN unit IN ('u1', 'u2', 'u3', 'u4', 'u5') THEN 'near' ELSE 'far' END AS set_name FROM images),
g AS (SELECT unnest([{', '.join(map(str, STEPS))}])::DOUBLE AS threshold), ni AS (SELECT set_name, count(*) AS images FROM st GROUP BY 1),
nl AS (SELECT set_name, count(*) AS nl FROM gt JOIN st USING (image_id) WHERE label = 'fuel' GROUP BY 1),
np AS (SELECT set_name, threshold, count(*) AS np FROM pd JOIN st USING (image_id) JOIN g ON conf >= threshold WHERE label = 'fuel' GROUP BY ALL),
tp AS (SELECT set_name, t AS threshold, count(*) AS tp FROM m JOIN st USING (image_id) GROUP BY ALL),
costs AS (SELECT set_name, threshold, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, nl - coalesce(tp, 0) AS fn, images,
  (3 * (coalesce(np, 0) - coalesce(tp, 0)) + (nl - coalesce(tp, 0))) / images AS cost FROM ni CROSS JOIN g JOIN nl USING (set_name) LEFT JOIN np USING (set_name, threshold) LEFT JOIN tp USING (set_name, threshold)),
mean AS (SELECT threshold, avg(cost) AS cost FROM costs GROUP BY 1), best AS (SELECT threshold AS best, cost AS least FROM mean ORDER BY round(cost, 9), threshold DESC LIMIT 1)"""


def _costs(spark, d):
    near = F.when(F.col("unit").isin("u1", "u2", "u3", "u4", "u5"), "near").otherwise("far")
    sets = S.images(spark, d).select("image_id", near.alias("set_name"))
    return T.set_costs(_gt(spark, d), _pd(spark, d, None), sets, 0.5, STEPS, "fuel", 3, 1)


@query("threshold_costs", f"WITH RECURSIVE {COSTS} SELECT set_name, threshold, tp, fp, fn, images, round(cost, 6) AS cost FROM costs")
def threshold_costs(spark, d):
    return _costs(spark, d).withColumn("cost", F.round("cost", 6))


@query("pick_threshold", f"WITH RECURSIVE {COSTS} SELECT best AS threshold, round(least, 6) AS cost FROM best")
def pick_threshold(spark, d):
    return T.pick_threshold(T.mean_costs(_costs(spark, d))).withColumn("cost", F.round("cost", 6))


@query("flat_band", f"""WITH RECURSIVE {COSTS}, o AS (SELECT *, sum((cost > least * 1.5 + 1e-12)::INT) OVER (ORDER BY threshold) AS isle FROM mean, best)
SELECT min(threshold) AS low, max(threshold) AS high FROM o WHERE cost <= least * 1.5 + 1e-12 AND isle = (SELECT isle FROM o WHERE threshold = best)""")
def flat_band(spark, d):
    return T.flat_band(T.mean_costs(_costs(spark, d)), 0.5)


@query("held_out_parts", f"WITH {S.SQL['images']} SELECT CASE WHEN regexp_matches(unit, '^u1') THEN 'near' ELSE 'far' END AS part, count(*) AS images FROM images GROUP BY 1")
def held_out_parts(spark, d):
    return T.held_out_parts(S.images(spark, d), F.when(N.matches(F.col("unit"), "u1"), "near").otherwise("far"))


#: What each of 1,000 resamples draws.
TIMES = """us AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS ix, count(*) OVER () AS g FROM (SELECT DISTINCT unit FROM {units})),
times AS (SELECT resample, unit, count(*) AS times FROM (
  SELECT r.resample, ('0x' || substr(sha256('{seed}:' || r.resample || ':' || p.ix), 1, 12))::BIGINT % p.g AS place FROM (SELECT unnest(range(1000))::INT AS resample) r CROSS JOIN us p
) JOIN us ON us.ix = place GROUP BY ALL)"""
RECALLS = """n AS (SELECT unit, label, count(*) AS n FROM gt JOIN images USING (image_id) GROUP BY ALL), tp AS (SELECT unit, l_label AS label, count(*) AS tp FROM m JOIN images USING (image_id) GROUP BY ALL),
r AS (SELECT resample, label, sum(coalesce(tp, 0) * times) / sum(n * times) AS recall FROM n LEFT JOIN tp USING (unit, label) JOIN times USING (unit) GROUP BY ALL HAVING sum(n * times) > 0)"""


@query("bootstrap_recall", f"""WITH RECURSIVE {S.SQL['pd']}, {S.SQL['images']}, {SAME}, {TIMES.format(units='images', seed=2026)}, {RECALLS}
SELECT label, round(quantile_cont(recall, 0.025), 6) AS low, round(quantile_cont(recall, 0.975), 6) AS high FROM r GROUP BY 1""")
def bootstrap_recall(spark, d):
    gt, pd, units = _gt(spark, d), _pd(spark, d), S.images(spark, d).select("image_id", "unit")
    found = BS.recalls(BS.unit_facts(units, gt, M.match_same_class(gt, pd, 0.5)), BS.draw(units, 1000, "2026"))
    return BS.percentile_interval(found, "recall", 0.95, ["label"]).select("label", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# ---- review, reconciliation, runs --------------------------------------------------------------


@query("review_sample", "SELECT doc_id, source AS dataset, lang AS kind FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7:' || doc_id), doc_id) <= 3")
def review_sample(spark, d):
    items = S.table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("kind"))
    return D.review_sample(items, 3, "7", ["doc_id"])


@query("review_counts", "SELECT source AS dataset, lang AS kind, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS verdict, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def review_counts(spark, d):
    verdicts = S.table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("verdict"))
    sample = S.table(spark, d, "documents").join(verdicts, "doc_id", "left_semi").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("kind"))
    return D.review_counts(sample, verdicts, ["doc_id"], ["toxic", "good", "poor"])


EXPORT = f"""{COPIES}, ex AS (SELECT file_name, split, coalesce(h, '') AS h FROM im LEFT JOIN hist USING (image_id) ),
xp AS (SELECT CASE WHEN image_id % 43 = 0 THEN 'new' ELSE '' END || file_name AS source_name, CASE WHEN image_id % 31 = 0 THEN 'train' ELSE split END AS split, CASE WHEN image_id % 29 = 0 THEN '' ELSE coalesce(h, '') END AS h
  FROM im LEFT JOIN hist USING (image_id) WHERE image_id % 23 <> 0 UNION ALL SELECT file_name, split, coalesce(h, '') FROM im LEFT JOIN hist USING (image_id) WHERE image_id % 47 = 0 AND image_id % 43 <> 0),
kx AS (SELECT replace(source_name, '.rf.x.jpg', '') AS k, *, row_number() OVER (PARTITION BY source_name ORDER BY split, h) AS i FROM xp), ke AS (SELECT replace(file_name, '.rf.x.jpg', '') AS k, * FROM ex)"""


@query("reconcile_export", f"""WITH {EXPORT}
SELECT 'missing' AS problem, file_name AS name, split AS from_split, NULL AS to_split FROM ke WHERE NOT EXISTS (SELECT 1 FROM kx WHERE kx.k = ke.k)
UNION ALL SELECT 'extra', source_name, NULL, kx.split FROM kx LEFT JOIN ke ON ke.k = kx.k WHERE ke.k IS NULL OR i > 1
UNION ALL SELECT 'moved', file_name, ke.split, kx.split FROM kx JOIN ke ON ke.k = kx.k WHERE i = 1 AND kx.split <> ke.split
UNION ALL SELECT 'boxes_changed', file_name, ke.split, kx.split FROM kx JOIN ke ON ke.k = kx.k WHERE i = 1 AND kx.h <> ke.h""")
def reconcile_export(spark, d):
    gt, im = _gt(spark, d), _copy_images(spark, d)
    hist = gt.groupBy("image_id", "label").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("histogram"))
    none = F.array().cast("array<struct<label:string,n:bigint>>")
    full = im.join(hist, "image_id", "left").withColumn("histogram", F.coalesce("histogram", none))
    i = F.col("image_id")
    back = full.filter(i % 23 != 0).select(
        F.concat(F.when(i % 43 == 0, "new").otherwise(""), "file_name").alias("source_name"), F.when(i % 31 == 0, "train").otherwise(F.col("split")).alias("split"), F.when(i % 29 == 0, none).otherwise(F.col("histogram")).alias("histogram"),
    )
    twice = full.filter((i % 47 == 0) & (i % 43 != 0)).select(F.col("file_name").alias("source_name"), "split", "histogram")
    R.check_keys(full)
    return R.compare_export(full, back.union(twice))


@query("compare_sizes", """SELECT l_returnflag AS split, count(*) AS expected, (SELECT count(*) FROM lineitem x WHERE x.l_returnflag = l.l_returnflag AND l_linenumber > 1) AS reported FROM lineitem l GROUP BY 1""")
def compare_sizes(spark, d):
    li = S.table(spark, d, "lineitem")
    n = lambda df: df.groupBy(F.col("l_returnflag").alias("split")).agg(F.count("*").alias("n"))
    return R.compare_sizes(n(li), n(li.filter("l_linenumber > 1")))


@query("verify_manifest", """SELECT 'p' || page_id AS path, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'changed' END AS problem FROM pages WHERE page_id % 7 = 0 OR page_id % 5 = 0
UNION ALL SELECT 'q' || page_id, 'unlisted' FROM pages WHERE page_id % 11 = 0""")
def verify_manifest(spark, d):
    p = S.table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("path"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    i = F.col("page_id")
    found = p.filter(i % 7 != 0).withColumn("size", F.col("size") + F.when(i % 5 == 0, 1).otherwise(0)).drop("page_id")
    more = p.filter(i % 11 == 0).select(F.concat(F.lit("q"), "page_id").alias("path"), "size", "sha256")
    return R.verify_manifest(p, found.union(more))


@query("manifest_digest", """SELECT lang AS dir, count(*) AS n, sha256(string_agg(sha256(text) || '  ' || strlen(text) || '  ' || lang || '/' || doc_id, chr(10) ORDER BY lang || '/' || doc_id)) AS digest FROM documents GROUP BY 1""")
def manifest_digest(spark, d):
    docs = S.table(spark, d, "documents")
    return R.manifest_digest(docs.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256")))


@query("select_runs", """SELECT o_orderpriority AS model, o_orderstatus AS dataset, o_orderkey AS dir, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) = 1""")
def select_runs(spark, d):
    runs = S.table(spark, d, "orders").selectExpr("o_orderpriority model", "o_orderstatus dataset", "o_orderkey dir", "date_format(o_orderdate, 'yyyy-MM-dd') created", "o_custkey % 5 = 0 dirty", "o_orderkey % 3 = 0 sliced")
    return R.select_runs(runs, ["model", "dataset"]).select("model", "dataset", "dir", "created")


@query("grid_order", f"""WITH {COPIES} SELECT dataset, split, file_name, row_number() OVER (PARTITION BY dataset ORDER BY sha256('2026:' || dataset || '/' || split || '/' || file_name), split, file_name)::INT AS place
FROM im WHERE NOT regexp_matches(source_name, '^s1') QUALIFY place <= 16""")
def grid_order(spark, d):
    return ST.grid_order(_copy_images(spark, d), 16, "2026", exclude_pattern="s1")


@query("sheet_picks", f"""WITH {COPIES}, n AS (SELECT image_id, count(*) AS n FROM gt GROUP BY 1), r AS (SELECT im.*, coalesce(n, 0) AS n FROM im LEFT JOIN n USING (image_id)),
k AS (SELECT image_id, 'label ' || label AS kind FROM gt GROUP BY ALL UNION ALL SELECT image_id, CASE WHEN n = 0 THEN 'zero' ELSE 'dense' END FROM r),
o AS (SELECT dataset, kind, file_name, source_name, CASE WHEN kind = 'dense' THEN -n ELSE 0 END AS w FROM r JOIN k USING (image_id)),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY dataset, kind, source_name ORDER BY w, file_name) = 1)
SELECT dataset, kind, file_name, row_number() OVER (PARTITION BY dataset, kind ORDER BY w, file_name)::INT AS rank FROM f QUALIFY rank <= 12""".replace("\nk AS (SELECT image_id", "\nkk AS (SELECT image_id").replace("JOIN k USING", "JOIN kk USING"))
def sheet_picks(spark, d):
    return ST.sheet_picks(_copy_images(spark, d), _gt(spark, d), 12)


#: Areas of small, medium and large boxes.
SIZES = {"small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e18)}


def _sized_ap_sql() -> str:
    at = ", ".join(map(str, IOUS))
    z = "z AS (SELECT unnest(['small', 'medium', 'large']) AS size, unnest([0.0, 1024.0, 9216.0])::DOUBLE AS lo, unnest([1024.0, 9216.0, 1e18])::DOUBLE AS hi)"
    area = lambda a: f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) >= z.lo AND ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) < z.hi)"
    pairs = PAIRS.replace("p.conf,", f"p.conf, z.size, NOT {area('l')} AS out,").replace("SELECT l.image_id", "SELECT l.image_id", 1) + " CROSS JOIN z"
    walk = S.greedy_sql("m", f"SELECT * FROM (SELECT *, unnest([{at}])::DOUBLE AS iou_at FROM ({pairs} WHERE l.label = p.label)) WHERE iou >= iou_at", "image_id, l_label, size, iou_at", "conf DESC, pred_ix, out, iou DESC, label_ix")
    return f"""WITH RECURSIVE {S.SQL['pd']}, {z}, {walk}, f AS (
  SELECT z.size, g.iou_at, p.label, p.conf, p.image_id, p.pred_ix, CASE WHEN m.pred_ix IS NULL THEN 0 ELSE 1 END AS tp FROM pd p CROSS JOIN z CROSS JOIN (SELECT unnest([{at}])::DOUBLE AS iou_at) g
  LEFT JOIN m ON m.image_id = p.image_id AND m.pred_ix = p.pred_ix AND m.size = z.size AND m.iou_at = g.iou_at WHERE CASE WHEN m.pred_ix IS NULL THEN {area('p')} ELSE NOT m.out END
), c AS (SELECT *, sum(tp) OVER w AS ctp, count(*) OVER w AS cn FROM f WINDOW w AS (PARTITION BY size, iou_at, label ORDER BY conf DESC, image_id, pred_ix ROWS UNBOUNDED PRECEDING)
), h AS (SELECT *, max(ctp / cn) OVER (PARTITION BY size, iou_at, label ORDER BY conf, image_id DESC, pred_ix DESC ROWS UNBOUNDED PRECEDING) AS hull FROM c
), n AS (SELECT size, label, count(*) AS n FROM gt l, z WHERE {area('l')} GROUP BY ALL
), a AS (SELECT size, label, iou_at, sum(hull * (ctp * 100 // n - (ctp - 1) * 100 // n + CASE WHEN ctp = 1 THEN 1 ELSE 0 END)) / 101 AS ap FROM h JOIN n USING (size, label) WHERE tp = 1 GROUP BY ALL)
SELECT size, label, round(sum(coalesce(ap, 0)) / {len(IOUS)}, 6) AS ap FROM n LEFT JOIN a USING (size, label) GROUP BY ALL"""


@query("average_precision_by_size", _sized_ap_sql())
def average_precision_by_size(spark, d):
    ap = X.average_precision_of_areas(_gt(spark, d), _pd(spark, d, None), IOUS, SIZES)
    return ap.groupBy(F.col("area").alias("size"), "label").agg(X.round6(F.avg("ap")).alias("ap"))


import sightline.queries_jobs  # noqa: E402,F401  registers what runs whole jobs, sources and sinks
