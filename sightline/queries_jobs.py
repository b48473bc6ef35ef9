"""Registered queries of whole jobs, guards, sources and sinks, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import queries as Q
from sightline.config import Project, SplitMethod, build
from sightline.functions import bins as B
from sightline.operators import bootstrap as BS
from sightline.operators import diagnose as D
from sightline.operators import hamming as H
from sightline.operators import matching as M
from sightline.operators import metrics as X
from sightline.operators import splits as SP
from sightline.operators import stats as ST
from sightline.plans import jobs as J
from sightline.plans.store import fresh_path
from sightline.queries import query
from sightline.sources import coco, files
from sightline.sources import surrogate as S

DOCS, GT, PD, IMAGES = S.SQL["docs"], S.SQL["gt"], S.SQL["pd"], S.SQL["images"]

# ---- units, limits, leaks ----------------------------------------------------------------------

PATTERN = r"^(?P<recording>rec\d+)_(?P<frame>\d+)\.jpg$"


@query("image_units", f"""WITH RECURSIVE {Q.GROUPS}, {S.SQL['frames']}
SELECT 'none' AS method, file_name, file_name AS unit FROM docs UNION ALL SELECT 'grouped', file_name, unit FROM units UNION ALL SELECT 'temporal', file_name, recording FROM frames""")
def image_units(spark, d):
    docs = Q._images(spark, d).select("file_name", "source_name", "hash")
    frames = S.frames(spark, d).select("file_name", F.col("file_name").alias("source_name"), F.lit(0).cast("long").alias("hash"))
    cases = (("none", docs, None), ("grouped", docs, SplitMethod("grouped", "(?P<recording>no such name)")), ("temporal", frames, SplitMethod("temporal", PATTERN)))
    parts = [J.image_units(rows, method, 4).select(F.lit(name).alias("method"), "file_name", "unit") for name, rows, method in cases]
    J.check_units(parts[2], S.frames(spark, d).select("recording").distinct().count())
    return parts[0].union(parts[1]).union(parts[2])


@query("limited_images", f"WITH {DOCS} SELECT file_name, split FROM docs ORDER BY file_name LIMIT 25")
def limited_images(spark, d):
    return J.limited(S.hashed_documents(spark, d), 25).select("file_name", "split")


def _near(a: str, b: str) -> str:
    return f"(bit_count(xor({a}.hash, {b}.hash)) <= 4 OR bit_count(xor(xor({a}.hash, 255::UBIGINT), {b}.hash)) <= 4)"


def _views(df):
    return df.withColumn("views", F.array(F.col("hash"), F.col("hash").bitwiseXOR(F.lit(255).cast("long"))))


@query("near_held", f"""WITH {DOCS}, kept AS (SELECT * FROM docs WHERE dataset <> 'src1'), held AS (SELECT hash FROM kept WHERE split = 'test' UNION ALL SELECT hash FROM docs WHERE dataset = 'src1')
SELECT file_name FROM kept a WHERE split = 'train' AND EXISTS (SELECT 1 FROM held b WHERE {_near('a', 'b')})""")
def near_held(spark, d):
    docs = _views(S.hashed_documents(spark, d)).withColumn("target_split", F.col("split"))
    planned = docs.withColumn("drop_reason", F.when(F.col("dataset") == "src1", "protected"))
    return J.near_held(planned, docs.filter("dataset = 'src1'"), 4).select("file_name")


@query("field_matches", f"WITH {DOCS} SELECT file_name FROM docs a WHERE dataset <> 'src0' AND EXISTS (SELECT 1 FROM docs b WHERE b.dataset = 'src0' AND (a.text = b.text OR {_near('a', 'b')}))")
def field_matches(spark, d):
    docs = _views(S.hashed_documents(spark, d)).withColumnRenamed("content", "sha256")
    return J.field_matches(docs.filter("dataset <> 'src0'"), docs.filter("dataset = 'src0'"), 4)


@query("field_pairs", f"WITH {DOCS} SELECT a.file_name AS image, b.file_name AS field_image, bit_count(xor(a.hash, b.hash))::INT AS distance FROM docs a JOIN docs b ON a.dataset <> 'src0' AND b.dataset = 'src0' AND bit_count(xor(a.hash, b.hash)) <= 4")
def field_pairs(spark, d):
    docs = S.hashed_documents(spark, d)
    found = H.pairs_between(docs.filter("dataset <> 'src0'"), docs.filter("dataset = 'src0'"), 4, "file_name")
    return found.select(F.col("id_a").alias("image"), F.col("id_b").alias("field_image"), F.col("distance").cast("int").alias("distance"))


@query("pair_examples", f"""WITH {DOCS}, p AS ({Q.NEAR}), s AS (SELECT id_a, id_b, CASE WHEN a.dataset <> b.dataset THEN 'cross_dataset' WHEN a.split <> b.split THEN 'cross_split' ELSE 'within_split' END AS kind
FROM p JOIN docs a ON a.doc_id = id_a JOIN docs b ON b.doc_id = id_b) SELECT kind, id_a, id_b FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id_a, id_b) <= 3""")
def pair_examples(spark, d):
    docs = S.hashed_documents(spark, d)
    return H.pair_examples(H.near_pairs(docs, 4, "doc_id"), docs, "doc_id", 3)


@query("split_report", f"""WITH {Q.PLAN}, r AS (SELECT unnest(['source_name', 'same_scene', 'copy', 'excluded', 'near_test']) AS name)
SELECT 'dropped' AS section, name, '' AS other, (SELECT count(*) FROM planned WHERE drop_reason = name) AS n FROM r
UNION ALL SELECT 'from_source_split', split, CASE WHEN drop_reason IS NULL THEN target_split ELSE 'dropped' END, count(*) FROM planned GROUP BY ALL
UNION ALL SELECT 'copy_group_size', size::VARCHAR, '', count(*) FROM (SELECT count(*) AS size FROM planned WHERE ck IS NOT NULL GROUP BY ck) GROUP BY ALL""")
def split_report(spark, d):
    planned = Q._planned(spark, d).withColumnRenamed("drop_reason", "dropped").withColumn("source_split", F.col("split")).drop("split").withColumnRenamed("target_split", "split")
    return SP.split_report(planned, ["source_name", "same_scene", "copy", "excluded", "near_test"], "copy_key")


# ---- scoring -----------------------------------------------------------------------------------


@query("shared_classes", f"WITH {Q.COPIES} SELECT DISTINCT dataset, label FROM gt JOIN im USING (image_id) WHERE label IN ('robot', 'tree')")
def shared_classes(spark, d):
    return ST.shared_classes(Q._copy_images(spark, d), Q._gt(spark, d), ["robot", "tree"])


@query("aligned_predictions", f"WITH {PD}, {IMAGES} SELECT pd.image_id, pred_ix FROM pd JOIN images USING (image_id) WHERE unit = 'u7'")
def aligned_predictions(spark, d):
    images = S.images(spark, d)
    return files.align(images.filter("unit = 'u7'"), images.select("image_id"), Q._pd(spark, d, None)).select("image_id", "pred_ix")


@query("totals_differ", f"""WITH RECURSIVE {PD}, {Q.MATCH}, c AS (SELECT label, count(*) FILTER (true) AS nl FROM gt GROUP BY 1), t AS (SELECT l_label AS label, count(*) AS tp FROM m WHERE same GROUP BY 1)
SELECT label, tp, tp + 1 AS published_tp FROM c JOIN t USING (label) WHERE label = 'robot'""")
def totals_differ(spark, d):
    gt, pd = Q._gt(spark, d), Q._pd(spark, d)
    found = M.error_counts(gt, pd, M.match_boxes(gt, pd, 0.5))
    published = found.withColumn("tp", F.col("tp") + (F.col("label") == "robot").cast("int"))
    return D.totals_differ(found, published).select("label", "tp", F.col("p_tp").alias("published_tp"))


ITEMS = """items AS (
  SELECT image_id, 'false positive' AS kind, conf AS score, x1, y1 FROM pd p WHERE conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = p.image_id AND m.pred_ix = p.pred_ix)
  UNION ALL SELECT image_id, 'miss', 0.0, x1, y1 FROM gt g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = g.image_id AND m.label_ix = g.label_ix))"""


def _items(spark, d):
    gt, pd = Q._gt(spark, d), Q._pd(spark, d)
    return D.error_items(S.images(spark, d), gt, pd, M.match_boxes(gt, pd, 0.5))


@query("error_items", f"WITH RECURSIVE {PD}, {Q.MATCH}, {ITEMS} SELECT image_id, kind, round(score, 6) AS score, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM items")
def error_items(spark, d):
    return _items(spark, d).select("image_id", "kind", *[F.round(c, 6).alias(c) for c in ("score", "x1", "y1")])


@query("gallery_candidates", f"""WITH RECURSIVE {PD}, {IMAGES}, {Q.MATCH}, {ITEMS}, s AS (SELECT image_id, kind, unit AS source, max(score) AS score, count(*) AS n FROM items JOIN images USING (image_id) GROUP BY ALL),
w AS (SELECT *, CASE WHEN kind = 'miss' THEN -n::DOUBLE ELSE -score END AS weight FROM s),
gk AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY weight, image_id) AS depth FROM w QUALIFY depth <= 2),
l AS (SELECT *, first_value(weight) OVER v AS lw, first_value(image_id) OVER v AS li FROM gk WINDOW v AS (PARTITION BY kind, source ORDER BY weight, image_id))
SELECT kind, image_id, source, row_number() OVER (PARTITION BY kind ORDER BY depth, lw, li)::INT AS rank FROM l""")
def gallery_candidates(spark, d):
    told = _items(spark, d).join(S.images(spark, d).select("image_id", F.col("unit").alias("source")), "image_id").withColumn("frame", F.lit(None).cast("long"))
    return D.gallery_candidates(told, 2).select("kind", "image_id", "source", "rank")


AP = Q._ap_sql(Q.IOUS).removeprefix(f"WITH RECURSIVE {PD}, ")


@query("split_metrics", f"""WITH RECURSIVE {PD}, {Q.SAME}, ap AS (WITH RECURSIVE {AP}), s AS (SELECT label, avg(ap) AS map, max(ap) FILTER (iou_at = 0.5) AS map50 FROM ap GROUP BY 1)
SELECT label, tp, np - tp AS fp, nl - tp AS fn, round(tp / np, 6) AS precision, round(tp / nl, 6) AS recall, round(map50, 4) AS map50, round(map, 4) AS map50_95 FROM (SELECT label, count(*) AS nl FROM gt GROUP BY 1)
JOIN (SELECT label, count(*) AS np FROM pd WHERE conf >= 0.5 GROUP BY 1) USING (label) JOIN (SELECT l_label AS label, count(*) AS tp FROM m GROUP BY 1) USING (label) JOIN s USING (label)""")
def split_metrics(spark, d):
    gt, pd = Q._gt(spark, d), Q._pd(spark, d, None)
    ap = X.average_precision(gt, pd, Q.IOUS).withColumn("ap", X.round6("ap")).groupBy("label").agg(F.max(F.when(F.col("iou_at") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    own = X.precision_recall(gt, M.above(pd, 0.5), 0.5).join(ap, "label")
    return own.select("label", "tp", "fp", "fn", X.round6("precision").alias("precision"), X.round6("recall").alias("recall"), F.round("map50", 4).alias("map50"), F.round("map50_95", 4).alias("map50_95"))


@query("bootstrap_map50")
def bootstrap_map50(spark, d):
    """1,000 resamples of the units; tests compare with repeated rows."""
    gt, pd, units = Q._gt(spark, d), Q._pd(spark, d, None), S.images(spark, d).select("image_id", "unit")
    ap = BS.average_precisions(X.score_order(gt, pd, [0.5]), gt, units, BS.draw(units, 1000, "2026"))
    return BS.percentile_interval(ap, "ap", 0.95, ["label"]).select("label", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("slice_features", f"""WITH RECURSIVE {PD}, {IMAGES}, {Q.MATCH}, f AS (SELECT o_orderkey AS image_id, o_totalprice::DOUBLE AS brightness FROM orders),
e AS (SELECT list_transform(quantile_cont(brightness, [0.25, 0.5, 0.75]), lambda x: round(x, 1)) AS es FROM f),
per AS (SELECT image_id, unit, brightness, coalesce(nl, 0) AS nl, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM images JOIN f USING (image_id)
  LEFT JOIN (SELECT image_id, count(*) AS nl FROM gt GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS np FROM pd WHERE conf >= 0.5 GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS tp FROM m WHERE same GROUP BY 1) USING (image_id)),
kk AS (SELECT *, 'all' AS "by", 'all' AS name FROM per UNION ALL SELECT *, 'brightness', 'bin ' || (SELECT len(list_filter(es, lambda c: c <= brightness)) FROM e) FROM per
  UNION ALL SELECT *, 'has label', CASE WHEN nl > 0 THEN 'yes' ELSE 'no' END FROM per UNION ALL SELECT *, 'source', CASE WHEN regexp_matches(unit, '^u1') THEN 'ones' WHEN regexp_matches(unit, '^u2') THEN 'twos' ELSE 'other' END FROM per)
SELECT "by", name, count(*) AS images, sum(nl)::BIGINT AS labeled, sum(tp)::BIGINT AS hits, (sum(np) - sum(tp))::BIGINT AS false_positives FROM kk GROUP BY ALL""")
def slice_features(spark, d):
    gt, pd = Q._gt(spark, d), Q._pd(spark, d)
    n = gt.groupBy("image_id").agg(F.count("*").alias("n"))
    told = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_totalprice").cast("double").alias("brightness"))
    images = S.images(spark, d).join(told, "image_id").join(n, "image_id", "left").fillna(0, ["n"])
    edges = B.quantile_edges(told, "brightness", 4, round_=B.half_away)
    name = F.concat(F.lit("bin "), B.bin_index(F.col("brightness"), F.array(*[F.lit(e) for e in edges])).cast("string"))
    from sightline.functions.names import first_source

    keys = {"brightness": name, "has label": F.when(F.col("n") > 0, "yes").otherwise("no"), "source": first_source(F.col("unit"), [("ones", "u1"), ("twos", "u2")])}
    out = D.slice_scores(D.slice_keys(images, keys), gt, pd, M.match_boxes(gt, pd, 0.5))
    return D.checked_slices(out).select("by", "name", "images", "labeled", "hits", "false_positives")


@query("choose_threshold", f"""WITH RECURSIVE {Q.COSTS}, o AS (SELECT *, sum((cost > least * 1.05 + 1e-12)::INT) OVER (ORDER BY threshold) AS isle FROM mean, best),
band AS (SELECT min(threshold) AS low, max(threshold) AS high FROM o WHERE cost <= least * 1.05 + 1e-12 AND isle = (SELECT isle FROM o WHERE threshold = best)),
held AS (SELECT * FROM images WHERE regexp_matches(unit, '^u1')), {Q.TIMES.format(units="held", seed=7)},
hn AS (SELECT unit, count(*) AS n FROM gt JOIN held USING (image_id) WHERE label = 'fuel' GROUP BY 1), htp AS (SELECT unit, count(*) AS tp FROM m JOIN held USING (image_id), best WHERE t = best GROUP BY 1),
r AS (SELECT resample, sum(coalesce(tp, 0) * times) / sum(n * times) AS recall FROM hn LEFT JOIN htp USING (unit) JOIN times USING (unit) GROUP BY 1 HAVING sum(n * times) > 0)
SELECT best AS threshold, round(least, 6) AS cost, low AS band_low, high AS band_high, 0.5::DOUBLE AS neutral_threshold, (SELECT round(cost, 6) FROM mean WHERE threshold = 0.5) AS neutral_cost,
  (SELECT round(quantile_cont(recall, 0.025), 6) FROM r) AS recall_low, (SELECT round(quantile_cont(recall, 0.975), 6) FROM r) AS recall_high FROM best, band""")
def choose_threshold(spark, d):
    images = S.images(spark, d)
    near = F.when(F.col("unit").isin("u1", "u2", "u3", "u4", "u5"), "near").otherwise("far")
    held = images.filter(F.startswith("unit", F.lit("u1"))).select("image_id")
    project = build(Project, {"seed": 7})
    out = J.choose_threshold(Q._gt(spark, d), Q._pd(spark, d, None), images.select("image_id", near.alias("set_name")), held, images.select("image_id", "unit"), project, "fuel")
    for c in ("cost", "neutral_cost", "recall_low", "recall_high"):
        out = out.withColumn(c, F.round(c, 6))
    return out


# ---- files -------------------------------------------------------------------------------------


@query("coco_round_trip", f"""WITH {Q.COPIES}, b AS (SELECT split, file_name, label, x, y, w, h FROM gt JOIN im USING (image_id))
SELECT im.split, im.file_name, im.source_name, count(b.label) AS boxes, round(coalesce(sum(w * h), 0), 3) AS area, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels FROM im LEFT JOIN b USING (file_name) GROUP BY ALL""")
def coco_round_trip(spark, d):
    """The images and boxes as COCO files, one a split, written and scanned."""
    folder = fresh_path(spark, "coco")
    images = Q._copy_images(spark, d).withColumn("width", F.lit(S.WIDTH)).withColumn("height", F.lit(S.HEIGHT))
    coco.write_splits(images, Q._gt(spark, d), ["fuel", "robot"], folder)
    back, boxes = coco.scan(spark, folder, "set", ("train", "valid", "test"))
    per = boxes.groupBy("image_id").agg(F.count("*").alias("boxes"), F.sum(F.col("w") * F.col("h")).alias("area"), F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    out = back.join(per, "image_id", "left").fillna(0, ["boxes"]).fillna(0.0, ["area"]).fillna("", ["labels"])
    return out.select("split", "file_name", "source_name", "boxes", F.round("area", 3).alias("area"), "labels")


@query("cache_round_trip", f"""WITH {PD}, p AS (SELECT image_id, label, conf FROM pd WHERE conf >= 0.1 QUALIFY row_number() OVER (PARTITION BY image_id, label ORDER BY conf DESC, pred_ix) <= 3)
SELECT 'i' || image_id AS image_id, label, count(*) AS n, round(sum(conf), 6) AS conf FROM p GROUP BY ALL""")
def cache_round_trip(spark, d):
    """Predictions through a cache file: floor, the best of each image and class, written and read."""
    path = fresh_path(spark, "cache") + "/predictions.json"
    named = lambda df: df.withColumn("image_id", F.concat(F.lit("i"), F.col("image_id").cast("string")))
    files.write_predictions(named(Q._pd(spark, d, None)), named(S.images(spark, d)).select("image_id"), path, 0.1, 3, 1 << 32)
    back, _ = files.read_predictions(spark, path)
    return back.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("conf"))


@query("csv_round_trip", f"WITH {Q.COPIES} SELECT dataset, split, count(*) AS n, '\"' || dataset || '\", ' || split AS note FROM im GROUP BY ALL")
def csv_round_trip(spark, d):
    path = fresh_path(spark, "csv") + "/counts.csv"
    counts = Q._copy_images(spark, d).groupBy("dataset", "split").agg(F.count("*").alias("n"))
    told = counts.withColumn("note", F.concat(F.lit('"'), "dataset", F.lit('", '), "split"))
    files.write_csv(told, path, ["dataset", "split"])
    return spark.read.schema("dataset string, split string, n long, note string").option("header", True).option("escape", "\\").csv(path)


@query("file_manifest", "SELECT lang || '.txt' AS path, strlen(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) + 1 AS size, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY lang")
def file_manifest(spark, d):
    """One file a language with its document ids, and the manifest of the folder."""
    folder = fresh_path(spark, "listed")
    docs = S.table(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("line"))
    for lang in [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]:
        files.write_lines(docs.filter(F.col("lang").eqNullSafe(lang)), ["doc_id"], f"{folder}/{lang}.txt")
    return files.manifest(spark, folder).filter(~F.endswith("path", F.lit(".crc")))


@query("unsourced_numbers", """WITH e AS (SELECT event_type, event_id, user_id, value::DECIMAL(18, 2)::VARCHAR AS v FROM events), known AS (SELECT DISTINCT v FROM e WHERE event_type = (SELECT min(event_type) FROM e))
SELECT event_type AS path, event_id AS line, v AS number FROM e WHERE v NOT IN (SELECT v FROM known) UNION ALL SELECT event_type, event_id, user_id || '%' FROM e""")
def unsourced_numbers(spark, d):
    """Lines with a number that may have a source, a share that has none, and what doesn't count: code, a link target, a version."""
    from sightline.report import unsourced_numbers as audit

    events = S.table(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,2)").cast("string"))
    text = F.concat(F.lit("took "), "v", F.lit("ms (`"), "v", F.lit("`), "), F.col("user_id").cast("string"), F.lit("% in v1.2.3, see [x](a/9.75)."))
    lowest = events.agg(F.min("event_type")).first()[0]
    sources = events.filter(F.col("event_type") == lowest).select(F.lit("s").alias("path"), F.lit(1).alias("line"), F.concat(F.lit('{"x": '), "v", F.lit("}")).alias("text"))
    return audit(events.select(F.col("event_type").alias("path"), F.col("event_id").alias("line"), text.alias("text")), sources)
