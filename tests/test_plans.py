from __future__ import annotations

import json
import logging
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline import config, queries, report
from sightline.functions import bins, geometry, names
from sightline.operators import matching, stats
from sightline.plans import indexing, jobs, store
from sightline.streaming import score

from .test_matching import A, B, C, FAR, frames, scene

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("told", [
    {"area_buckets": {"small_max": 0.3, "medium_max": 0.2}}, {"splits": {"fractions": {"train": 0.5, "valid": 0.2, "test": 0.2}}}, {"splits": {"datasets": {"a": {"method": "temporal", "recording_pattern": "(?P<recording>.+)"}}}},
    {"splits": {"datasets": {"a": {"method": "grouped", "recording_pattern": "("}}}}, {"merge": {"sources": {"a": {"role": "train_only"}}}}, {"merge": {"sources": {"a": {"role": "keep_splits"}}, "protected": ["a"]}},
    {"evaluate": {"confidence_floor": 0.6}}, {"diagnose": {"crowding": [1, 2]}}, {"diagnose": {"crowding": [0, 3, 3]}}, {"threshold": {"tuning": ["a"], "held_out": ["a"]}}, {"threshold": {"grid": {"start": 0.001, "stop": 0.9, "step": 0.1}}},
    {"nonsense": 1}, {"seed": "7"}, {"splits": {"min_recording_images": 2}}, {"near_distance": 65}, [],
])
def test_inconsistent_settings_raise(told):
    with pytest.raises(config.ConfigError):
        config.build(config.Project, told)


def test_settings_load_and_name_their_file(tmp_path):
    path = tmp_path / "project.json"
    path.write_text(json.dumps({"seed": 7, "splits": {"datasets": {"a": {"method": "grouped", "recording_pattern": "^(?P<recording>x)"}}}, "evaluate": {"edge": {"classes": ["fuel"], "tolerance_px": 1}}}))
    p = config.load(path)
    assert p.seed == 7 and p.splits.datasets["a"].method == "grouped" and p.evaluate.edge.classes == ("fuel",) and p.evaluate.edge.tolerance_px == 1.0
    assert len(p.threshold.grid.values) == 91 and p.threshold.grid.values[3] == 0.08
    for text in ("{", '{"oops": 1}'):
        path.write_text(text)
        with pytest.raises(config.ConfigError, match="project.json"):
            config.load(path)
    with pytest.raises(config.ConfigError, match="can't read"):
        config.load(tmp_path / "none.json")
    config.check_targets({"a": "fuel", "b": "DROP"}, ["fuel"])
    with pytest.raises(config.ConfigError, match="unknown targets"):
        config.check_targets({"a": "fule"}, ["fuel"])


def test_marked_parts_and_tables(spark, tmp_path):
    assert report.replace_marked("a<s>old<e>b", "<s>", "<e>", "new") == "a<s>\nnew\n<e>b"
    for bad in ("a<s>b", "<e><s>", "<s><s><e>"):
        with pytest.raises(ValueError):
            report.replace_marked(bad, "<s>", "<e>", "x")
    path = tmp_path / "r.md"
    path.write_text("<s>\n<e>")
    assert report.write_marked(path, "<s>", "<e>", "x") and not report.write_marked(path, "<s>", "<e>", "x")
    df = spark.createDataFrame([("b", 0.12345), ("a", None)], "name string, v double")
    assert report.table(df, ["name"]) == "| name | v |\n| --- | --- |\n| a | - |\n| b | 0.123 |"
    with pytest.raises(ValueError, match="more than 1"):
        report.table(df, ["name"], limit=1)
    assert (report.rounded(2.675, 2), report.rounded(0.0625, 3), report.rounded(None)) == (2.67, 0.062, None)


def test_provenance_and_redaction(tmp_path):
    (tmp_path / "f").write_text("x")
    told = report.provenance(tmp_path, ["pyspark", "no-such-package"], [tmp_path / "f"])
    assert told["packages"]["pyspark"] and told["packages"]["no-such-package"] is None and len(next(iter(told["files"].values()))) == 64
    record = logging.LogRecord("n", 20, "p", 1, "key=%s", ("s3cret",), None)
    report.Redactor("s3cret").filter(record)
    assert record.getMessage() == "key=***" and report.Redactor(None)("s3cret") == "s3cret"


def test_names_and_bins(spark):
    df = spark.createDataFrame([("cam_0012.jpg",), ("xcam_1.jpg",), ("none",)], "n string")
    got = [tuple(r) for r in df.select(names.group_of(F.col("n"), r"(?P<recording>cam)_(?P<frame>\d+)\.jpg", "frame"), names.matches(F.col("n"), "cam"), names.first_source(F.col("n"), [("x", "xc"), ("c", "am_")])).collect()]
    assert got == [("0012", True, "c"), (None, False, "x"), (None, False, "other")]
    keys = spark.createDataFrame([("x_jpg.rf." + "a" * 32 + ".jpg",), ("x_png.rf." + "a" * 32 + ".JPG",), ("y.jpeg",), ("z_JPG.png",), ("q.rf.short.jpg",)], "n string")
    assert [r[0] for r in keys.select(names.match_key(F.col("n"))).collect()] == ["x", "x_png", "y", "z", "q.rf.short"]
    nums = spark.range(1, 11).withColumn("v", F.col("id").cast("double"))
    named = nums.select(bins.value_bin(F.col("v"), [2.5, 7.0]).alias("b"), bins.value_bin(F.col("v"), []).alias("a")).collect()
    assert [r["b"] for r in named] == ["below 2.5"] * 2 + ["2.5 to 7.0"] * 4 + ["7.0 and above"] * (len(named) - 6) and {r["a"] for r in named} == {"all"}
    assert bins.quantile_edges(nums, "v", 4) == [3.2, 5.5, 7.8]
    assert [r[0] for r in nums.filter("id in (3, 5, 6)").select(bins.count_bin(F.col("id"), [0, 4, 6])).collect()] == ["0 to 3", "4 to 5", "6 or more"]
    with pytest.raises(ValueError):
        bins.quantile_edges(nums.limit(0), "v", 4)


def _with_table(folder, tmp_path, spark, name, values, column):
    for file in os.listdir(folder):
        os.symlink(f"{folder}/{file}", tmp_path / file)
    own = spark.read.parquet(f"{folder}/{name}.parquet").limit(len(values)).toPandas()
    own[column] = values
    (tmp_path / f"{name}.parquet").unlink()
    own.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{tmp_path}/{file}'")
    return con


#: Their quartiles are 12.25, 20.25 and 30.45, halves to one decimal, and so are values between rounded edges.
HALVES = [1.0, 12.25, 12.2, 12.25, 20.2, 20.25, 20.25, 30.4, 30.45, 30.5, 50.0, 12.25, 30.45]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_bins_of_halves_equal_sql(spark, tmp_path):
    con = _with_table(FOLDER, tmp_path, spark, "events", HALVES, "value")
    got = queries.QUERIES["quantile_bins"](spark, str(tmp_path)).select("event_id", "bin").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["quantile_bins"]).fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_slices_of_halves_equal_sql(spark, tmp_path):
    con = _with_table(FOLDER, tmp_path, spark, "orders", HALVES, "o_totalprice")
    got = queries.QUERIES["slice_features"](spark, str(tmp_path)).select("by", "name", "images", "labeled", "hits", "false_positives").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["slice_features"]).fetchall())


def test_quantiles_equal_duckdb_to_the_last_bit(spark):
    con = duckdb.connect()
    for values in ([929.68] * 3, [27.26, 27.57], [143.44, 143.76, 143.76], [-0.05, -0.15, -0.25, -0.35]):
        told = con.execute("select list_transform(quantile_cont(x, [0.25, 0.5, 0.75]), lambda q: [q, round(q, 1)]) from (select unnest(?::DOUBLE[]) as x)", [values]).fetchone()[0]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert [bins.quantile_edges(df, "v", 4, round_=lambda q, _: q), bins.quantile_edges(df, "v", 4, round_=bins.half_away)] == [list(x) for x in zip(*told, strict=True)]


def test_geometry_edges(spark):
    row = spark.range(1).select(
        geometry.iou(*[tuple(F.lit(float(v)) for v in b) for b in ((0, 0, 0, 0), (0, 0, 0, 0))]).alias("none"),
        geometry.area_bucket(F.lit(5.0), F.lit(5.0), F.lit(100.0), F.lit(100.0), 0.0025, 0.0225).alias("edge"),
        geometry.is_invalid(F.lit(0.0), F.lit(0.0), F.lit(11.0), F.lit(5.0), F.lit(10.0), F.lit(10.0), 1).alias("fits"),
        geometry.crop(tuple(F.lit(float(v)) for v in (0, 0, 10, 4)), F.lit(100.0), F.lit(100.0), 2.0, 8.0).alias("crop"),
    ).first()
    assert row["none"] == 0.0 and row["edge"] == "medium" and row["fits"] is False and tuple(row["crop"]) == (0.0, 0.0, 15.0, 12.0)


def test_positions_are_global(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    got = [r["k"] for r in indexing.with_index(df, "n", "k").orderBy("n").collect()]
    assert got == sorted(got) and indexing.with_index(df, "n", "k").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (0, 999, 1000)
    assert store.shared_dir(spark).startswith("file:")


def test_scoring_a_stream_equals_batch(spark, tmp_path):
    labels, preds = scene(11, 20)
    gt, pd = frames(spark, labels, preds)
    side = lambda df, *c: df.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(c[0], F.struct(*c[1:]).alias("b")))), lambda x: x["b"]))
    a = side(gt, "label_ix", "label", "x1", "y1", "x2", "y2").toDF("image_id", "labels")
    b = side(pd, "pred_ix", "label", "conf", "x1", "y1", "x2", "y2").toDF("image_id", "preds")
    rows = a.join(b, "image_id", "full_outer").select("image_id", F.coalesce("labels", F.array().cast(score.BOXES)).alias("labels"), F.coalesce("preds", F.array().cast(score.PREDICTIONS)).alias("preds"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = score.score(stream, 0.5, 0.4).writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("scores").agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    hot = matching.above(pd, 0.5)
    want = matching.error_counts(gt, hot, matching.match_boxes(gt, hot, 0.4)).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert tuple(got) == tuple(want)


def test_scores_and_intervals_of_a_split(spark):
    labels = [("1", 0, "fuel", A), ("1", 1, "robot", B), ("2", 0, "fuel", C)]
    preds = [("1", 0, "fuel", 0.9, A), ("1", 1, "robot", 0.8, B), ("2", 0, "fuel", 0.7, C), ("2", 1, "tree", 0.9, FAR)]
    gt, pd = frames(spark, labels, preds)
    out = jobs.score(gt, pd, ["fuel", "robot"], 0.5, 0.5, [0.5, 0.85])
    per = {r["label"]: r for r in out["per_class"].collect()}
    assert per["fuel"]["map50"] == per["fuel"]["map50_95"] == per["robot"]["recall"] == 1.0 and per["fuel"]["small_map50_95"] == 1.0 and per["fuel"]["large_map50_95"] is None
    assert out["overall"].first()["map50"] == 1.0 and out["curve"].count() == 4
    units = spark.createDataFrame([("1", "a"), ("2", "b")], "image_id string, unit string")
    from sightline.operators import bootstrap

    got = jobs.intervals(gt, pd, units, 0.5, bootstrap.draw(units, 20, "1"), 0.95).collect()
    assert {(r["label"], r["metric"]) for r in got} == {(c, m) for c in ("fuel", "robot") for m in ("recall", "map50")} and all(r["low"] == r["high"] == 1.0 for r in got)


def test_harmonize_and_merge(spark):
    project = config.build(config.Project, {"near_distance": 1, "splits": {"buffer_frames": 1, "min_recording_images": 5}, "merge": {"sources": {"alpha": {"role": "keep_splits"}, "beta": {"role": "train_only", "dedupe_copies": True}}, "protected": ["lock"]}})
    rows = [("alpha", "train", f"{n:03d}.jpg", f"cam_{n}.jpg", f"a{n}", (n * 0x9E3779B97F4A7C15) % (1 << 62)) for n in range(30)]
    images = spark.createDataFrame(rows, "dataset string, split string, file_name string, source_name string, image_id string, hash long")
    boxes = images.select("image_id", F.lit("ball").alias("label"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    mapping = spark.createDataFrame([("ball", "fuel")], "label string, target string")
    method = config.SplitMethod("temporal", r"^(?P<recording>.+)_(?P<frame>\d+)\.jpg$")
    out = jobs.harmonize(images, boxes, mapping, method, project)
    sizes = {r["split"]: (r["images"], r["dropped"]) for r in out["summary"].collect()}
    assert sizes == {"train": (20, 1), "valid": (3, 1), "test": (5, 0)} and {r["label"] for r in out["boxes"].collect()} == {"fuel"}
    with pytest.raises(stats.UnmappedLabel):
        jobs.harmonize(images, boxes, mapping.limit(0), method, project)
    for m in ("grouped", "eval_only"):
        again = jobs.harmonize(images, boxes, mapping, config.SplitMethod(m, r"^(?P<recording>cam_\d)", dedupe_copies=m == "grouped"), project)
        assert again["images"].count() > 0

    kept = out["images"].select("dataset", "split", "file_name", "source_name", "image_id", F.array("hash").alias("views")).withColumn("sha256", F.sha2("image_id", 256))
    h = {r["image_id"]: r["views"][0] for r in kept.collect()}
    test = next(r["image_id"] for r in kept.filter("split = 'test'").collect())
    beta = [("beta", "train", "1.jpg", "other1", "b1", [77, h[test] ^ 1], "s1"), ("beta", "train", "2.jpg", "cam_29.jpg", "b2", [1 << 33], "s2"), ("beta", "train", "3.jpg", "lockname", "b3", [1 << 41], "s3"), ("beta", "train", "4.jpg", "free", "b4", [1 << 51], "s4"), ("beta", "train", "5.jpg", "free", "b5", [1 << 57], "s5"), ("beta", "train", "6.jpg", "own", "b6", [3 << 44], "s4")]
    both = kept.unionByName(spark.createDataFrame(beta, "dataset string, split string, file_name string, source_name string, image_id string, views array<long>, sha256 string"))
    lock = spark.createDataFrame([("lockname", [0b10101 << 57])], "source_name string, views array<long>")
    held = spark.createDataFrame([("alpha", "cam", 22)], "dataset string, recording string, frame long")
    plan = jobs.merge_sources(both, both.select("image_id", F.lit("fuel").alias("label"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h")), lock, held, [("alpha", method.recording_pattern, True)], project)
    why = {r["file_name"]: r["drop_reason"] for r in plan.filter("dataset = 'beta'").collect()}
    assert why == {"1.jpg": "near_protected", "2.jpg": "source_name", "3.jpg": "source_name", "4.jpg": None, "5.jpg": "copy", "6.jpg": "exact_duplicate"}
    assert plan.filter("dataset = 'alpha' and drop_reason is not null").count() == 0
    with pytest.raises(jobs.HeldOutLeak):
        jobs.check_train_apart(plan.withColumn("drop_reason", F.lit(None).cast("string")), lock.select(F.col("views")[0].alias("hash")), 1)
    with pytest.raises(jobs.HeldOutLeak):
        jobs.check_field_test(both, spark.createDataFrame([("s4", 5)], "sha256 string, hash long"), 1)
    jobs.check_field_test(both, spark.createDataFrame([("none", 0b1111 << 13)], "sha256 string, hash long"), 1)
