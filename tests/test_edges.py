from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sightline import config, report
from sightline.operators import reconcile, stats
from sightline.plans import jobs
from sightline.sources import remote

from .test_matching import A, B, C, FAR, frames


def test_listings_become_projects_or_failures(spark):
    good = {"project": {"name": "Balls", "images": 9, "classes": {"b": 2, "a": 1}}, "versions": [{"id": "ws/p/10", "images": 5, "splits": {"train": 4}}, {"id": "ws/p/9", "images": 4, "splits": {}}]}
    none = {"project": {"name": "New", "images": 0, "classes": {}}, "versions": []}
    rows = [("k1", "ws", "p", json.dumps(good)), ("k2", "ws", "q", json.dumps(none)), ("k3", "ws", "r", "{}"), ("k4", "ws", "s", "oops"), ("k5", "ws", "t", json.dumps(good | {"versions": [{"id": "ws/p/x"}]}))]
    told, failed = remote.resolve(spark.createDataFrame(rows, "key string, workspace string, project string, response string"))
    got = {r["key"]: r for r in told.collect()}
    assert set(got) == {"k1", "k2"} and got["k1"]["latest_version"] == 10 and [v["version"] for v in got["k1"]["versions"]] == [9, 10] and list(got["k1"]["classes"]) == ["a", "b"] and got["k2"]["latest_version"] is None
    assert {r["key"] for r in failed.collect()} == {"k3", "k4", "k5"}
    slugs = remote.project_slugs(spark.createDataFrame([("k", json.dumps({"workspace": {"projects": [{"id": "ws/b"}, {"id": "ws/a"}]}}))], "key string, response string"))
    assert {r["slug"] for r in slugs.collect()} == {"a", "b"}


def test_nothing_unfit_is_handed_over(spark):
    cols = "split string, file_name string, sha256 string, hash long"
    images = spark.createDataFrame([("train", "a.jpg", "1", 1), ("test", "b.jpg", "2", 1 << 40)], cols)
    reported = spark.createDataFrame([("train", 1), ("test", 1)], "split string, n long")
    assert reconcile.check_before_upload(images, reported, None, 1) == {"train": 1, "test": 1}
    with pytest.raises(reconcile.NotReady, match="test has 1, the report says 2"):
        reconcile.check_before_upload(images, spark.createDataFrame([("train", 1), ("test", 2)], reported.schema), None, 1)
    more = spark.createDataFrame([("train", "c.jpg", "1", 9)], cols)
    with pytest.raises(reconcile.NotReady, match="1 images are byte-identical"):
        reconcile.check_before_upload(images.union(more), spark.createDataFrame([("train", 2), ("test", 1)], reported.schema), None, 1)
    with pytest.raises(reconcile.AmbiguousKey):
        reconcile.check_before_upload(images.union(more.withColumn("file_name", F.lit("a.png"))), spark.createDataFrame([("train", 2), ("test", 1)], reported.schema), None, 1)
    with pytest.raises(reconcile.NotReady, match="field test"):
        reconcile.check_before_upload(images, reported, spark.createDataFrame([(3,)], "hash long"), 1)
    assert reconcile.check_rescore({"model": "m", "dataset": "d", "split": "s"}, {"git": {"dirty": False}, "source_dirty": True}, "m", "d", "s")
    with pytest.raises(reconcile.NotReady):
        reconcile.check_rescore({"model": "x", "dataset": "d", "split": "s"}, {"git": {"dirty": False}}, "m", "d", "s")


def test_numbers_need_a_source(spark):
    text = ["Recall is 0.95 and 12%.", "```", "0.1", "```", "`0.2` [x](http://a/0.3) v1.2.3", "fact 0.4 numbers: ok", "<!-- 0.5 -->", "also 7.25 of 8"]
    docs = spark.createDataFrame([("r.md", i, t) for i, t in enumerate(text, 1)], "path string, line int, text string")
    sources = spark.createDataFrame([("m.json", 1, '{"recall": 0.95}')], "path string, line int, text string")
    assert sorted((r["line"], r["number"]) for r in report.unsourced_numbers(docs, sources).collect()) == [(1, "12%"), (8, "7.25")]


def test_numbers_that_stand_alone(spark):
    lines = ["took 3.5ms, 12%abc or 0.25.", "v1.5 x1.5 1.2.3 1..2 .5 a.5 5 50 7%", "(0.5) 0.75/0.80 -1.25 1.5% 2%% https://a/b/0.9 see http://c?0.8 0.7", "`a` 0.6 `0.1` [t](u/0.3) 0.2 [x 0.4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", report.numbers_in(report._prose(F.col("t")))).collect()}
    assert got == {0: ["3.5", "12%", "0.25"], 1: ["7%"], 2: ["0.5", "0.75", "0.80", "1.25", "1.5%", "0.7"], 3: ["0.6", "0.2", "0.4"]}


def test_a_left_out_image_brings_in_the_next(spark):
    images = spark.createDataFrame([("d", "train", f"{i}.jpg", f"s{i}") for i in range(20)], "dataset string, split string, file_name string, source_name string")
    full = [r["file_name"] for r in stats.grid_order(images, 6, "x").orderBy("place").collect()]
    less = [r["file_name"] for r in stats.grid_order(images, 5, "x", exclude_files=(full[2],)).orderBy("place").collect()]
    assert less == full[:2] + full[3:] and stats.grid_order(images, 5, "x", exclude_pattern="s").count() == 0


def test_a_whole_run(spark):
    labels = [("1", 0, "fuel", A), ("1", 1, "robot", B), ("2", 0, "fuel", C)]
    preds = [("1", 0, "fuel", 0.9, A), ("1", 1, "robot", 0.8, B), ("2", 0, "fuel", 0.7, C), ("2", 1, "fuel", 0.6, FAR), ("2", 2, "tree", 0.9, FAR), ("2", 3, "fuel", 0.001, FAR)]
    gt, pd = frames(spark, labels, preds)
    images = spark.createDataFrame([(i, 100.0, 100.0) for i in "123"], "image_id string, width double, height double")
    units = spark.createDataFrame([(i, f"u{i}") for i in "123"], "image_id string, unit string")
    project = config.build(config.Project, {"evaluate": {"resamples": 5, "edge": {"classes": ["fuel"], "tolerance_px": 1.0}}})
    seen = images.select("image_id")
    out = jobs.evaluate(images, gt, pd, seen, units, ["robot", "fuel"], ["fuel", "robot", "tree"], project)
    per = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in out["per_class"].collect()}
    assert per == {"fuel": (1, 1, 0), "robot": (1, 0, 0)}  # the ball at the edge and its hit don't count
    assert {r["unit"]: (r["images"], r["boxes"]) for r in out["units"].collect()} == {"u1": (1, 1), "u2": (1, 1), "u3": (1, 0)}
    assert out["per_image_limit"].first()["images_at_limit"] == 0 and out["intervals"].count() == 4
    with pytest.raises(config.ConfigError, match="the model knows"):
        jobs.evaluate(images, gt, pd, seen, units, ["robot"], ["tree"], project)
    with pytest.raises(ValueError, match="no predictions"):
        jobs.evaluate(images, gt, pd, seen.limit(1), units, ["robot"], ["robot"], project)
