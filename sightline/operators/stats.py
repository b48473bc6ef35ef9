"""Relabelling and per-split statistics of detection datasets.

Images have (dataset, split, file_name, source_name, width, height, image_id), boxes (image_id,
label, x, y, w, h).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import geometry as G
from sightline.functions import names as N

DROP = "DROP"


class UnmappedLabel(ValueError):
    """Labels that the class map doesn't name."""


def check_mapped(boxes: DataFrame, mapping: DataFrame) -> None:
    """Raises with all labels that have no target; ``mapping`` is (label, target)."""
    missing = boxes.join(F.broadcast(mapping), "label", "left_anti").select("label").distinct().orderBy("label").limit(1000).collect()
    if missing:
        raise UnmappedLabel(f"no target for {[r[0] for r in missing]}")


def map_labels(boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Boxes under their target classes, without dropped ones; images are left as they are."""
    return boxes.join(F.broadcast(mapping), "label").filter(F.col("target") != DROP).drop("label").withColumnRenamed("target", "label")


def label_counts(images: DataFrame, boxes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(dataset, split, label, target, instances) of the boxes before mapping."""
    joined = boxes.join(images.select("image_id", "dataset", "split"), "image_id").join(F.broadcast(mapping), "label")
    return joined.groupBy("dataset", "split", "label", "target").agg(F.count("*").alias("instances"))


def split_stats(images: DataFrame, boxes: DataFrame, small: float, medium: float, tolerance: float) -> DataFrame:
    """One row of counts, shares and extremes for each (dataset, split)."""
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    bucket = G.area_bucket(F.col("w"), F.col("h"), F.col("width"), F.col("height"), small, medium)
    bad = G.is_invalid(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")), tolerance)
    per = sized.withColumn("bucket", bucket).withColumn("bad", bad).groupBy("image_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("small", "medium", "large")], F.count_if("bad").alias("bad")
    )
    rows = images.join(per, "image_id", "left").fillna(0, ["n", "small", "medium", "large", "bad"])
    share = lambda c: F.when(F.sum("n") > 0, F.sum(c) / F.sum("n")).otherwise(0.0)
    key = ["dataset", "split"]
    out = rows.groupBy(*key).agg(
        F.count("*").alias("images"), F.count_distinct("source_name").alias("source_images"), F.sum("n").alias("boxes"), F.count_if(F.col("n") == 0).alias("zero_label_images"),
        F.avg("n").alias("boxes_mean"), F.percentile("n", F.lit(0.5)).alias("boxes_median"), F.max("n").alias("boxes_max"),
        F.min("width").alias("width_min"), F.max("width").alias("width_max"), F.min("height").alias("height_min"), F.max("height").alias("height_max"),
        share("small").alias("small_share"), share("medium").alias("medium_share"), share("large").alias("large_share"), F.sum("bad").alias("invalid_boxes"),
    )
    res = rows.groupBy(*key, F.concat_ws("x", F.col("width").cast("int"), F.col("height").cast("int")).alias("res")).agg(F.count("*").alias("c"))
    top = res.groupBy(*key).agg(F.count("*").alias("resolutions"), F.min(F.struct((-F.col("c")).alias("m"), "res")).alias("t"))
    return out.join(top.select(*key, "resolutions", F.col("t.res").alias("top_resolution"), (-F.col("t.m")).alias("top_images")), key)


def class_counts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(dataset, split, label, instances, images) of classes with boxes."""
    per = boxes.groupBy("image_id", "label").agg(F.count("*").alias("n")).join(images.select("image_id", "dataset", "split"), "image_id")
    return per.groupBy("dataset", "split", "label").agg(F.sum("n").alias("instances"), F.count("*").alias("images"))


def class_coverage(images: DataFrame, boxes: DataFrame, classes: list[str]) -> DataFrame:
    """class_counts with zero rows for the classes a split lacks, and whether the dataset labels the class at all."""
    spark = images.sparkSession
    grid = images.select("dataset", "split").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in classes], "label string")))
    out = grid.join(class_counts(images, boxes), ["dataset", "split", "label"], "left").fillna(0, ["instances", "images"])
    return out.withColumn("labeled", F.max(F.col("instances") > 0).over(W.partitionBy("dataset", "label")))


def source_overlap(images: DataFrame) -> DataFrame:
    """(dataset, source_name, splits) of names found in more than one split."""
    seen = images.groupBy("dataset", "source_name").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return seen.filter(F.size("splits") > 1).withColumn("splits", F.array_join("splits", ","))


def one_per_source(images: DataFrame, n: int) -> DataFrame:
    """The first image of each source name, then the first n by file name of each dataset and split."""
    first = images.groupBy("dataset", "split", "source_name").agg(F.min("file_name").alias("file_name"))
    rank = F.row_number().over(W.partitionBy("dataset", "split").orderBy("file_name"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n)


def sheet_picks(images: DataFrame, boxes: DataFrame, n: int) -> DataFrame:
    """(dataset, kind, file_name, rank): the n densest images, n without boxes, and n of each class, one a source."""
    per = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    rows = images.join(per, "image_id", "left").fillna(0, ["n"])
    kinds = boxes.select("image_id", F.concat(F.lit("label "), "label").alias("kind")).distinct()
    zero = rows.filter("n = 0").select("image_id", F.lit("zero").alias("kind"))
    dense = rows.filter("n > 0").select("image_id", F.lit("dense").alias("kind"))
    told = rows.join(kinds.union(zero).union(dense), "image_id")
    order = [F.when(F.col("kind") == "dense", -F.col("n")).otherwise(0), "file_name"]
    one = told.withColumn("k", F.row_number().over(W.partitionBy("dataset", "kind", "source_name").orderBy(*order))).filter("k = 1")
    rank = F.row_number().over(W.partitionBy("dataset", "kind").orderBy(*order))
    return one.withColumn("rank", rank).filter(F.col("rank") <= n).select("dataset", "kind", "file_name", "rank")


def grid_order(images: DataFrame, n: int, seed: str, exclude_files: tuple[str, ...] = (), exclude_pattern: str | None = None) -> DataFrame:
    """(dataset, split, file_name, place) of the n images a sample grid shows of each dataset.

    All images are ordered by a hash of the seed and their name before any is left out, so leaving
    one out brings in the next and moves no other.
    """
    ref = F.concat_ws("/", "dataset", "split", "file_name")
    hashed = images.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), ref), 256))
    kept = hashed.filter(~F.col("file_name").isin(list(exclude_files))) if exclude_files else hashed
    if exclude_pattern is not None:
        kept = kept.filter(~N.matches(F.col("source_name"), exclude_pattern))
    place = F.row_number().over(W.partitionBy("dataset").orderBy("_h", "split", "file_name"))
    return kept.withColumn("place", place).filter(F.col("place") <= n).select("dataset", "split", "file_name", "place")


def shared_classes(images: DataFrame, boxes: DataFrame, trained: list[str]) -> DataFrame:
    """(dataset, label) of the labelled classes that a model was trained on; raises if there is none at all."""
    found = boxes.filter(F.col("label").isin(trained)).join(images.select("image_id", "dataset"), "image_id").select("dataset", "label").distinct()
    if not found.limit(1).count():
        raise UnmappedLabel(f"no labelled class is among {trained}")
    return found
