"""Merging sources without leaking held-out scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import names as N


def held_out_scenes(held: DataFrame) -> DataFrame:
    """(dataset, recording, first_frame) of held-out images; the frame is null where recordings have none."""
    return held.groupBy("dataset", "recording").agg(F.min("frame").alias("first_frame"))


def same_scene(candidates: DataFrame, held: DataFrame, buffer: int) -> DataFrame:
    """Candidates of a held-out recording, if it has frames only those at or after its first less the buffer."""
    scenes = held_out_scenes(held)
    a, b = candidates.alias("a"), scenes.alias("b")
    on = (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.recording") == F.col("b.recording")) & (F.col("b.first_frame").isNull() | (F.col("a.frame") >= F.col("b.first_frame") - buffer))
    return a.join(b, on, "left_semi")


def block_reason(source_name: Column, scene: Column, protected: Column) -> Column:
    """Why an image can't be merged: of several reasons the first."""
    return F.when(source_name, "source_name").when(scene, "same_scene").when(protected, "near_protected")


def read_scenes(candidates: DataFrame, patterns: list[tuple[str, str, bool]]) -> DataFrame:
    """Candidates once for each (dataset, pattern, has frames) that reads their source name, with recording and frame."""
    name = F.col("source_name")
    read = [F.struct(F.lit(d).alias("scene_dataset"), N.group_of(name, p, "recording").alias("recording"), (N.group_of(name, p, "frame").cast("long") if framed else F.lit(None).cast("long")).alias("frame")) for d, p, framed in patterns]
    told = candidates.withColumn("scene", F.explode(F.filter(F.array(*read), lambda s: s["recording"].isNotNull())))
    return told.select("*", "scene.*").drop("scene")


def plan_merge(images: DataFrame, train_only: list[str], exclude: str | None = None, exclude_files: tuple[str, ...] = ()) -> DataFrame:
    """Images with target_split, merged_name and drop_reason.

    Input rows have dataset, split, file_name, source_name, copy_key, keep (the copy to keep) and reason (why
    blocked, else null).  A copy group with a blocked copy goes whole, each copy with its own
    reason or else the group's first; then the other copies, excluded names and blocked images go.
    Test images are never excluded.
    """
    first = images.filter("copy_key is not null").groupBy("dataset", "copy_key").agg(F.min("reason").alias("_shared")).filter("_shared is not null")
    rows = images.join(first, ["dataset", "copy_key"], "left").select(*images.columns, "_shared")  # images without a key meet no group
    split = F.when(F.col("dataset").isin(train_only), F.lit("train")).otherwise(F.col("split"))
    listed = F.col("file_name").isin(list(exclude_files)) if exclude_files else F.lit(False)
    excluded = (split != "test") & (listed if exclude is None else listed | N.matches(F.col("source_name"), exclude))
    own = F.coalesce("reason", F.when(F.col("split") == "train", F.col("_shared")))
    copy = F.when(F.col("copy_key").isNotNull() & (F.col("split") == "train"), F.when(own.isNotNull(), own).when(~F.col("keep"), "copy"))
    blocked = F.when(F.col("dataset").isin(train_only), F.col("reason"))
    drop = F.coalesce(copy, F.when(excluded, "excluded"), blocked)
    return rows.withColumn("drop_reason", drop).drop("_shared").withColumn("target_split", split).withColumn("merged_name", N.merged_name(F.col("dataset"), F.col("file_name")))


def drop_exact(planned: DataFrame, content_sha: str = "sha256") -> DataFrame:
    """Of train images with equal contents only the first by merged name stays."""
    first = planned.filter("target_split = 'train'").groupBy(content_sha).agg(F.min("merged_name").alias("first"))
    joined = planned.join(first, content_sha, "left")
    return joined.filter((F.col("target_split") != "train") | F.col("first").isNull() | (F.col("merged_name") == F.col("first"))).select(*planned.columns)


def merge_report(planned: DataFrame) -> DataFrame:
    """(dataset, target_split, kept, dropped) and the reasons as (reason, n) pairs in order."""
    counts = planned.groupBy("dataset", "target_split", "drop_reason").agg(F.count("*").alias("n"))
    return counts.groupBy("dataset", "target_split").agg(
        F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("drop_reason").isNotNull(), F.col("n"))), F.lit(0)).alias("dropped"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("drop_reason").isNotNull(), F.concat_ws("=", "drop_reason", F.col("n").cast("string"))))), ",").alias("reasons"),
    )
