"""Leak-free splits: by recording in frame order, or by groups of related images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import names as N
from sightline.operators import hamming as H
from sightline.operators.components import connected_components
from sightline.plans.store import materialize, shuffled

SPLITS = ("train", "valid", "test")
FRACTIONS = (0.7, 0.15, 0.15)


def leak_groups(images: DataFrame, pattern: str | None, d: int, id_: str = "file_name", source: str = "source_name") -> DataFrame:
    """Every image with ``unit``, the least id among images related to it.

    Images are related that share a recording, a source name, or hashes within d bits.  Shared
    keys link to the least image of the key, so a key gives as many links as it has images.
    """
    keys = F.array(F.concat(F.lit("name:"), F.col(source)))
    if pattern:
        recording = N.group_of(F.col(source), pattern, "recording")
        keys = F.concat(keys, F.when(recording.isNotNull(), F.array(F.concat(F.lit("recording:"), recording))).otherwise(F.array().cast("array<string>")))
    keyed = images.select(F.col(id_).alias("src"), F.explode(keys).alias("key")).filter("key is not null")
    links = keyed.join(shuffled(keyed.groupBy("key").agg(F.min("src").alias("dst"))), "key").select("src", "dst").filter("src <> dst")
    found = connected_components(links.union(H.near_links(images, d, id_)))
    return images.join(shuffled(found.withColumnRenamed("node", id_)), id_, "left").withColumn("unit", F.coalesce("component", id_)).drop("component")


def copy_groups(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Train images with ``copy_key``: source name and box counts by class identify a photo's copies."""
    counts = boxes.groupBy("image_id", "label").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("histogram"))
    empty = F.array().cast("array<struct<label:string,n:bigint>>")
    joined = images.filter("split = 'train'").join(counts, "image_id", "left")
    return joined.withColumn("copy_key", F.concat_ws("|", "source_name", F.to_json(F.coalesce("histogram", empty)))).drop("histogram")


def pick_copies(grouped: DataFrame, boxes: DataFrame) -> DataFrame:
    """Copy groups with ``keep``: the least total box area, then the first file name."""
    area = boxes.groupBy("image_id").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    sized = grouped.join(area, "image_id", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    best = sized.groupBy("copy_key").agg(F.min(F.struct("area", "file_name")).alias("best"))
    return sized.join(best, "copy_key").withColumn("keep", F.struct("area", "file_name") == F.col("best")).drop("best")


def cut_points(n: Column, fractions: tuple[float, float, float] = FRACTIONS) -> tuple[Column, Column]:
    """Ends of train and valid among n ordered frames; valid and test get one at least (n >= 3)."""
    near = lambda f: F.bround(n * F.lit(f), 0).cast("long")
    a = F.least(near(fractions[0]), n - 2)
    return a, F.least(F.greatest(a + near(fractions[1]), a + 1), n - 1)


def temporal_split(frames: DataFrame, buffer: int, least: int, fractions: tuple[float, float, float] = FRACTIONS, train_only: str | None = None) -> DataFrame:
    """(recording, frame, file_name) with split, unit and dropped ('buffer' or null).

    Recordings shorter than ``least`` or matching ``train_only`` go whole to train; an image goes
    if the next split's first frame is at most ``buffer`` frames later.
    """
    own = W.partitionBy("recording")
    rows = frames.withColumn("i", F.row_number().over(own.orderBy("frame", "file_name")) - 1).withColumn("n", F.count("*").over(own))
    whole = F.col("n") < least
    if train_only:
        whole = whole | N.matches(F.col("recording"), train_only)
    a, b = cut_points(F.col("n"), fractions)
    rows = rows.withColumn("a", F.when(whole, F.col("n")).otherwise(a)).withColumn("b", F.when(whole, F.col("n")).otherwise(b))
    first = lambda at: F.max(F.when(F.col("i") == F.col(at), F.col("frame"))).over(own)
    rows = rows.withColumn("fa", first("a")).withColumn("fb", first("b"))
    split = F.when(F.col("i") < F.col("a"), "train").when(F.col("i") < F.col("b"), "valid").otherwise("test")
    following = F.when(F.col("i") < F.col("a"), F.col("fa")).when(F.col("i") < F.col("b"), F.col("fb"))
    dropped = F.when(following - F.col("frame") <= buffer, "buffer")
    return rows.select("recording", "frame", "file_name", split.alias("split"), F.col("recording").alias("unit"), dropped.alias("dropped"))


def assign_groups(grouped: DataFrame, seed: str, fractions: tuple[float, float, float] = FRACTIONS, id_: str = "file_name") -> DataFrame:
    """(unit, size, split): the largest groups first, each to the split furthest below its share.

    Groups of one size are ordered by a hash of the seed and their first name.  Each choice
    depends on all earlier ones, so (size, hash, unit) of groups, never of images, streams in
    order through one task that keeps three counters.
    """
    sizes = grouped.groupBy("unit").agg(F.count("*").alias("size"), F.min(id_).alias("first"))
    keyed = materialize(sizes.select("unit", "size", F.sha2(F.concat_ws(":", F.lit(seed), "first"), 256).alias("tie")), "groups")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [f * total for f in fractions]

    def walk(frames):
        filled = [0, 0, 0]
        for frame in frames:
            took = []
            for n in frame["size"]:
                best = max(range(3), key=lambda i: ((goals[i] - filled[i]) / goals[i], -i))
                filled[best] += int(n)
                took.append(SPLITS[best])
            yield frame[["unit", "size"]].assign(split=took)

    ordered = keyed.repartition(1).sortWithinPartitions(F.desc("size"), "tie", "unit")
    kind = keyed.schema["unit"].dataType.simpleString()
    return ordered.mapInPandas(walk, f"unit {kind}, size long, split string")


def grouped_split(images: DataFrame, pattern: str | None, d: int, seed: str, fractions: tuple[float, float, float] = FRACTIONS) -> DataFrame:
    """Images with unit and split, so that related images stay together."""
    grouped = leak_groups(images, pattern, d)
    return grouped.drop("split").join(shuffled(assign_groups(grouped, seed, fractions).select("unit", "split")), "unit")


def eval_only_split(images: DataFrame, pattern: str | None, d: int) -> DataFrame:
    return leak_groups(images, pattern, d).withColumn("split", F.lit("test"))


def drop_near_test(assigned: DataFrame, d: int) -> DataFrame:
    """Rows with ``dropped`` set to near_test for kept train and valid images near a test image."""
    near = H.near_test(assigned.filter("dropped is null"), d).select("file_name", F.lit("near_test").alias("why")).distinct()
    return assigned.join(shuffled(near), "file_name", "left").withColumn("dropped", F.coalesce("dropped", "why")).drop("why")


def split_summary(assigned: DataFrame) -> DataFrame:
    """(split, images, units, largest_unit, dropped) of every split."""
    unit = assigned.groupBy("split", "unit").agg(F.count_if(F.col("dropped").isNull()).alias("n"), F.count_if(F.col("dropped").isNotNull()).alias("gone"))
    return unit.groupBy("split").agg(F.sum("n").alias("images"), F.count_if(F.col("n") > 0).alias("units"), F.max("n").alias("largest_unit"), F.sum("gone").alias("dropped"))


def split_report(assigned: DataFrame, reasons: list[str], copy_key: str | None = None) -> DataFrame:
    """(section, name, other, n) of a split: images dropped by reason, zeros kept; where each source split's images
    went; and with ``copy_key`` how many groups of copies have each size.

    Images have source_split, split and dropped (a reason or null).
    """
    none = F.lit("")
    told = F.explode(F.array(*[F.lit(r) for r in reasons])).alias("name")
    count = assigned.groupBy(F.col("dropped").alias("name")).agg(F.count("*").alias("n"))
    out = assigned.sparkSession.range(1).select(told).join(count, "name", "left").select(F.lit("dropped").alias("section"), "name", none.alias("other"), F.coalesce("n", F.lit(0)).alias("n"))
    went = F.when(F.col("dropped").isNull(), F.col("split")).otherwise("dropped")
    out = out.union(assigned.groupBy(F.col("source_split").alias("name"), went.alias("other")).agg(F.count("*").alias("n")).select(F.lit("from_source_split"), "name", "other", "n"))
    if copy_key:
        sizes = assigned.filter(F.col(copy_key).isNotNull()).groupBy(copy_key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
        out = out.union(sizes.select(F.lit("copy_group_size"), F.col("size").cast("string"), none, "n"))
    return out
