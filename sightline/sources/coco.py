"""COCO annotation files: scan with guards, and a sink of one file a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.indexing import with_index
from sightline.plans.store import materialize
from sightline.sources import files

ANNOTATIONS = "_annotations.coco.json"
CATEGORY = "id bigint, name string, supercategory string"
IMAGE = "id bigint, file_name string, width int, height int, extra struct<name:string,source_split:string,source_dataset:string>"
ANNOTATION = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int"


class BadAnnotation(ValueError):
    """An annotation points to a category or an image that its file doesn't define."""


def scan(spark: SparkSession, folder: str, dataset: str, splits: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Images and boxes of all <folder>/<split>/_annotations.coco.json files.

    Images: (dataset, split, file_name, source_name, width, height, image_id, position); those
    without boxes are kept.  Boxes: (image_id, label_ix, label, x, y, w, h, x1, y1, x2, y2).
    Raises BadAnnotation for dangling references and ValueError if there is no file.
    """
    paths = [p for p in files.list_files(spark, f"{folder}/*/{ANNOTATIONS}") if splits is None or p.split("/")[-2] in splits]
    if not paths:
        raise ValueError(f"no annotation file in {folder}")
    raw = files.read_members(spark, paths, ("categories", "images", "annotations"))
    raw = materialize(raw.select(F.lit(dataset).alias("dataset"), F.element_at(F.split("path", "/"), -2).alias("split"), "section", "position", "value"), "coco")
    key = lambda id_: F.concat_ws("/", "dataset", "split", id_.cast("string"))
    of = lambda section, schema: raw.filter(F.col("section") == section).select("dataset", "split", F.col("position").cast("int").alias("position"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("i"))
    images = of("images", IMAGE).select("dataset", "split", "i.file_name", F.coalesce("i.extra.name", "i.file_name").alias("source_name"), "i.width", "i.height", key(F.col("i.id")).alias("image_id"), "position")
    anns = of("annotations", ANNOTATION).select("dataset", "split", F.col("position").alias("label_ix"), key(F.col("i.image_id")).alias("image_id"), "i.category_id", "i.bbox", F.col("i.id").alias("ann_id"))
    names = of("categories", CATEGORY).select("dataset", "split", F.col("i.id").alias("category_id"), F.col("i.name").alias("label"))
    for kind, lost in (("category", anns.join(names, ["dataset", "split", "category_id"], "left_anti")), ("image", anns.join(images.select("image_id"), "image_id", "left_anti"))):
        if bad := lost.select("split", "ann_id").limit(1).collect():
            raise BadAnnotation(f"annotation {bad[0]['ann_id']} of {bad[0]['split']} has an unknown {kind}")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    boxes = anns.join(F.broadcast(names), ["dataset", "split", "category_id"]).select("image_id", F.col("label_ix").cast("long").alias("label_ix"), "label", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    return images, boxes


def _line(at: int, first: Column, body: Column) -> Column:
    return F.struct(F.lit(at).alias("section"), F.when(first, F.lit("")).otherwise(F.lit(",")).alias("comma"), body.alias("body"))


def write_split(images: DataFrame, boxes: DataFrame, classes: list[str], folder: str) -> None:
    """Writes one COCO file: images by file name with ids from 0, categories from 1, annotation ids running on.

    The file is one stream of lines in order; no task holds more than its sort buffer.  Raises if
    a file name is used twice or a label isn't among the classes.
    """
    spark = images.sparkSession
    twice = images.groupBy("file_name").count().filter("count > 1").select("file_name").orderBy("file_name").limit(5).collect()
    if twice:
        raise ValueError(f"{folder}: file names used more than once: {[r[0] for r in twice]}")
    unknown = boxes.filter(~F.col("label").isin(classes)).select("label").distinct().limit(20).collect()
    if unknown:
        raise ValueError(f"labels outside the classes: {sorted(r[0] for r in unknown)}")
    numbered = with_index(images, "id", "file_name")
    extra = F.struct(F.col("source_name").alias("name"), F.col("split").alias("source_split"), *([F.col("source_dataset")] if "source_dataset" in images.columns else []))
    image = F.to_json(F.struct("id", "file_name", "width", "height", extra.alias("extra")))
    own = boxes.join(numbered.select("image_id", F.col("id").alias("image_no")), "image_id")
    anns = with_index(own, "id", "image_no", "label_ix")
    category = F.element_at(F.create_map(*[F.lit(v) for n, c in enumerate(classes, 1) for v in (c, n)]), F.col("label")) if classes else F.lit(None).cast("int")
    ann = F.to_json(F.struct("id", F.col("image_no").alias("image_id"), category.alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"), F.array().alias("segmentation")))
    lines = numbered.select(F.lit(1).alias("section"), "id", F.concat(F.when(F.col("id") > 0, ",").otherwise(""), image).alias("line"))
    lines = lines.union(anns.select(F.lit(3), "id", F.concat(F.when(F.col("id") > 0, ",").otherwise(""), ann)))
    listed = ",".join(f'{{"id":{n},"name":{files.quoted(c)},"supercategory":"none"}}' for n, c in enumerate(classes, 1))
    fixed = [(0, 0, f'{{"info":{{}},"licenses":[],"categories":[{listed}],"images":['), (2, 0, '],"annotations":['), (4, 0, "]}")]
    files.write_lines(lines.union(spark.createDataFrame(fixed, "section int, id long, line string")), ["section", "id"], f"{folder}/{ANNOTATIONS}")


def write_splits(images: DataFrame, boxes: DataFrame, classes: list[str], folder: str, splits: tuple[str, ...] = ("train", "valid", "test"), by: str = "split") -> None:
    """One file for each split, also where it has no image."""
    for s in splits:
        own = images.filter(F.col(by) == s)
        write_split(own, boxes.join(own.select("image_id"), "image_id", "left_semi"), classes, f"{folder}/{s}")
