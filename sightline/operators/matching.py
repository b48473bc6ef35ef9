"""Greedy one-to-one matching of predictions with labels, and what follows from it.

Labels have (image_id, label_ix, label, x1, y1, x2, y2), predictions (image_id, pred_ix, label,
conf, x1, y1, x2, y2).  ``by`` names further columns of the predictions, such as a threshold, that
split the work into independent problems.

Candidate pairs come from an equi-join on the image with the overlap as a residual predicate.
Each image's pairs are sorted on a total order and walked once by a higher-order function, so
there is no Python and no shuffle beyond the image key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import geometry as G
from sightline.plans.store import materialize

CORNERS = ["x1", "y1", "x2", "y2"]


def above(preds: DataFrame, confidence: float) -> DataFrame:
    """Predictions at or above a confidence; those without one stay."""
    return preds.filter(F.col("conf").isNull() | (F.col("conf") >= confidence))


def restrict(boxes: DataFrame, classes: list[str]) -> DataFrame:
    return boxes.filter(F.col("label").isin(classes))


def top_k(preds: DataFrame, k: int, classes: list[str] | None = None) -> DataFrame:
    """The k most confident of each image and class; classes that aren't scored go first."""
    preds = restrict(preds, classes) if classes is not None else preds
    rank = F.row_number().over(W.partitionBy("image_id", "label").orderBy(F.desc("conf"), "pred_ix"))
    return preds.withColumn("_n", rank).filter(F.col("_n") <= k).drop("_n")


def per_image_limit(preds: DataFrame, k: int, confidence: float) -> DataFrame:
    """(images_at_limit, images_cut_above): images with a class of k or more, and those whose k-th is still confident."""
    full = preds.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("conf").alias("least")).filter(F.col("n") >= k)
    seen = full.groupBy("image_id").agg(F.max((F.col("least") >= confidence).cast("int")).alias("hot"))
    return seen.agg(F.count("*").alias("images_at_limit"), F.coalesce(F.sum("hot"), F.lit(0)).cast("long").alias("images_cut_above"))


def _sides(labels: DataFrame, preds: DataFrame, by: list[str]) -> DataFrame:
    a = labels.select("image_id", "label_ix", F.col("label").alias("l_label"), *[F.col(c).alias(f"l_{c}") for c in CORNERS])
    b = preds.select("image_id", "pred_ix", F.col("label").alias("p_label"), "conf", *by, *[F.col(c).alias(f"p_{c}") for c in CORNERS])
    return a.join(b, "image_id").withColumn("iou", G.iou(G.box("l_"), G.box("p_"))).withColumn("same", F.col("l_label") == F.col("p_label"))


def greedy(pairs: DataFrame, keys: list[str], order: list[tuple[str, Column]], keep: dict[str, Column]) -> DataFrame:
    """Walks each group's pairs in order and takes those whose label and prediction are both free."""
    listed = F.struct(*[c.alias(f"o{i}_{n}") for i, (n, c) in enumerate(order)], F.col("label_ix"), F.col("pred_ix"), *[c.alias(n) for n, c in keep.items()])
    took = walk(pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(listed)).alias("ps")), keys)
    return took.select(*keys, "m.label_ix", "m.pred_ix", *[f"m.{n}" for n in keep])


def walk(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m) of the pairs taken from each row's sorted list ``ps``."""
    kind = rows.schema["ps"].dataType.simpleString()
    start = F.struct(F.array().cast("array<bigint>").alias("l"), F.array().cast("array<bigint>").alias("p"), F.array().cast(kind).alias("took"))
    add = lambda acc, x: F.struct(F.array_append(acc["l"], x["label_ix"].cast("bigint")).alias("l"), F.array_append(acc["p"], x["pred_ix"].cast("bigint")).alias("p"), F.array_append(acc["took"], x).alias("took"))
    step = lambda acc, x: F.when(F.array_contains(acc["l"], x["label_ix"].cast("bigint")) | F.array_contains(acc["p"], x["pred_ix"].cast("bigint")), acc).otherwise(add(acc, x))
    walked = F.aggregate("ps", start, step, lambda acc: acc["took"])
    return rows.select(*keys, F.explode(walked).alias("m"))


def match_boxes(labels: DataFrame, preds: DataFrame, iou: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with IoU strictly above ``iou``: same class first, then by IoU, then label and prediction index."""
    pairs = _sides(labels, preds, list(by)).filter(F.col("iou") > iou)
    keep = {c: F.col(c) for c in ("same", "iou", "l_label", "p_label", "conf")}
    order = [("other", (~F.col("same")).cast("int")), ("iou", -F.col("iou")), ("label", F.col("label_ix")), ("pred", F.col("pred_ix"))]
    return greedy(pairs, ["image_id", *by], order, keep)


def match_same_class(labels: DataFrame, preds: DataFrame, iou: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one class with IoU at or above ``iou``, by IoU."""
    pairs = _sides(labels, preds, list(by)).filter(F.col("same") & (F.col("iou") >= iou))
    keep = {c: F.col(c) for c in ("iou", "l_label", "p_label", "conf")}
    return greedy(pairs, ["image_id", *by], [("iou", -F.col("iou")), ("label", F.col("label_ix")), ("pred", F.col("pred_ix"))], keep)


def error_counts(labels: DataFrame, preds: DataFrame, matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, tp, fp, fn) of each class; a confusion counts against both of its classes.

    Counts follow from totals: what isn't a hit is a false positive or a miss.
    """
    by = list(by)
    hits = matched.filter("same").groupBy(*by, F.col("l_label").alias("label")).agg(F.count("*").alias("tp"))
    shown = preds.groupBy(*by, "label").agg(F.count("*").alias("np"))
    there = labels.groupBy("label").agg(F.count("*").alias("nl"))
    if by:
        there = there.crossJoin(F.broadcast(preds.select(*by).distinct()))  # classes by thresholds
    out = there.join(shown, [*by, "label"], "full_outer").join(hits, [*by, "label"], "left").fillna(0, ["nl", "np", "tp"])
    return out.select(*by, "label", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nl") - F.col("tp")).alias("fn"))


def confusion_matrix(labels: DataFrame, preds: DataFrame, matched: DataFrame, background: str = "background") -> DataFrame:
    """(true_label, pred_label, n) with background for what stays alone; empty cells are absent.

    What stays alone is a class's total less its pairs, so boxes are only counted.
    """
    pairs = matched.groupBy(F.col("l_label").alias("true_label"), F.col("p_label").alias("pred_label")).agg(F.count("*").alias("n"))
    minus = lambda c: pairs.select(F.col(c), (-F.col("n")).alias("n"))
    alone = lambda boxes, c: boxes.groupBy(F.col("label").alias(c)).agg(F.count("*").alias("n")).union(minus(c)).groupBy(c).agg(F.sum("n").alias("n")).filter("n > 0")
    fn = alone(labels, "true_label").select("true_label", F.lit(background).alias("pred_label"), "n")
    fp = alone(preds, "pred_label").select(F.lit(background).alias("true_label"), "pred_label", "n")
    return pairs.unionByName(fn).unionByName(fp)


def false_positive_kinds(labels: DataFrame, preds: DataFrame, iou: float, floor: float, scored: str, unscored: DataFrame | None = None) -> DataFrame:
    """(image_id, pred_ix, conf, kind) of each false positive of one class.

    duplicate: overlaps a label that another prediction took; localization: overlaps a label too
    little; inside_unscored: its center lies in a box of a class that isn't scored; else background.
    """
    own, mine = restrict(labels, [scored]), restrict(preds, [scored])
    matched = materialize(match_boxes(own, mine, iou), "matched")
    extra = mine.join(matched.select("image_id", "pred_ix"), ["image_id", "pred_ix"], "left_anti")
    taken = own.join(matched.select("image_id", "label_ix", F.lit(True).alias("taken")), ["image_id", "label_ix"], "left")
    near = extra.select("image_id", "pred_ix", *CORNERS).join(taken.select("image_id", "taken", *[F.col(c).alias(f"l_{c}") for c in CORNERS]), "image_id")
    over = G.iou(G.box("l_"), G.box())
    flags = near.groupBy("image_id", "pred_ix").agg(F.max((F.col("taken") & (over > iou)).cast("int")).alias("dup"), F.max((over > floor).cast("int")).alias("loc"))
    out = extra.join(flags, ["image_id", "pred_ix"], "left")
    if unscored is not None:
        cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        held = extra.select("image_id", "pred_ix", *CORNERS).join(unscored.select("image_id", *[F.col(c).alias(f"l_{c}") for c in CORNERS]), "image_id")
        held = held.filter(G.inside(cx, cy, G.box("l_"))).select("image_id", "pred_ix", F.lit(True).alias("held")).distinct()
        out = out.join(held, ["image_id", "pred_ix"], "left")
    else:
        out = out.withColumn("held", F.lit(None).cast("boolean"))
    kind = F.when(F.col("dup") == 1, "duplicate").when(F.col("loc") == 1, "localization").when(F.col("held"), "inside_unscored").otherwise("background")
    return out.select("image_id", "pred_ix", "conf", kind.alias("kind"))


def ignore_at_edge(labels: DataFrame, preds: DataFrame, sizes: DataFrame, classes: list[str], tolerance: float, min_overlap: float, iou: float) -> tuple[DataFrame, DataFrame]:
    """Labels and predictions to score: edge labels of some classes go, and the predictions on them.

    A prediction stays if it overlaps a remaining label of its class at ``iou`` or more.
    """
    sized = labels.join(sizes.select("image_id", "width", "height"), "image_id")
    edge = G.at_edge(G.box(), F.col("width"), F.col("height"), tolerance) & F.col("label").isin(classes)
    marked = sized.withColumn("edge", edge).drop("width", "height")
    side = marked.select("image_id", "label", "edge", *[F.col(c).alias(f"l_{c}") for c in CORNERS])
    pairs = restrict(preds, classes).join(side, ["image_id", "label"])
    near = pairs.filter(F.col("edge") & (G.overlap_of_smaller(G.box(), G.box("l_")) > min_overlap)).select("image_id", "pred_ix")
    hit = pairs.filter(~F.col("edge") & (G.iou(G.box(), G.box("l_")) >= iou)).select("image_id", "pred_ix")
    gone = near.join(hit, ["image_id", "pred_ix"], "left_anti").distinct()
    return marked.filter("not edge").drop("edge"), preds.join(gone, ["image_id", "pred_ix"], "left_anti")


def unit_counts(units: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit, images, boxes) of every unit of (image_id, unit), zeros included."""
    boxes = labels.groupBy("image_id").agg(F.count("*").alias("n"))
    return units.join(boxes, "image_id", "left").groupBy("unit").agg(F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"))
