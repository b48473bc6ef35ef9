"""Choosing a confidence threshold by the cost of its errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.operators import matching as M
from sightline.operators import metrics as X
from sightline.plans.store import materialize


def set_costs(labels: DataFrame, preds: DataFrame, sets: DataFrame, iou: float, thresholds: list[float], scored: str, fp_cost: float, fn_cost: float) -> DataFrame:
    """(set_name, threshold, tp, fp, fn, images, cost) of one class; ``sets`` is (image_id, set_name).

    An image is matched anew wherever a threshold changes what it keeps, and counted before it is
    summed by set.
    """
    own = M.restrict(labels, [scored])
    mine = materialize(X.at_levels(M.restrict(preds, [scored]), thresholds, ["image_id"]), "levels")
    tp = M.match_boxes(own, mine, iou, ("level",)).filter("same").groupBy("image_id", "level").agg(F.count("*").alias("tp"))
    counts = mine.groupBy("image_id", "level").agg(F.count("*").alias("np")).join(tp, ["image_id", "level"], "left").fillna(0, ["tp"])
    found = X.over_thresholds(counts.join(sets, "image_id"), thresholds, ["image_id"], ["set_name"], ["np", "tp"])
    images = sets.groupBy("set_name").agg(F.count("*").alias("images"))
    there = own.join(sets, "image_id").groupBy("set_name").agg(F.count("*").alias("nl"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    out = images.withColumn("threshold", grid).join(there, "set_name", "left").join(found, ["set_name", "threshold"], "left").fillna(0, ["nl", "np", "tp"])
    fp, fn = F.col("np") - F.col("tp"), F.col("nl") - F.col("tp")
    return out.select("set_name", "threshold", "tp", fp.alias("fp"), fn.alias("fn"), "images", ((fp_cost * fp + fn_cost * fn) / F.col("images")).alias("cost"))


def mean_costs(costs: DataFrame) -> DataFrame:
    """(threshold, cost): the unweighted mean over sets."""
    return costs.groupBy("threshold").agg(F.avg("cost").alias("cost"))


def pick_threshold(costs: DataFrame) -> DataFrame:
    """(threshold, cost) of the least cost to nine places, the higher threshold on a tie."""
    return costs.agg(F.min_by(F.struct("threshold", "cost"), F.struct(F.round("cost", 9), -F.col("threshold"))).alias("b")).select("b.*")


def flat_band(costs: DataFrame, band: float) -> DataFrame:
    """(low, high): the unbroken run of thresholds around the best one within ``band`` of its cost."""
    best = pick_threshold(costs).select(F.col("threshold").alias("best"), F.col("cost").alias("least"))
    # thresholds are a configured grid, so one small partition is enough
    marked = costs.crossJoin(F.broadcast(best)).withColumn("over", F.col("cost") > F.col("least") * (1 + band) + 1e-12)
    isles = marked.withColumn("isle", F.sum(F.col("over").cast("int")).over(W.orderBy("threshold").rowsBetween(W.unboundedPreceding, 0)))
    home = isles.filter("threshold = best").select(F.col("isle").alias("home"))
    return isles.crossJoin(F.broadcast(home)).filter("isle = home and not over").agg(F.min("threshold").alias("low"), F.max("threshold").alias("high"))


def check_parts(whole: DataFrame, parts: DataFrame) -> None:
    """Raises unless the parts of (image_id, part) cover every image once and none is empty."""
    n, k = whole.count(), parts.count()
    if n != k or whole.join(parts, "image_id", "left_anti").limit(1).count() or parts.filter("part is null").limit(1).count():
        raise ValueError(f"{k} rows in parts for {n} images")


def held_out_parts(images: DataFrame, part_of) -> DataFrame:
    """(part, images) of a held-out set cut by kind."""
    return images.groupBy(part_of.alias("part")).agg(F.count("*").alias("images"))
