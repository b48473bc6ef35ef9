"""Where a detector goes wrong: slices, sizes, feature quantiles, reviews and galleries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import geometry as G
from sightline.operators import matching as M
from sightline.plans.store import materialize


class CountMismatch(ValueError):
    """Two ways of counting the same errors disagree."""


def slice_keys(images: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(image_id, by, name): each image under each of its slices, and under ('all', 'all')."""
    told = F.array(F.struct(F.lit("all").alias("by"), F.lit("all").alias("name")), *[F.struct(F.lit(k).alias("by"), c.cast("string").alias("name")) for k, c in keys.items()])
    return images.select("image_id", F.explode(told).alias("s")).select("image_id", "s.by", "s.name")


def slice_scores(slices: DataFrame, labels: DataFrame, preds: DataFrame, matched: DataFrame) -> DataFrame:
    """(by, name, images, labeled, hits, false_positives, misses, precision, recall, fp_per_image).

    Errors are counted once for each image and summed by slice; matching doesn't depend on slices.
    """
    per = lambda df, n: df.groupBy("image_id").agg(F.count("*").alias(n))
    rows = slices
    for n, df in (("nl", labels), ("np", preds), ("tp", matched.filter("same"))):
        rows = rows.join(per(df, n), "image_id", "left")
    out = rows.fillna(0, ["nl", "np", "tp"]).groupBy("by", "name").agg(F.count("*").alias("images"), F.sum("nl").alias("labeled"), F.sum("tp").alias("hits"), F.sum("np").alias("np"))
    fp = F.col("np") - F.col("hits")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.select("by", "name", "images", "labeled", "hits", fp.alias("false_positives"), (F.col("labeled") - F.col("hits")).alias("misses"), ratio(F.col("hits"), F.col("np")).alias("precision"), ratio(F.col("hits"), F.col("labeled")).alias("recall"), (fp / F.col("images")).alias("fp_per_image"))


def totals_differ(found: DataFrame, published: DataFrame, on: str = "label") -> DataFrame:
    """Classes whose (tp, fp, fn) aren't what a run published, as p_tp, p_fp, p_fn."""
    cols = ["tp", "fp", "fn"]
    both = found.select(on, *cols).join(published.select(on, *[F.col(c).alias(f"p_{c}") for c in cols]), on, "full_outer")
    same = F.lit(True)
    for c in cols:
        same = same & F.equal_null(c, f"p_{c}")
    return both.filter(~same)


def check_totals(found: DataFrame, published: DataFrame, on: str = "label") -> None:
    if bad := totals_differ(found, published, on).limit(20).collect():
        raise CountMismatch(f"counts differ for {[r[on] for r in bad]}")


def checked_slices(scores: DataFrame) -> DataFrame:
    """The scores, written; raises unless the slices of every kind add up to the whole."""
    scores = materialize(scores, "slices")
    cols = ["images", "labeled", "hits", "false_positives"]
    sums = scores.groupBy("by").agg(*[F.sum(c).alias(c) for c in cols])
    if sums.select(*cols).distinct().count() > 1:
        raise CountMismatch(f"slices don't add up: {sums.collect()}")
    return scores


def size_rows(images: DataFrame, labels: DataFrame, preds: DataFrame, matched: DataFrame, small: float, medium: float) -> DataFrame:
    """(bucket, labeled, hits, recall, false_positives): labels and misses by the label's size, false positives by their own."""
    def bucket(df):
        sized = df.join(images.select("image_id", "width", "height"), "image_id")
        return sized.withColumn("bucket", G.area_bucket(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("width"), F.col("height"), small, medium))

    taken = matched.filter("same")
    own = bucket(labels).join(taken.select("image_id", "label_ix", F.lit(1).alias("hit")), ["image_id", "label_ix"], "left")
    a = own.groupBy("bucket").agg(F.count("*").alias("labeled"), F.count("hit").alias("hits"))
    b = bucket(preds.join(taken.select("image_id", "pred_ix"), ["image_id", "pred_ix"], "left_anti")).groupBy("bucket").agg(F.count("*").alias("false_positives"))
    every = images.sparkSession.createDataFrame([("small",), ("medium",), ("large",)], "bucket string")
    out = F.broadcast(every).join(a, "bucket", "left").join(b, "bucket", "left").fillna(0, ["labeled", "hits", "false_positives"])
    return out.select("bucket", "labeled", "hits", F.when(F.col("labeled") > 0, F.col("hits") / F.col("labeled")).alias("recall"), "false_positives")


def feature_summary(features: DataFrame, group: str, values: list[str], quantiles: list[float]) -> DataFrame:
    """(group, feature, quantile, value): exact, linearly interpolated quantiles."""
    at = F.array(*[F.lit(q) for q in quantiles])
    wide = features.groupBy(group).agg(*[F.percentile(v, at).alias(v) for v in values])
    long_ = wide.select(group, F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).alias("qs")) for v in values])).alias("f"))
    return long_.select(group, "f.feature", F.posexplode(F.arrays_zip(at.alias("quantile"), F.col("f.qs").alias("value")))).select(group, "feature", F.col("col.quantile").alias("quantile"), F.col("col.value").alias("value"))


def error_items(images: DataFrame, labels: DataFrame, preds: DataFrame, matched: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(image_id, kind, score, x1, y1, x2, y2, fp_kind) of every false positive and miss; a miss has no score."""
    fp = preds.join(matched.select("image_id", "pred_ix"), ["image_id", "pred_ix"], "left_anti")
    if kinds is not None:
        fp = fp.join(kinds.select("image_id", "pred_ix", F.col("kind").alias("fp_kind")), ["image_id", "pred_ix"], "left")
    else:
        fp = fp.withColumn("fp_kind", F.lit(None).cast("string"))
    fn = labels.join(matched.select("image_id", "label_ix"), ["image_id", "label_ix"], "left_anti")
    a = fp.select("image_id", F.lit("false positive").alias("kind"), F.col("conf").alias("score"), *M.CORNERS, "fp_kind")
    return a.unionByName(fn.select("image_id", F.lit("miss").alias("kind"), F.lit(0.0).alias("score"), *M.CORNERS, F.lit(None).cast("string").alias("fp_kind")))


def review_sample(items: DataFrame, per_kind: int, seed: str, keys: list[str], group: tuple[str, ...] = ("dataset", "kind")) -> DataFrame:
    """Up to ``per_kind`` items of each group, by a hash of the seed and the item; the same on every run and engine."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *keys), 256), *keys))
    return items.withColumn("rank", rank).filter(F.col("rank") <= per_kind).drop("rank")


def review_counts(sample: DataFrame, verdicts: DataFrame, keys: list[str], allowed: list[str], group: tuple[str, ...] = ("dataset", "kind")) -> DataFrame:
    """(group, verdict, n) of a reviewed sample.

    Raises if a sampled item has no verdict, a verdict has no item, or a verdict isn't allowed.
    """
    check_review(sample, verdicts, keys, allowed)
    return sample.join(verdicts.select(*keys, "verdict"), keys).groupBy(*group, "verdict").agg(F.count("*").alias("n"))


def check_review(sample: DataFrame, verdicts: DataFrame, keys: list[str], allowed: list[str]) -> None:
    bad = verdicts.filter(~F.col("verdict").isin(allowed)).count()
    twice = verdicts.groupBy(*keys).count().filter("count > 1").count()
    missing = sample.join(verdicts, keys, "left_anti").count()
    stale = verdicts.join(sample, keys, "left_anti").count()
    if bad or twice or missing or stale:
        raise ValueError(f"review: {bad} unknown verdicts, {twice} repeated, {missing} missing, {stale} stale")


def gallery_candidates(items: DataFrame, n: int) -> DataFrame:
    """(kind, image_id, source, frame, score, rank): what a gallery of n tiles may show, best first of each kind.

    One error stands for an image and kind; sources take turns.  Only the first n of each source
    can be shown, so what is handed on is bounded by sources.
    """
    misses = items.filter("kind = 'miss'").groupBy("image_id").agg(F.count("*").alias("misses"))
    first = items.groupBy("image_id", "kind", "source", "frame").agg(F.max("score").alias("score")).join(misses, "image_id", "left")
    weight = F.when(F.col("kind") == "miss", -F.col("misses").cast("double")).otherwise(-F.col("score"))
    depth = F.row_number().over(W.partitionBy("kind", "source").orderBy(weight, "image_id"))
    kept = first.withColumn("depth", depth).filter(F.col("depth") <= n).withColumn("weight", weight)
    lead = F.min(F.struct("weight", "image_id")).over(W.partitionBy("kind", "source"))
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("depth", lead))).select("kind", "image_id", "source", "frame", "score", "rank")


def gallery_picks(items: DataFrame, n: int, exclude: tuple = (), min_gap: int = 0) -> list[tuple[str, object]]:
    """(kind, image_id) of n tiles: kinds alternate, the least shown source first, no near frames, one tile an image."""
    rows = gallery_candidates(items.filter(~F.col("image_id").isin(list(exclude))) if exclude else items, n + n * max(1, min_gap)).orderBy("kind", "rank").collect()
    left = {k: [r for r in rows if r["kind"] == k] for k in ("false positive", "miss")}
    turns, picks, shown = [k for k in left if left[k]], [], {}
    turn = 0
    while turns and len(picks) < n:
        kind = turns[turn % len(turns)]
        turn += 1
        seen = {p["image_id"] for p in picks}
        close = lambda r: r["frame"] is not None and any(p["source"] == r["source"] and p["frame"] is not None and abs(p["frame"] - r["frame"]) < min_gap for p in picks)
        open_ = [r for r in left[kind] if r["image_id"] not in seen and not close(r)]
        if not open_:
            turns.remove(kind)
            continue
        best = min(open_, key=lambda r: shown.get(r["source"], 0))
        picks.append(best)
        shown[best["source"]] = shown.get(best["source"], 0) + 1
    return [(p["kind"], p["image_id"]) for p in picks]
