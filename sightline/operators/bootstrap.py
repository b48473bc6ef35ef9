"""Percentile intervals by resampling whole units.

A resample draws as many units as there are, with replacement, by a hash of its number and the
place; so what it holds is (resample, unit, times), the same on every engine.  Images are matched
once and never repeated: recall is a sum of products, and average precision runs along the
predictions in order of confidence for many resamples at once, with a unit's times as weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.plans.indexing import with_index
from sightline.plans.store import materialize

#: Confidences are cut into a bin for every BIN_ROWS predictions.  A task takes a bin and RESAMPLES
#: resamples, in at most RUNS runs of RUN predictions or a multiple of that, and looks into LOOKS at once.
BIN_ROWS, RESAMPLES, RUN, RUNS, LOOKS, FEW_UNITS = 4096, 1000, 64, 1024, 8192, 256


def draw(units: DataFrame, resamples: int, seed: str) -> DataFrame:
    """(resample, unit, times): how often each of the distinct units of ``unit`` is drawn, zero left out."""
    spark = units.sparkSession
    named = with_index(units.select("unit").distinct(), "ix", "unit")
    n = named.count()
    pos = F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    places = spark.range(resamples).select(F.col("id").cast("int").alias("resample"), pos.alias("pos")) if n else spark.createDataFrame([], "resample int, pos int")
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("resample").cast("string"), F.col("pos").cast("string")), 256)
    ix = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(max(1, n))
    return places.withColumn("ix", ix).groupBy("resample", "ix").agg(F.count("*").alias("times")).join(named, "ix").select("resample", "unit", "times")


def unit_facts(units: DataFrame, labels: DataFrame, matched: DataFrame) -> DataFrame:
    """(unit, label, n, tp) of every unit and class."""
    n = labels.join(units, "image_id").groupBy("unit", "label").agg(F.count("*").alias("n"))
    tp = matched.join(units, "image_id").groupBy("unit", F.col("l_label").alias("label")).agg(F.count("*").alias("tp"))
    return n.join(tp, ["unit", "label"], "left").fillna(0, ["tp"])


def recalls(facts: DataFrame, times: DataFrame) -> DataFrame:
    """(resample, label, recall) from (resample, unit, times); resamples without a label of the class are absent."""
    joined = facts.join(times, "unit").groupBy("resample", "label").agg(F.sum(F.col("tp") * F.col("times")).alias("tp"), F.sum(F.col("n") * F.col("times")).alias("n"))
    return joined.filter("n > 0").select("resample", "label", (F.col("tp") / F.col("n")).alias("recall"))


def average_precisions(facts: DataFrame, labels: DataFrame, units: DataFrame, drawn: DataFrame) -> DataFrame:
    """(resample, label, iou_at, ap) from scored predictions (see metrics.score_order) and (resample, unit, times).

    Ties in confidence follow image and prediction; a unit drawn twice counts twice in place.
    Resamples without a label of the class are absent.
    """
    keys = ["label", "iou_at"]
    rows = materialize(facts.join(units, "image_id"), "facts")
    bins = max(16, -(-rows.count() // BIN_ROWS))
    rows = rows.withColumn("bin", F.floor(-F.col("conf") * bins).cast("long"))
    n = labels.join(units, "image_id").groupBy("label", "unit").agg(F.count("*").alias("n")).join(drawn, "unit").groupBy("resample", "label").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    totals = materialize(n.filter("n > 0"), "totals")
    by_unit = rows.groupBy(*keys, "bin", "unit").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")).join(drawn, "unit")
    weights = F.collect_list(F.struct("unit", "times")).alias("ws")
    sums = by_unit.groupBy(*keys, "bin", "resample").agg(F.sum(F.col("tp") * F.col("times")).alias("btp"), F.sum(F.col("n") * F.col("times")).alias("bn"), weights)
    before = W.partitionBy(*keys, "resample").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    at = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c[1:] + "0")
    begun = sums.select(*keys, "bin", "resample", at("btp"), at("bn"), "ws").join(totals, ["resample", "label"])
    begun = materialize(begun.withColumn("chunk", F.floor(F.col("resample") / RESAMPLES).cast("int")), "starts")
    # a bin's predictions meet the starts and weights of a chunk of resamples
    held = rows.join(begun.select(*keys, "bin", "chunk").distinct(), [*keys, "bin"]).select(*keys, "bin", (F.col("chunk") + 0).alias("chunk"), "conf", F.col("image_id").cast("string").alias("image"), "pred_ix", "unit", "tp")
    found = materialize(_walk(held, begun), "points")
    after = W.partitionBy(*keys, "resample").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    later = found.groupBy(*keys, "resample", "bin").agg(F.max("value").alias("top")).select(*keys, "resample", "bin", F.coalesce(F.max("top").over(after), F.lit(0.0)).alias("later"))
    area = found.filter("share > 0").join(later, [*keys, "resample", "bin"]).groupBy("resample", *keys).agg((F.sum(F.col("share") * F.greatest("value", "later")) / 101).alias("ap"))
    every = totals.select("resample", "label").join(facts.select(*keys).distinct(), "label")
    return every.join(area, ["resample", *keys], "left").select("resample", *keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _walk(held: DataFrame, begun: DataFrame) -> DataFrame:
    """(label, iou_at, bin, resample, share, value) of a bin: its best precision (share 0), and where recall
    points are reached (share of them) the best precision from there on in the bin.

    Runs of predictions are summed first.  A run is looked into only where a resample reaches a
    recall point in it, or where its hits, put before its misses, would beat the precision that is
    known to come between the recall point before it and the bin's end; so no maximum is missed.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        label, iou, bin_, _ = (k.as_py() for k in key)
        order = left.select(["image", "pred_ix"]).to_pandas().assign(conf=-left["conf"].to_numpy()).sort_values(["conf", "image", "pred_ix"], kind="stable").index.to_numpy()
        resample, lists = right["resample"].to_numpy(), right["ws"].combine_chunks()
        names, codes = np.unique(left["unit"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        told = lists.flatten()
        who = np.searchsorted(names, told.field("unit").to_numpy(zero_copy_only=False).astype(str))
        times = np.zeros((len(names) + 1, len(resample)))  # the last is of no unit
        times[who, np.repeat(np.arange(len(resample)), np.diff(lists.offsets.to_numpy()))] = told.field("times").to_numpy()
        step = RUN * -(-len(order) // (RUN * RUNS))
        runs = -(-len(order) // step)
        own = np.full(runs * step, len(names))
        own[: len(order)] = codes[order]
        hits = np.zeros(runs * step)
        hits[: len(order)] = left["tp"].to_numpy()[order]
        total, col = right["n"].to_numpy(), np.arange(len(resample))
        points = lambda c, n: np.where(c > 0, c * 100 // n + 1, 0)
        n = _summed(own, np.ones(len(own)), times, step)
        tp = _summed(own, hits, times, step)
        ctp, cn = right["tp0"].to_numpy() + np.cumsum(tp, axis=0), right["n0"].to_numpy() + np.cumsum(n, axis=0)
        ctp0, cn0 = ctp - tp, cn - n
        least = np.divide(ctp, cn, out=np.zeros_like(cn), where=tp > 0)
        most = np.divide(ctp, cn0 + tp, out=np.zeros_like(cn), where=tp > 0)
        reached = points(ctp, total) != points(ctp0, total)
        known = np.maximum.accumulate(least[::-1], axis=0)[::-1]
        begins = np.zeros(tp.shape, dtype=np.int64)
        begins[1:] = np.maximum.accumulate(np.where(reached, np.arange(1, runs + 1)[:, None], 0), axis=0)[:-1]
        look = reached | (most > np.take_along_axis(known, begins, axis=0))
        best, found = least, []
        at, who = np.nonzero(look)
        for i in range(0, len(at), LOOKS * RUN // step + 1):
            j, r = at[i : i + LOOKS * RUN // step + 1], who[i : i + LOOKS * RUN // step + 1]
            rows = j[:, None] * step + np.arange(step)
            w = times[own[rows], r[:, None]]
            hit = w * hits[rows]
            c = ctp0[j, r][:, None] + np.cumsum(hit, axis=1)
            precision = np.divide(c, cn0[j, r][:, None] + np.cumsum(w, axis=1), out=np.zeros_like(c), where=hit > 0)
            hull = np.maximum.accumulate(precision[:, ::-1], axis=1)[:, ::-1]
            best[j, r] = np.maximum(best[j, r], hull[:, 0])
            share = points(c, total[r][:, None]) - points(c - hit, total[r][:, None])
            x, y = np.nonzero(share)
            found.append((j[x], r[x], share[x, y], hull[x, y]))
        later = np.zeros((runs + 1, len(resample)))
        later[:-1] = np.maximum.accumulate(best[::-1], axis=0)[::-1]
        j, r, share, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4
        value = np.maximum(value, later[j + 1, r])
        r, share, value = np.r_[r, col], np.r_[share, np.zeros(len(col))], np.r_[value, later[0]]
        return pa.Table.from_arrays([pa.array([label] * len(r), pa.string()), pa.array([iou] * len(r), pa.float64()), pa.array([bin_] * len(r), pa.int64()), pa.array(resample[r], pa.int32()), pa.array(share.astype(np.int64)), pa.array(value, pa.float64())], names=["label", "iou_at", "bin", "resample", "share", "value"])

    groups = ["label", "iou_at", "bin", "chunk"]
    return held.groupBy(*groups).cogroup(begun.groupBy(*groups)).applyInArrow(run, "label string, iou_at double, bin long, resample int, share long, value double")


def _summed(own: np.ndarray, weights: np.ndarray, times: np.ndarray, step: int) -> np.ndarray:
    """Weights times draws, summed over runs of ``step`` rows: (runs, resamples)."""
    runs, units = len(own) // step, len(times)
    if units <= FEW_UNITS:
        return np.bincount(np.arange(len(own)) // step * units + own, weights=weights, minlength=runs * units).reshape(runs, units) @ times
    out = np.zeros((runs, times.shape[1]))
    for i in range(runs):
        rows = slice(i * step, (i + 1) * step)
        out[i] = weights[rows] @ times[own[rows]]
    return out


def percentile_interval(values: DataFrame, value: str, level: float, by: list[str]) -> DataFrame:
    """(by, low, high): linear percentiles of the values that aren't null."""
    tail = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    return values.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
