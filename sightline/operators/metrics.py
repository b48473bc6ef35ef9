"""Precision, recall, precision-recall curves and average precision.

Average precision needs running counts over all predictions of a class.  They are computed in two
levels, by confidence bin and within the bin, so that no task has to sort a whole class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sightline.functions import geometry as G
from sightline.operators import matching as M
from sightline.plans.store import materialize, settled

#: Confidence bins; a task of the areas holds the rows of a bin, and BLOCK of them with all their bits.
BINS, BLOCK = 1024, 8192


def precision_recall(labels: DataFrame, preds: DataFrame, iou: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(label, tp, fp, fn, precision, recall); precision is null without predictions, recall without labels."""
    counted = M.error_counts(labels, preds, M.match_same_class(labels, preds, iou, by).withColumn("same", F.lit(True)), by)
    ratio = lambda n, d: F.when(d > 0, n / d)
    return counted.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def at_levels(preds: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Predictions with ``level``, a place in the rising thresholds at which what a group keeps changes.

    A prediction reaches the first ``level`` thresholds.  Between two levels of a group nothing
    changes, so it is matched once a level and not once a threshold.
    """
    grid = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    placed = preds.withColumn("_reach", F.size(F.filter(grid, lambda t: t <= F.col("conf")))).filter("_reach > 0")
    levels = placed.groupBy(*keys).agg(F.array_sort(F.collect_set("_reach")).alias("_levels"))
    return placed.join(levels, keys).withColumn("level", F.explode(F.filter("_levels", lambda x: x <= F.col("_reach")))).drop("_reach", "_levels")


def over_thresholds(counts: DataFrame, thresholds: list[float], keys: list[str], by: list[str], values: list[str]) -> DataFrame:
    """(by, threshold, values): sums of what (keys, level) counts say, at every threshold.

    A count holds from the group's level before, without it, to its own.  Only its differences are
    summed, and then run along the thresholds.
    """
    below = F.coalesce(F.lag("level").over(W.partitionBy(*keys).orderBy("level")), F.lit(0))
    edges = F.array(F.struct((F.col("_from") + 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("level") + 1).alias("at"), F.lit(-1).alias("sign")))
    moved = counts.withColumn("_from", below).withColumn("_e", F.explode(edges)).groupBy(*by, F.col("_e.at").alias("at")).agg(*[F.sum(F.col(v) * F.col("_e.sign")).alias(v) for v in values])
    grid = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds), 1)])
    every = moved.select(*by).distinct().withColumn("_g", F.explode(grid)).select(*by, "_g.at", "_g.threshold")
    up = W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return every.join(moved, [*by, "at"], "left").select(*by, "threshold", *[F.sum(F.coalesce(v, F.lit(0))).over(up).alias(v) for v in values])


def pr_curve(labels: DataFrame, preds: DataFrame, iou: float, thresholds: list[float]) -> DataFrame:
    """Precision and recall of each class at each threshold."""
    keys = ["image_id", "label"]
    mine = materialize(at_levels(preds, thresholds, keys), "levels")
    tp = M.match_same_class(labels, mine, iou, ("level",)).groupBy("image_id", F.col("l_label").alias("label"), "level").agg(F.count("*").alias("tp"))
    counts = mine.groupBy(*keys, "level").agg(F.count("*").alias("np")).join(tp, [*keys, "level"], "left").fillna(0, ["tp"])
    found = over_thresholds(counts, thresholds, keys, ["label"], ["np", "tp"])
    total = labels.groupBy("label").agg(F.count("*").alias("nl"))
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    told = total.withColumn("threshold", grid).join(found, ["label", "threshold"], "full_outer").fillna(0, ["nl", "np", "tp"])
    ratio = lambda n, d: F.when(d > 0, n / d)
    fp, fn = F.col("np") - F.col("tp"), F.col("nl") - F.col("tp")
    kept = told.filter("nl > 0 or np > 0")
    return kept.select("threshold", "label", "tp", fp.alias("fp"), fn.alias("fn"), ratio(F.col("tp"), F.col("np")).alias("precision"), ratio(F.col("tp"), F.col("nl")).alias("recall"))


def threshold_range(start: float, stop: float, step: float) -> list[float]:
    return [round(start + i * step, 6) for i in range(round((stop - start) / step) + 1)]


def score_order(labels: DataFrame, preds: DataFrame, ious: list[float], area: tuple[float, float] | None = None) -> DataFrame:
    """Each prediction with ``tp`` at each IoU, matched in order of confidence to its best free label.

    With an area range, labels outside it and what matches them don't count, nor do unmatched
    predictions outside it.
    """
    inside = (lambda b: (G.area(b) >= area[0]) & (G.area(b) < area[1])) if area else (lambda b: F.lit(True))
    ix = ["image_id", "label"]
    a = labels.select(*ix, "label_ix", *[F.col(c).alias(f"l_{c}") for c in M.CORNERS])
    pairs = a.join(preds.select(*ix, "pred_ix", "conf", *M.CORNERS), ix).withColumn("iou", G.iou(G.box("l_"), G.box())).withColumn("out", ~inside(G.box("l_")))
    pairs = pairs.withColumn("iou_at", F.explode(F.filter(F.array(*[F.lit(t) for t in ious]), lambda t: t <= F.col("iou"))))
    order = [("conf", -F.col("conf")), ("pred", F.col("pred_ix")), ("out", F.col("out").cast("int")), ("iou", -F.col("iou")), ("label", F.col("label_ix"))]
    took = M.greedy(pairs, [*ix, "iou_at"], order, {"out": F.col("out")}).select(*ix, "iou_at", "pred_ix", "out")
    every = preds.select(*ix, "pred_ix", "conf", inside(G.box()).alias("inside")).withColumn("iou_at", F.explode(F.array(*[F.lit(t) for t in ious])))
    told = every.join(took, [*ix, "iou_at", "pred_ix"], "left").filter(F.when(F.col("out").isNull(), F.col("inside")).otherwise(~F.col("out")))
    return told.select("image_id", "label", "pred_ix", "conf", "iou_at", F.col("out").isNotNull().cast("long").alias("tp"))


def average_precision(labels: DataFrame, preds: DataFrame, ious: list[float], area: tuple[float, float] | None = None, by: tuple[str, ...] = (), facts: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(by, label, iou_at, ap): 101-point interpolated precision; null for a class without labels.

    ``facts`` and ``totals`` replace what would be computed from labels and predictions, for
    resampled or sliced rows.
    """
    by = list(by)
    facts = materialize(facts if facts is not None else score_order(labels, preds, ious, area), "facts")  # read four times below
    if totals is None:
        kept = labels.filter((G.area(G.box()) >= area[0]) & (G.area(G.box()) < area[1])) if area else labels
        totals = kept.groupBy("label").agg(F.count("*").alias("n"))
    keys = [*by, "label", "iou_at"]
    rank = [F.desc("conf"), "image_id", "pred_ix"]
    binned = facts.withColumn("bin", F.floor(-F.col("conf") * BINS))
    sums = binned.groupBy(*keys, "bin").agg(F.sum("tp").alias("btp"), F.count("*").alias("bn"))
    before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "bin", F.coalesce(F.sum("btp").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    up = W.partitionBy(*keys, "bin").orderBy(*rank).rowsBetween(W.unboundedPreceding, 0)
    run = binned.join(starts, [*keys, "bin"]).withColumn("ctp", F.col("tp0") + F.sum("tp").over(up)).withColumn("cn", F.col("n0") + F.count("*").over(up))
    run = run.withColumn("precision", F.col("ctp") / F.col("cn"))
    tops = run.groupBy(*keys, "bin").agg(F.max("precision").alias("top"))
    after = W.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "bin", F.max("top").over(after).alias("later"))
    down = W.partitionBy(*keys, "bin").orderBy(F.asc("conf"), F.desc("image_id"), F.desc("pred_ix")).rowsBetween(W.unboundedPreceding, 0)
    hull = run.join(tops, [*keys, "bin"]).withColumn("hull", F.greatest(F.max("precision").over(down), F.coalesce("later", F.lit(0.0))))
    on = [*[c for c in by if c in totals.columns], "label"]
    points = lambda c: F.expr(f"({c}) * 100 div n")
    share = F.col("hull") * (points("ctp") - points("ctp - 1") + F.when(F.col("ctp") == 1, 1).otherwise(0))
    summed = hull.join(F.broadcast(totals), on).filter("tp = 1 and n > 0").groupBy(*keys).agg((F.sum(share) / 101).alias("ap"))
    spark = totals.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(t),) for t in ious], "iou_at double"))
    told = totals if set(by) <= set(totals.columns) else totals.crossJoin(facts.select(*by).distinct())
    return told.filter("n > 0").crossJoin(grid).join(summed, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def score_bits(labels: DataFrame, preds: DataFrame, ious: list[float], areas: list[tuple[float, float]]) -> DataFrame:
    """(image_id, label, pred_ix, conf, tp, seen): what score_order says of every area and IoU, a bit for each.

    Bit ``a * len(ious) + k`` is for area a and the k-th rising IoU; a prediction counts where
    ``seen`` has it and hits where ``tp`` has it.  A pair whose label and prediction have no other
    pair is taken at every IoU it reaches; only the others are walked.
    """
    ious, ix = sorted(ious), ["image_id", "label"]
    if len(ious) * len(areas) > 62:
        raise ValueError("areas and IoUs don't fit the bits of a long")
    places = lambda b: F.filter(F.array(*[F.when((G.area(b) >= lo) & (G.area(b) < hi), F.lit(i)) for i, (lo, hi) in enumerate(areas)]), lambda i: i.isNotNull())
    left = lambda v, n: F.call_function("shiftleft", v, n)
    none, at = F.lit(0).cast("long"), range(len(areas))
    spread = lambda bits, want, where: sum((F.when(where(i) == want, left(bits, F.lit(i * len(ious)))).otherwise(none) for i in at), none)
    a = labels.select(*ix, "label_ix", *[F.col(c).alias(f"l_{c}") for c in M.CORNERS])
    pairs = a.join(preds.select(*ix, "pred_ix", "conf", *M.CORNERS), ix).withColumn("iou", G.iou(G.box("l_"), G.box()))
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ious]), lambda t: t <= F.col("iou")))
    listed = F.struct("label_ix", "pred_ix", "conf", "iou", reach.alias("reach"), places(G.box("l_")).alias("inside"))
    shared = lambda ps, x, *on: F.size(F.filter(ps, lambda y: sum(((y[c] == x[c]).cast("int") for c in on), F.lit(0)) > 0)) > 1
    groups = pairs.filter(F.col("iou") >= ious[0]).groupBy(*ix).agg(F.collect_list(listed).alias("ps"))
    groups = groups.withColumn("hard", F.filter("ps", lambda x: shared("ps", x, "label_ix", "pred_ix")))
    groups = materialize(groups.withColumn("wide", F.exists("hard", lambda x: shared("hard", x, "pred_ix"))), "pairs")
    easy = groups.select(*ix, F.explode(F.array_except("ps", "hard")).alias("m")).withColumn("bits", left(F.lit(1).cast("long"), F.col("m.reach")) - 1)
    held = lambda i: F.array_contains("m.inside", i)
    easy = easy.select(*ix, "m.pred_ix", spread(F.col("bits"), True, held).alias("tp"), spread(F.col("bits"), False, held).alias("gone"))
    # areas change the order only where a prediction has several labels to choose from
    hard = groups.filter(F.size("hard") > 0).withColumn("area", F.explode(F.when(F.col("wide"), F.array(*[F.lit(i) for i in at])).otherwise(F.array(F.lit(-1)))))
    hard = hard.withColumn("k", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("hard", lambda x: x["reach"])))))
    out = lambda x: F.when(F.col("area") < 0, 0).otherwise((~F.array_contains(x["inside"], F.col("area"))).cast("int"))
    order = lambda x: F.struct((-x["conf"]).alias("o0"), x["pred_ix"].alias("o1"), out(x).alias("o2"), (-x["iou"]).alias("o3"), x["label_ix"].alias("label_ix"), x["pred_ix"].alias("pred_ix"), x["inside"].alias("inside"))
    rows = hard.select(*ix, "area", "k", F.sort_array(F.transform(F.filter("hard", lambda x: x["reach"] >= F.col("k")), order)).alias("ps"))
    took = M.walk(rows, [*ix, "area", "k"]).withColumn("bits", left(F.lit(1).cast("long"), F.col("k") - 1))
    mine = lambda want: sum((F.when(F.col("area").isin(-1, i) & (held(i) == want), left(F.col("bits"), F.lit(i * len(ious)))).otherwise(none) for i in at), none)
    walked = took.select(*ix, "m.pred_ix", mine(True).alias("tp"), mine(False).alias("gone")).groupBy(*ix, "pred_ix").agg(F.bit_or("tp").alias("tp"), F.bit_or("gone").alias("gone"))
    own = spread(F.lit((1 << len(ious)) - 1).cast("long"), True, lambda i: F.array_contains(places(G.box()), i))
    every = preds.select(*ix, "pred_ix", "conf", own.alias("own")).join(easy.union(walked), [*ix, "pred_ix"], "left").fillna(0, ["tp", "gone"])
    seen = F.col("tp").bitwiseOR(F.col("own").bitwiseAND(F.bitwise_not(F.col("tp").bitwiseOR(F.col("gone")))))
    return every.select(*ix, "pred_ix", "conf", "tp", seen.alias("seen")).filter("seen <> 0")


def average_precision_of_areas(labels: DataFrame, preds: DataFrame, ious: list[float], areas: dict[str, tuple[float, float]]) -> DataFrame:
    """(area, label, iou_at, ap) as average_precision gives it for each area, from one matching and one order.

    All areas and IoUs run along the predictions of a confidence bin together.  A bin tells its
    best precision and its precisions from there on where a recall point is reached; the best of
    later bins is met afterwards.
    """
    spark, ious, width = labels.sparkSession, sorted(ious), len(ious) * len(areas)
    bin_ = F.coalesce(F.floor(-F.col("conf") * BINS).cast("long"), F.lit(1 << 62))
    facts = settled(spark, "facts", lambda: score_bits(labels, preds, ious, list(areas.values())).withColumn("bin", bin_))
    own = lambda i, area: F.struct(F.lit(i).alias("at"), ((G.area(G.box()) >= area[0]) & (G.area(G.box()) < area[1])).alias("there"))
    sized = labels.select("label", F.explode(F.array(*[own(i, a) for i, a in enumerate(areas.values())])).alias("s")).filter("s.there").groupBy("label", F.col("s.at").alias("at")).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("iou_at")) for k, t in enumerate(ious)]))
    names = F.element_at(F.array(*[F.lit(a) for a in areas]), F.col("at") + 1)
    totals = materialize(sized.withColumn("c", cells).select("label", names.alias("area"), "c.iou_at", (F.col("at") * len(ious) + F.col("c.k")).alias("col"), "n"), "totals")
    sums = facts.select("label", "bin", "tp", "seen").mapInArrow(lambda batches: _bit_sums(batches, width), "label string, bin long, col int, btp long, bn long")
    sums = sums.groupBy("label", "bin", "col").agg(F.sum("btp").alias("btp"), F.sum("bn").alias("bn"))
    before = W.partitionBy("label", "col").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("label", "bin", "col", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c[1:]}0") for c in ("btp", "bn")]).join(totals.select("label", "col", "n"), ["label", "col"])
    starts = materialize(starts, "starts")
    run = lambda key, left, right: _bit_walk(key, left, right, width)
    found = facts.groupBy("label", "bin").cogroup(starts.groupBy("label", "bin")).applyInArrow(run, "label string, bin long, col int, share long, value double")
    found = materialize(found, "points")
    after = W.partitionBy("label", "col").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    tops = found.groupBy("label", "col", "bin").agg(F.max("value").alias("top")).select("label", "col", "bin", F.coalesce(F.max("top").over(after), F.lit(0.0)).alias("later"))
    ap = found.filter("share > 0").join(tops, ["label", "col", "bin"]).groupBy("label", "col").agg((F.sum(F.col("share") * F.greatest("value", "later")) / 101).alias("ap"))
    return totals.join(ap, ["label", "col"], "left").select("area", "label", "iou_at", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[:, None] >> np.arange(width)) & 1


def _bit_sums(batches, width: int):
    """Hits and counted predictions of a task by (label, bin) and bit."""
    held: dict = {}
    for batch in batches:
        names = batch["label"].dictionary_encode()
        code, bin_ = names.indices.to_numpy(zero_copy_only=False), batch["bin"].to_numpy(zero_copy_only=False)
        order = np.lexsort((bin_, code))
        code, bin_ = code[order], bin_[order]
        edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (bin_[1:] != bin_[:-1])]) if len(order) else []
        both = np.concatenate([_bits(batch[c].to_numpy(zero_copy_only=False)[order], width) for c in ("tp", "seen")], axis=1)
        for i, own in zip(edges, np.add.reduceat(both, edges) if len(order) else [], strict=True):
            key = (names.dictionary[int(code[i])].as_py(), int(bin_[i]))
            held[key] = held.get(key, 0) + own
    for (label, at), own in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * width, pa.string()), pa.array([at] * width, pa.int64()), pa.array(np.arange(width, dtype=np.int32)), pa.array(own[:width], pa.int64()), pa.array(own[width:], pa.int64())], names=["label", "bin", "col", "btp", "bn"])


def _bit_walk(key, left: pa.Table, right: pa.Table, width: int) -> pa.Table:
    """A bin's best precision (share 0), and where recall points are reached (share) the best from there on in the bin."""
    label, bin_ = (k.as_py() for k in key)
    rows = left.select(["conf", "image_id", "pred_ix", "tp", "seen"]).sort_by([("conf", "descending"), ("image_id", "ascending"), ("pred_ix", "ascending")])
    hit, seen, cols = rows["tp"].to_numpy(), rows["seen"].to_numpy(), right["col"].to_numpy()
    start = {c: np.zeros(width, np.int64) for c in ("tp0", "n0", "n")}
    for c, own in start.items():
        own[cols] = right[c].to_numpy()
    blocks = [slice(i, i + BLOCK) for i in range(0, len(hit), BLOCK)]
    ctp0, cn0 = [start["tp0"]], [start["n0"]]
    for b in blocks:  # what has run before each block
        ctp0.append(ctp0[-1] + _bits(hit[b], width).sum(axis=0))
        cn0.append(cn0[-1] + _bits(seen[b], width).sum(axis=0))
    best, total, found = np.zeros(width), np.maximum(start["n"], 1), []
    points = lambda c: np.where(c > 0, c * 100 // total + 1, 0)
    for n, b in reversed(list(enumerate(blocks))):
        tp = _bits(hit[b], width)
        ctp, cn = ctp0[n] + np.cumsum(tp, axis=0), cn0[n] + np.cumsum(_bits(seen[b], width), axis=0)
        precision = np.where(tp > 0, ctp / np.maximum(cn, 1), 0.0)
        hull = np.maximum(np.maximum.accumulate(precision[::-1], axis=0)[::-1], best)
        best = hull[0]
        share = np.where((tp > 0) & (start["n"] > 0), points(ctp) - points(ctp - 1), 0)
        at, col = np.nonzero(share)
        found.append((col, share[at, col], hull[at, col]))
    there = np.flatnonzero(best > 0)
    found.append((there, np.zeros(len(there), np.int64), best[there]))
    col, share, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"label": pa.array([label] * len(col), pa.string()), "bin": pa.array([bin_] * len(col), pa.int64()), "col": pa.array(col, pa.int32()), "share": pa.array(share, pa.int64()), "value": pa.array(value, pa.float64())})


def round6(c: Column | str) -> Column:
    return F.round(c, 6)
