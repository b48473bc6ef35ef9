"""Whole jobs: harmonizing, merging, and evaluating datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.config import ConfigError, Project, SplitMethod
from sightline.functions import names as N
from sightline.operators import bootstrap, hamming, matching, merge, metrics, splits, stats, threshold
from sightline.plans.store import materialize
from sightline.sources import files

SIZES = {"small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, float("inf"))}
COCO_IOUS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


def split_dataset(images: DataFrame, boxes: DataFrame, method: SplitMethod, project: Project) -> DataFrame:
    """Images of one dataset with split, unit and dropped, by its method; then those near test are dropped.

    Images have file_name, source_name, split, hash and image_id.
    """
    d, seed, fractions = project.near_distance, str(project.seed), project.splits.fractions.all
    if method.method == "temporal":
        recording, frame = (N.group_of(F.col("source_name"), method.recording_pattern, g) for g in ("recording", "frame"))
        rows = images.withColumn("recording", recording).withColumn("frame", frame.cast("long"))
        if lost := rows.filter("recording is null").agg(F.min("source_name")).first()[0]:
            raise ConfigError(f"{lost!r} does not match the recording pattern")
        cut = splits.temporal_split(rows.select("recording", "frame", "file_name"), project.splits.buffer_frames, project.splits.min_recording_images, fractions, method.train_only_pattern)
        out = images.drop("split").join(cut.select("file_name", "split", "unit", "dropped"), "file_name")
    elif method.method == "eval_only":
        out = splits.eval_only_split(images, method.recording_pattern, d).withColumn("dropped", F.lit(None).cast("string"))
    else:
        kept, copies = images, None
        if method.dedupe_copies:
            picked = materialize(splits.pick_copies(splits.copy_groups(images, boxes), boxes), "copies")
            copies = images.join(picked.filter("not keep").select("file_name"), "file_name", "left_semi")
            kept = images.join(picked.filter("not keep").select("file_name"), "file_name", "left_anti")
        out = splits.grouped_split(kept, method.recording_pattern, d, seed, fractions).withColumn("dropped", F.lit(None).cast("string"))
        if copies is not None:
            none = F.lit(None).cast("string")
            out = out.unionByName(copies.withColumn("split", none).withColumn("unit", none).withColumn("dropped", F.lit("copy")), allowMissingColumns=True)
    return splits.drop_near_test(materialize(out, "split"), d)


def harmonize(images: DataFrame, boxes: DataFrame, mapping: DataFrame, method: SplitMethod, project: Project) -> dict[str, DataFrame]:
    """Relabelled and re-split images and boxes, with their reports."""
    stats.check_mapped(boxes, mapping)
    counts = stats.label_counts(images, boxes, mapping)
    mapped = stats.map_labels(boxes, mapping)
    assigned = split_dataset(images, mapped, method, project)
    kept = assigned.filter("dropped is null")
    hamming.check_no_leak(kept, project.near_distance, "file_name")
    return {"images": kept, "boxes": mapped.join(kept.select("image_id"), "image_id", "left_semi"), "assigned": assigned, "summary": splits.split_summary(assigned.filter("split is not null")), "counts": counts}


class HeldOutLeak(ValueError):
    """A training image is a near duplicate of a held-out one."""


def near_held(planned: DataFrame, protected: DataFrame, d: int) -> DataFrame:
    """Merged training images with a view within d bits of a test or protected image; valid ones are left out."""
    kept = planned.filter("drop_reason is null")
    held = kept.filter("target_split = 'test'").select(F.col("views")[0].alias("hash")).union(protected.select("hash"))
    return hamming.near_any(kept.filter("target_split = 'train'"), held, d)


def check_train_apart(planned: DataFrame, protected: DataFrame, d: int) -> None:
    if n := near_held(planned, protected, d).count():
        raise HeldOutLeak(f"{n} training images are near held-out images")


def field_matches(images: DataFrame, field: DataFrame, d: int) -> DataFrame:
    """(file_name) of images that equal a field image byte for byte or have a view near one."""
    same = images.join(field.select("sha256"), "sha256", "left_semi").select("file_name")
    near = hamming.near_any(images.select("file_name", "views"), field, d).select("file_name")
    return same.union(near).distinct()


def check_field_test(images: DataFrame, field: DataFrame, d: int) -> None:
    if n := field_matches(images, field, d).count():
        raise HeldOutLeak(f"{n} images match field-test images")


def image_units(images: DataFrame, method: SplitMethod | None, d: int) -> DataFrame:
    """Images with the unit that the split kept together: themselves, their recording, or their group of related images.

    Groups are rebuilt from the images alone; whole groups went to one split, so a split's images
    give the same ones.
    """
    if method is None:
        return images.withColumn("unit", F.col("file_name"))
    if method.method != "temporal":
        return splits.leak_groups(images, method.recording_pattern, d)
    out = images.withColumn("unit", N.group_of(F.col("source_name"), method.recording_pattern, "recording"))
    if lost := out.filter("unit is null").agg(F.min("source_name")).first()[0]:
        raise ConfigError(f"{lost!r} does not match the recording pattern")
    return out


def check_units(units: DataFrame, recorded: int, limited: bool = False) -> None:
    """Raises if there aren't as many units as the split recorded; a limited run has fewer by design."""
    n = units.select("unit").distinct().count()
    if not limited and n != recorded:
        raise ConfigError(f"{n} units were rebuilt, the split recorded {recorded}")


def limited(images: DataFrame, n: int | None) -> DataFrame:
    """The first n images by file name, for a trial run; all without a limit."""
    return images if n is None else images.orderBy("file_name").limit(n)


def merge_sources(images: DataFrame, boxes: DataFrame, protected: DataFrame, held_scenes: DataFrame, patterns: list[tuple[str, str, bool]], project: Project) -> DataFrame:
    """The merge plan of all sources: blocked images are found, copies resolved, and the result checked.

    Images have dataset, split, file_name, source_name, image_id, sha256 and views (hashes, the
    untransformed one first); held scenes have (dataset, recording, frame).
    """
    cfg, d = project.merge, project.near_distance
    train_only = [k for k, s in cfg.sources.items() if s.role == "train_only"]
    rows = images.filter(F.col("dataset").isin(list(cfg.sources)))
    keepers = [k for k in cfg.sources if k not in train_only]
    there = {(r[0], r[1]) for r in rows.filter(F.col("dataset").isin(keepers)).select("dataset", "split").distinct().collect()}
    if lacking := sorted((k, s) for k in keepers for s in splits.SPLITS if (k, s) not in there):
        raise ConfigError(f"sources that keep their splits lack {lacking}")
    held = rows.filter(F.col("dataset").isin(keepers) & (F.col("split") != "train"))
    candidates = rows.filter(F.col("dataset").isin(train_only))
    guarded = protected.select("source_name", F.col("views")[0].alias("hash")).union(held.select("source_name", F.col("views")[0].alias("hash")))
    by_name = candidates.join(guarded.select("source_name").distinct(), "source_name", "left_semi").select("image_id", F.lit(True).alias("named"))
    told = merge.read_scenes(candidates, patterns).withColumn("dataset", F.col("scene_dataset"))
    by_scene = merge.same_scene(told, held_scenes, project.splits.buffer_frames).select("image_id", F.lit(True).alias("staged")).distinct()
    by_hash = hamming.near_any(candidates.select("image_id", "views"), guarded, d).select("image_id", F.lit(True).alias("close"))
    dedupe = [k for k, s in cfg.sources.items() if s.dedupe_copies]
    picked = splits.pick_copies(splits.copy_groups(rows.filter(F.col("dataset").isin(dedupe)), boxes), boxes).select("image_id", "copy_key", "keep")
    full = rows
    for side in (by_name, by_scene, by_hash, picked):
        full = full.join(side, "image_id", "left")
    full = full.withColumn("reason", merge.block_reason(F.col("named"), F.col("staged"), F.col("close"))).withColumn("keep", F.coalesce("keep", F.lit(True)))
    full = materialize(full.drop("named", "staged", "close"), "merge")
    plans = [merge.plan_merge(full.filter(F.col("dataset") == k), train_only, s.exclude_pattern, s.exclude_files) for k, s in cfg.sources.items()]
    planned = plans[0]
    for p in plans[1:]:
        planned = planned.unionByName(p)
    kept = merge.drop_exact(planned.filter("drop_reason is null"))
    planned = planned.join(kept.select("image_id", F.lit(True).alias("stays")), "image_id", "left")
    planned = planned.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("stays").isNull(), "exact_duplicate"))).drop("stays")
    planned = materialize(planned, "plan")
    check_train_apart(planned, protected.select(F.col("views")[0].alias("hash")), d)
    return planned


def score(labels: DataFrame, preds: DataFrame, classes: list[str], confidence: float, iou: float, thresholds: list[float]) -> dict[str, DataFrame]:
    """Every score of one split over the scored classes.

    per_class: (label, tp, fp, fn, precision, recall, map50, map50_95, and by size); overall is its
    mean over classes with labels.  Average precision uses all predictions, the rest those at or
    above the confidence.
    """
    labels, preds = matching.restrict(labels, classes), matching.restrict(preds, classes)
    hot = matching.above(preds, confidence)
    matched = materialize(matching.match_boxes(labels, hot, iou), "matched")
    per_class = metrics.precision_recall(labels, hot, iou)
    ap = metrics.average_precision(labels, preds, COCO_IOUS)
    at = ap.groupBy("label").agg(F.max(F.when(F.col("iou_at") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    per_class = per_class.join(at, "label", "left")
    for name, area in SIZES.items():
        own = metrics.average_precision(labels, preds, COCO_IOUS, area).groupBy("label").agg(F.avg("ap").alias(f"{name}_map50_95"))
        per_class = per_class.join(own, "label", "left")
    per_class = materialize(per_class, "scores")
    cols = ["map50", "map50_95", *[f"{s}_map50_95" for s in SIZES]]
    return {"per_class": per_class, "overall": per_class.agg(*[F.avg(c).alias(c) for c in cols]), "confusion": matching.confusion_matrix(labels, hot, matched), "curve": metrics.pr_curve(labels, preds, iou, thresholds), "matched": matched}


def intervals(labels: DataFrame, preds: DataFrame, units: DataFrame, confidence: float, drawn: DataFrame, level: float, iou: float = 0.5) -> DataFrame:
    """(label, metric, low, high) of recall and AP50 over resampled units; ``drawn`` is (resample, unit, times)."""
    matched = matching.match_same_class(labels, matching.above(preds, confidence), iou)
    recall = bootstrap.recalls(bootstrap.unit_facts(units, labels, matched), drawn)
    ap = bootstrap.average_precisions(metrics.score_order(labels, preds, [iou]), labels, units, drawn)
    both = recall.select("label", F.lit("recall").alias("metric"), F.col("recall").alias("v")).union(ap.select("label", F.lit("map50"), "ap"))
    return bootstrap.percentile_interval(both, "v", level, ["label", "metric"])


def choose_threshold(labels: DataFrame, preds: DataFrame, sets: DataFrame, held: DataFrame, units: DataFrame, project: Project, scored: str, fp_cost: float = 3, fn_cost: float = 1, band: float = 0.05) -> DataFrame:
    """One row: threshold, cost, band_low, band_high, neutral_threshold, neutral_cost, recall_low, recall_high.

    The threshold of least mean cost over the tuning ``sets`` (image_id, set_name), the band of
    thresholds as good, the cost at the neutral confidence, and the interval of recall at the chosen
    threshold on the ``held`` (image_id) images.
    """
    cfg, grid = project.evaluate, project.threshold.grid.values
    neutral = cfg.confidence
    steps = sorted({*grid, neutral})
    every = materialize(threshold.mean_costs(threshold.set_costs(labels, preds, sets, cfg.iou, steps, scored, fp_cost, fn_cost)), "costs")
    costs = every.filter(F.col("threshold").isin(grid))
    best = threshold.pick_threshold(costs).first()
    low, high = threshold.flat_band(costs, band).first()
    at_neutral = every.filter(F.col("threshold") == neutral).first()["cost"]
    own = matching.restrict(labels, [scored]).join(held, "image_id", "left_semi")
    hot = matching.above(matching.restrict(preds, [scored]), best["threshold"]).join(held, "image_id", "left_semi")
    kept = units.join(held, "image_id", "left_semi")
    facts = bootstrap.unit_facts(kept, own, matching.match_same_class(own, hot, cfg.iou))
    found = bootstrap.recalls(facts, bootstrap.draw(kept, cfg.resamples, str(project.seed)))
    interval = bootstrap.percentile_interval(found, "recall", cfg.level, ["label"])
    told = [F.lit(v).alias(n) for n, v in (("threshold", best["threshold"]), ("cost", best["cost"]), ("band_low", low), ("band_high", high), ("neutral_threshold", neutral), ("neutral_cost", at_neutral))]
    return interval.select(*told, F.col("low").alias("recall_low"), F.col("high").alias("recall_high"))


def evaluate(images: DataFrame, labels: DataFrame, preds: DataFrame, pred_images: DataFrame, units: DataFrame, labeled: list[str], trained: list[str], project: Project) -> dict[str, DataFrame]:
    """All reports of one run: the scored classes are limited first, then aligned, then the edge rule holds.

    Images have (image_id, width, height), units (image_id, unit).
    """
    cfg = project.evaluate
    scored = [c for c in labeled if c in trained]
    if not scored:
        raise ConfigError(f"the dataset labels {labeled} but the model knows {trained}")
    own = matching.top_k(preds.filter(F.col("conf") >= cfg.confidence_floor), cfg.predictions_per_image, scored)
    own = files.align(images, pred_images, own)
    limit = matching.per_image_limit(own, cfg.predictions_per_image, cfg.confidence)
    there = matching.restrict(labels, scored)
    if cfg.edge is not None and (edge := [c for c in cfg.edge.classes if c in scored]):
        there, own = matching.ignore_at_edge(there, own, images, edge, cfg.edge.tolerance_px, cfg.edge.min_overlap, cfg.iou)
    there, own = materialize(there, "labels"), materialize(own, "preds")
    out = score(there, own, scored, cfg.confidence, cfg.iou, cfg.curve.values)
    drawn = bootstrap.draw(units, cfg.resamples, str(project.seed))
    return out | {"per_image_limit": limit, "units": matching.unit_counts(units, there), "intervals": intervals(there, own, units, cfg.confidence, drawn, cfg.level, cfg.iou)}
