"""Scoring images as they arrive.

A row holds one image with its labels and predictions as arrays, so matching needs no state, no
watermark and no shuffle: the same greedy walk as in batch runs inside each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as G

BOXES = "array<struct<label:string,x1:double,y1:double,x2:double,y2:double>>"
PREDICTIONS = "array<struct<label:string,conf:double,x1:double,y1:double,x2:double,y2:double>>"


def _box(b: Column) -> G.Box:
    return b["x1"], b["y1"], b["x2"], b["y2"]


def match_arrays(labels: Column, preds: Column, iou: float) -> Column:
    """array<struct<label_ix, pred_ix, same, iou>> of one image: same class first, then IoU, then index."""
    numbered = lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("b")))
    pair = lambda la, p: F.struct((la["b"]["label"] != p["b"]["label"]).cast("int").alias("other"), (-G.iou(_box(la["b"]), _box(p["b"]))).alias("minus"), la["i"].alias("label_ix"), p["i"].alias("pred_ix"))
    pairs = F.flatten(F.transform(numbered(labels), lambda la: F.transform(numbered(preds), lambda p: pair(la, p))))
    near = F.array_sort(F.filter(pairs, lambda x: x["minus"] < -iou))
    kind = "array<struct<other:int,minus:double,label_ix:int,pred_ix:int>>"
    taken = lambda acc, x: F.exists(acc, lambda t: (t["label_ix"] == x["label_ix"]) | (t["pred_ix"] == x["pred_ix"]))
    walked = F.aggregate(near, F.array().cast(kind), lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.array_append(acc, x)))
    return F.transform(walked, lambda x: F.struct(x["label_ix"].alias("label_ix"), x["pred_ix"].alias("pred_ix"), (x["other"] == 0).alias("same"), (-x["minus"]).alias("iou")))


def score(images: DataFrame, confidence: float, iou: float, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keep, tp, fp, fn) of each image of (labels, preds) arrays, batch or stream."""
    hot = F.filter("preds", lambda p: p["conf"] >= confidence)
    matched = match_arrays(F.col("labels"), hot, iou)
    hits = F.size(F.filter(matched, lambda m: m["same"]))
    return images.select(*keep, hits.alias("tp"), (F.size(hot) - hits).alias("fp"), (F.size("labels") - hits).alias("fn"))
