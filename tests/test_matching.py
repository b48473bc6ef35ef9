from __future__ import annotations

import itertools
import os
import random

import pytest

from sightline import queries
from sightline.operators import bootstrap, diagnose, matching, metrics, threshold

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LABELS = "image_id string, label_ix long, label string, x1 double, y1 double, x2 double, y2 double"
PREDS = "image_id string, pred_ix long, label string, conf double, x1 double, y1 double, x2 double, y2 double"
A, B, C, FAR = (0.0, 0.0, 10.0, 10.0), (20.0, 20.0, 30.0, 30.0), (40.0, 40.0, 50.0, 50.0), (50.0, 0.0, 60.0, 10.0)


def frames(spark, labels, preds):
    return spark.createDataFrame([(i, n, c, *b) for i, n, c, b in labels], LABELS), spark.createDataFrame([(i, n, c, s, *b) for i, n, c, s, b in preds], PREDS)


@pytest.fixture
def mixed(spark):
    """Three images: a hit and a far box, a low-scored hit, and a box where nothing is labelled."""
    labels = [("1", 0, "fuel", A), ("1", 1, "fuel", B), ("2", 0, "fuel", C)]
    preds = [("1", 0, "fuel", 0.9, A), ("1", 1, "fuel", 0.8, FAR), ("2", 0, "fuel", 0.2, C), ("3", 0, "fuel", 0.7, B)]
    return frames(spark, labels, preds)


def test_counts_of_a_known_case(mixed):
    labels, preds = mixed
    hot = matching.above(preds, 0.5)
    m = matching.match_boxes(labels, hot, 0.5)
    assert [tuple(r) for r in matching.error_counts(labels, hot, m).collect()] == [("fuel", 1, 2, 2)]
    cells = {(r["true_label"], r["pred_label"]): r["n"] for r in matching.confusion_matrix(labels, hot, m).collect()}
    assert cells == {("fuel", "fuel"): 1, ("fuel", "background"): 2, ("background", "fuel"): 2}
    r = metrics.precision_recall(labels, hot, 0.5).first()
    assert (round(r["precision"], 3), round(r["recall"], 3)) == (0.333, 0.333)


def test_curve_of_a_known_case(mixed):
    labels, preds = mixed
    got = {r["threshold"]: (None if r["precision"] is None else round(r["precision"], 3), round(r["recall"], 3)) for r in metrics.pr_curve(labels, preds, 0.5, [0.1, 0.5, 0.85, 0.95]).collect()}
    assert got == {0.1: (0.5, 0.667), 0.5: (0.333, 0.333), 0.85: (1.0, 0.333), 0.95: (None, 0.0)}


def test_an_overlap_of_exactly_the_threshold(spark):
    labels, preds = frames(spark, [("1", 0, "fuel", A)], [("1", 0, "fuel", 0.9, (0.0, 0.0, 10.0, 5.0))])
    assert matching.match_boxes(labels, preds, 0.5).count() == 0  # strictly above
    assert matching.match_same_class(labels, preds, 0.5).count() == 1  # at or above


def test_the_same_class_goes_before_a_better_overlap(spark):
    labels, preds = frames(spark, [("1", 0, "fuel", A)], [("1", 0, "robot", 0.9, A), ("1", 1, "fuel", 0.9, (0.0, 0.0, 10.0, 8.0))])
    assert [(r["pred_ix"], r["same"]) for r in matching.match_boxes(labels, preds, 0.5).collect()] == [(1, True)]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def scene(seed, n=6):
    rng = random.Random(seed)

    def box():
        x, y, w, h = rng.randrange(30), rng.randrange(30), rng.choice([0, 8, 10, 12]), rng.choice([8, 10])
        return (float(x), float(y), float(x + w), float(y + h))

    labels, preds = [], []
    for i in range(n):
        own = [box() for _ in range(rng.randrange(4))]
        labels += [(f"i{i}", k, rng.choice(["fuel", "robot"]), b) for k, b in enumerate(own)]
        for k in range(rng.randrange(7)):
            b = box() if not own or rng.random() < 0.3 else tuple(v + rng.choice([0, 0, 1, 2]) for v in rng.choice(own))
            preds.append((f"i{i}", k, rng.choice(["fuel", "robot"]), rng.choice([0.2, 0.5, 0.5, 0.9]), b if b[2] >= b[0] and b[3] >= b[1] else own[0]))
    return labels, preds


def greedy(pairs):
    used, out = set(), []
    for key, *_ in sorted((k, ) for k in pairs):
        la, p = key[-2], key[-1]
        if ("l", *la) not in used and ("p", *p) not in used:
            used |= {("l", *la), ("p", *p)}
            out.append((la, p))
    return out


def test_matching_equals_a_plain_walk(spark):
    for seed in range(4):
        labels, preds = scene(seed)
        gt, pd = frames(spark, labels, preds)
        loose = [((lc != pc, -iou(lb, pb), k, j), (i, k), (i, j)) for i, k, lc, lb in labels for i2, j, pc, s, pb in preds if i == i2 and iou(lb, pb) > 0.4]
        want = sorted((la[0], la[1], p[1]) for la, p in greedy([(key, la, p) for key, la, p in loose]))
        assert sorted((r["image_id"], r["label_ix"], r["pred_ix"]) for r in matching.match_boxes(gt, pd, 0.4).collect()) == want
        n = {c: sum(x[2] == c for x in preds) for c in ("fuel", "robot")}
        counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in matching.error_counts(gt, pd, matching.match_boxes(gt, pd, 0.4)).collect()}
        for c, (tp, fp, _) in counts.items():
            assert tp + fp == n[c]


def plain_ap(labels, preds, label, t):
    gts, n = {}, 0
    for i, k, c, b in labels:
        if c == label:
            gts.setdefault(i, {})[k] = b
            n += 1
    rows, used = [], set()
    for i, j, c, s, b in sorted((p for p in preds if p[2] == label), key=lambda p: (-p[3], p[0], p[1])):
        best = max(((iou(g, b), -k) for k, g in gts.get(i, {}).items() if (i, k) not in used and iou(g, b) >= t), default=None)
        if best:
            used.add((i, -best[1]))
        rows.append(best is not None)
    tp, precision, ends = 0, [], []
    for n_, hit in enumerate(rows, 1):
        tp += hit
        precision.append(tp / n_)
        ends.append(tp)
    total = 0.0
    for k in range(101):
        at = next((i for i, c in enumerate(ends) if c * 100 >= k * n), None)
        total += 0 if at is None else max(precision[at:])
    return total / 101 if n else None


def test_average_precision_equals_the_101_point_rule(spark):
    for seed in range(3):
        labels, preds = scene(seed, 12)
        gt, pd = frames(spark, labels, preds)
        got = {(r["label"], r["iou_at"]): r["ap"] for r in metrics.average_precision(gt, pd, [0.5, 0.75]).collect()}
        for label, t in itertools.product(("fuel", "robot"), (0.5, 0.75)):
            want = plain_ap(labels, preds, label, t)
            assert (label, t) not in got if want is None else got[label, t] == pytest.approx(want)


def test_average_precision_by_size(mixed):
    labels, preds = mixed
    assert metrics.average_precision(labels, preds, [0.5], area=(0, 50)).count() == 0  # no label of that size
    assert metrics.average_precision(labels, preds, [0.5], area=(50, 500)).first()["ap"] == pytest.approx(metrics.average_precision(labels, preds, [0.5]).first()["ap"])


def test_areas_together_equal_areas_alone(spark):
    ious, areas = [0.3, 0.5, 0.75], {"all": (0.0, 1e18), "small": (0.0, 90.0), "large": (90.0, 1e18), "none": (1e17, 1e18)}
    for seed in range(3):
        gt, pd = frames(spark, *scene(seed, 30))
        got = {(r["area"], r["label"], r["iou_at"]): r["ap"] for r in metrics.average_precision_of_areas(gt, pd, ious, areas).collect()}
        want = {(a, r["label"], r["iou_at"]): r["ap"] for a, own in areas.items() for r in metrics.average_precision(gt, pd, ious, own).collect()}
        assert got == pytest.approx(want) and len({v for v in want.values()}) > 5


def test_sizes_are_matched_once(spark, monkeypatch):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    calls, joined = [], metrics.M.greedy
    monkeypatch.setattr(metrics.M, "greedy", lambda *a: calls.append(a) or joined(*a))
    queries.QUERIES["average_precision_by_size"](spark, FOLDER)
    assert len(calls) <= 1


def test_false_positive_kinds(spark):
    labels = [("1", 0, "fuel", A), ("1", 1, "robot", C)]
    preds = [("1", 0, "fuel", 0.9, A), ("1", 1, "fuel", 0.8, (0.0, 0.0, 10.0, 9.0)), ("1", 2, "fuel", 0.7, (6.0, 0.0, 16.0, 10.0)), ("1", 3, "fuel", 0.6, (44.0, 44.0, 46.0, 46.0)), ("1", 4, "fuel", 0.5, FAR)]
    gt, pd = frames(spark, labels, preds)
    got = {r["pred_ix"]: r["kind"] for r in matching.false_positive_kinds(gt, pd, 0.5, 0.1, "fuel", matching.restrict(gt, ["robot"])).collect()}
    assert got == {1: "duplicate", 2: "localization", 3: "inside_unscored", 4: "background"}


def test_edge_labels_and_what_lies_on_them_are_ignored(spark):
    labels = [("1", 0, "fuel", (0.0, 20.0, 10.0, 30.0)), ("1", 1, "fuel", (5.0, 20.0, 15.0, 30.0)), ("1", 2, "robot", (0.0, 0.0, 9.0, 9.0))]
    preds = [("1", 0, "fuel", 0.9, (0.0, 20.0, 9.0, 30.0)), ("1", 1, "fuel", 0.9, (5.0, 20.0, 15.0, 30.0)), ("1", 2, "robot", 0.9, (0.0, 0.0, 9.0, 9.0))]
    gt, pd = frames(spark, labels, preds)
    sizes = spark.createDataFrame([("1", 64.0, 64.0)], "image_id string, width double, height double")
    a, b = matching.ignore_at_edge(gt, pd, sizes, ["fuel"], 2, 0.5, 0.5)
    assert sorted(r["label_ix"] for r in a.collect()) == [1, 2] and sorted(r["pred_ix"] for r in b.collect()) == [1, 2]


def test_top_k_drops_other_classes_first_and_breaks_ties_by_order(spark):
    _, pd = frames(spark, [("1", 0, "fuel", A)], [("1", 0, "fuel", 0.5, A), ("1", 1, "robot", 0.9, A), ("1", 2, "fuel", 0.5, A), ("1", 3, "fuel", 0.7, A)])
    assert sorted(r["pred_ix"] for r in matching.top_k(pd, 2, ["fuel"]).collect()) == [0, 3]


def test_threshold_grid_pick_and_band(spark):
    assert metrics.threshold_range(0.05, 0.2, 0.05) == [0.05, 0.1, 0.15, 0.2]
    costs = spark.createDataFrame([(0.1, 3.0), (0.2, 1.0), (0.3, 1.04), (0.4, 1.0), (0.5, 2.0), (0.6, 1.0 + 1e-12)], "threshold double, cost double")
    assert threshold.pick_threshold(costs).first()["threshold"] == 0.6  # the higher one on a tie
    assert tuple(threshold.flat_band(costs.filter("threshold < 0.6"), 0.05).first()) == (0.2, 0.4)
    assert tuple(threshold.flat_band(costs, 0.05).first()) == (0.6, 0.6)


def test_bootstrap_without_variation_gives_the_score(spark, mixed):
    labels, preds = mixed
    units = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "image_id string, unit string")
    once = spark.createDataFrame([(r, f"u{p + 1}", 1) for r in range(3) for p in range(3)], "resample int, unit string, times long")
    facts = metrics.score_order(labels, preds, [0.5])
    ap = metrics.average_precision(labels, preds, [0.5]).first()["ap"]
    assert {round(r["ap"], 9) for r in bootstrap.average_precisions(facts, labels, units, once).collect()} == {round(ap, 9)}
    rec = bootstrap.recalls(bootstrap.unit_facts(units, labels, matching.match_same_class(labels, preds, 0.5)), once)
    got = bootstrap.percentile_interval(rec, "recall", 0.95, ["label"]).first()
    assert got["low"] == got["high"] == pytest.approx(2 / 3)
    drawn = bootstrap.draw(units, 50, "7")
    assert drawn.groupBy("resample").agg({"times": "sum"}).distinct().collect()[0][1] == 3 and drawn.count() > 75
    assert sorted(bootstrap.draw(units.repartition(3), 50, "7").collect()) == sorted(drawn.collect())


def test_average_precision_of_resamples_equals_repeating_them(spark):
    """Weights give what rows repeated as often as their unit was drawn give."""
    import random

    rng = random.Random(4)
    facts = [(f"i{i % 30:02}", rng.choice(["a", "b"]), i, round(rng.random(), 2), 0.5, int(rng.random() < 0.6)) for i in range(200)]
    labels = [(f"i{i % 30:02}", label) for i in range(260) for label in ("a", "b")]
    units = [(f"i{i:02}", f"u{i % 7}") for i in range(30)]
    drawn = [(r, f"u{u}", rng.randrange(1, 4)) for r in range(9) for u in range(7) if rng.random() < 0.6]
    frame = spark.createDataFrame
    got = bootstrap.average_precisions(frame(facts, "image_id string, label string, pred_ix long, conf double, iou_at double, tp long"), frame(labels, "image_id string, label string"), frame(units, "image_id string, unit string"), frame(drawn, "resample int, unit string, times long"))
    own, want = dict(units), {}
    for r in range(9):
        times = {u: t for n, u, t in drawn if n == r}
        for label in ("a", "b"):
            n = sum(times.get(own[i], 0) for i, k in labels if k == label)
            rows = [f for f in sorted((f for f in facts if f[1] == label), key=lambda f: (-f[3], f[0], f[2])) for _ in range(times.get(own[f[0]], 0))]
            ctp, points = 0, []
            for k, f in enumerate(rows, 1):
                ctp += f[5]
                points.append((ctp / n, ctp / k))
            if n:
                want[r, label] = sum(max((p for c, p in points if c >= t / 100 - 1e-12), default=0.0) for t in range(101)) / 101
    assert {(x["resample"], x["label"]): round(x["ap"], 9) for x in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_gallery_alternates_and_spreads(spark):
    rows = [("a1", "false positive", "s1", 1, 0.9), ("a2", "false positive", "s1", 2, 0.8), ("b1", "false positive", "s2", 1, 0.7), ("a1", "miss", "s1", 1, 0.0), ("c1", "miss", "s3", 9, 0.0), ("c1", "miss", "s3", 9, 0.0), ("b2", "miss", "s2", 50, 0.0)]
    items = spark.createDataFrame(rows, "image_id string, kind string, source string, frame long, score double")
    assert diagnose.gallery_picks(items, 4, min_gap=5) == [("false positive", "a1"), ("miss", "c1"), ("false positive", "b1"), ("miss", "b2")]
    assert diagnose.gallery_picks(items, 9, exclude=("a1",))[0] == ("false positive", "a2")
    assert diagnose.gallery_picks(items.limit(0), 3) == []


def test_review_guards(spark):
    sample = spark.createDataFrame([(1, "d", "k"), (2, "d", "k")], "id int, dataset string, kind string")
    verdicts = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, verdict string")
    assert {(r["verdict"], r["n"]) for r in diagnose.review_counts(sample, verdicts, ["id"], ["good", "bad"]).collect()} == {("good", 1), ("bad", 1)}
    for broken in (verdicts.limit(1), verdicts.union(verdicts), verdicts.union(spark.createDataFrame([(3, "good")], verdicts.schema))):
        with pytest.raises(ValueError, match="review"):
            diagnose.review_counts(sample, broken, ["id"], ["good", "bad"])


def test_totals_that_differ_raise(spark):
    found = spark.createDataFrame([("fuel", 1, 2, 3)], "label string, tp long, fp long, fn long")
    diagnose.check_totals(found, found)
    with pytest.raises(diagnose.CountMismatch):
        diagnose.check_totals(found, spark.createDataFrame([("fuel", 1, 2, 4)], found.schema))
