from __future__ import annotations

import hashlib
import random

import pytest

from sightline.operators import hamming, merge, reconcile, splits, stats
from sightline.operators.components import connected_components

PATTERN = r"^(?P<recording>.+)_(?P<frame>\d+)\.jpg$"


def near(spark, rows):
    return spark.createDataFrame(rows, "file_name string, hash long")


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def test_banded_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 7))) for b in base for _ in range(2)] + [0, (1 << 64) - 1, 1 << 63]
    df = near(spark, [(f"f{i:03d}", signed(v)) for i, v in enumerate(values)])
    for d in (0, 4, 7):
        want = {(f"f{i:03d}", f"f{j:03d}", (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= d}
        assert {tuple(r) for r in hamming.near_pairs(df, d, "file_name").collect()} == want
    with pytest.raises(ValueError, match="smaller distance"):
        hamming.near_pairs(df, 20, "file_name")


def test_longer_keys_find_the_same_pairs(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << k for k in rng.sample(range(64), 4)) for v in values]
    df = near(spark, [(str(i), signed(v)) for i, v in enumerate(values)])
    want = {(signed(a), signed(b)) for a in values for b in values if (a ^ b).bit_count() <= 4}
    for m in (1, 2, 3, 4):
        posted = [df.select(hamming.F.col("hash").alias(n), hamming.F.explode(hamming.keys(hamming.F.col("hash"), 4, m)).alias("k")) for n in "ab"]
        found = posted[0].join(posted[1], "k").select("a", "b").distinct().filter("bit_count(a ^ b) <= 4")
        assert {tuple(r) for r in found.collect()} == want
    assert [hamming.blocks_to_agree(n, 4) for n in (1000, 10**6, 10**8, 10**12)] == [1, 2, 3, 4]


def test_pairs_are_counted_without_being_made(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("xy"), rng.choice(["train", "test"]), rng.choice([0, 1, 3, 1 << 40, 7 << 20])) for i in range(80)] + [(99, "x", "train", None)]
    df = spark.createDataFrame(rows, "id int, dataset string, split string, hash long")
    get = lambda f: {(r["kind"], r["side_a"], r["side_b"]): r["n"] for r in f.collect()}
    assert get(hamming.count_pairs(df, 1)) == get(hamming.summarize_pairs(hamming.near_pairs(df, 1, "id"), df, "id"))


def test_copies_are_linked_but_not_expanded(spark):
    df = near(spark, [(f"f{i:04d}", 5 if i < 300 else i * 977) for i in range(320)])
    links = hamming.near_links(df, 0, "file_name")
    assert links.count() == 299
    found = connected_components(links).collect()
    assert {r["component"] for r in found} == {"f0000"} and len(found) == 300


def test_near_any_sees_every_view(spark):
    cand = spark.createDataFrame([("a", [1, 2]), ("b", [1 << 40, 7]), ("c", [])], "file_name string, views array<long>")
    prot = spark.createDataFrame([(6,)], "hash long")
    assert [r["file_name"] for r in hamming.near_any(cand, prot, 1).collect()] == ["a", "b"] or {r["file_name"] for r in hamming.near_any(cand, prot, 1).collect()} == {"a", "b"}


def test_a_leak_raises(spark):
    df = spark.createDataFrame([("a", "train", 1), ("b", "test", 3), ("c", "valid", 1 << 50)], "file_name string, split string, hash long")
    hamming.check_no_leak(df, 0, "file_name")
    with pytest.raises(hamming.SplitLeak, match="1 rows near a test row, first a"):
        hamming.check_no_leak(df, 1, "file_name")


def test_components_of_paths_rings_and_strings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(i, i + 7) for i in range(0, 60, 7)] + [(3, 3), (9, 3)] + [(900 + a, 900 + b) for a in range(6) for b in range(6)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(0, 60, 7)) and got[9] == got[3] == 3 and got[905] == 900
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def frames(spark, n, rec="r", start=0):
    return spark.createDataFrame([(rec, start + i, f"{rec}_{i:03d}.jpg") for i in range(n)], "recording string, frame long, file_name string")


def cut(n, f=(0.7, 0.15, 0.15)):
    a = min(round(n * f[0]), n - 2)
    return a, min(max(a + round(n * f[1]), a + 1), n - 1)


def test_temporal_split_and_buffer(spark):
    for n in (5, 6, 20, 37):
        a, b = cut(n)
        rows = splits.temporal_split(frames(spark, n), 2, 5).orderBy("frame").collect()
        want = ["train" if i < a else "valid" if i < b else "test" for i in range(n)]
        assert [r["split"] for r in rows] == want
        gone = {i for i in range(n) if (i < a and a - i <= 2) or (a <= i < b and b - i <= 2)}
        assert {i for i, r in enumerate(rows) if r["dropped"] == "buffer"} == gone and {r["unit"] for r in rows} == {"r"}
    assert {r["split"] for r in splits.temporal_split(frames(spark, 4), 2, 5).collect()} == {"train"}
    assert {r["split"] for r in splits.temporal_split(frames(spark, 30, "lab1"), 2, 5, train_only="lab").collect()} == {"train"}


def test_leak_groups_join_by_name_recording_and_hash(spark):
    rows = [("a", "m_1.jpg", 0b1110111 << 8), ("b", "m_2.jpg", 1 << 60), ("c", "x", 1 << 20), ("d", "x", 1 << 30), ("e", "y", (1 << 30) | 1), ("f", "z", 0b11111 << 40)]
    df = spark.createDataFrame(rows, "file_name string, source_name string, hash long")
    got = {r["file_name"]: r["unit"] for r in splits.leak_groups(df, PATTERN, 1).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f"}


def test_groups_fill_the_emptiest_split(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(1, 9) for _ in range(60)]
    rows = [(f"u{g:02d}", f"u{g:02d}_{k}") for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "unit string, file_name string")
    total, filled, want = len(rows), dict.fromkeys(splits.SPLITS, 0), {}
    goal = dict(zip(splits.SPLITS, (f * total for f in splits.FRACTIONS)))
    for g in sorted(range(60), key=lambda g: (-sizes[g], hashlib.sha256(f"s:u{g:02d}_0".encode()).hexdigest())):
        best = max(splits.SPLITS, key=lambda s: ((goal[s] - filled[s]) / goal[s], -splits.SPLITS.index(s)))
        filled[best] += sizes[g]
        want[f"u{g:02d}"] = best
    assert {r["unit"]: r["split"] for r in splits.assign_groups(df, "s").collect()} == want


def test_copies_keep_the_least_rotated(spark):
    images = spark.createDataFrame([("1", "train", "b.jpg", "s"), ("2", "train", "a.jpg", "s"), ("3", "train", "c.jpg", "s"), ("4", "valid", "d.jpg", "s"), ("5", "train", "e.jpg", "s")], "image_id string, split string, file_name string, source_name string")
    boxes = spark.createDataFrame([("1", "fuel", 2.0, 2.0), ("2", "fuel", 2.0, 2.0), ("3", "fuel", 3.0, 3.0), ("4", "fuel", 1.0, 1.0)], "image_id string, label string, w double, h double")
    got = {r["file_name"]: r["keep"] for r in splits.pick_copies(splits.copy_groups(images, boxes), boxes).collect()}
    assert got == {"a.jpg": True, "b.jpg": False, "c.jpg": False, "e.jpg": True}


def test_merge_drops_in_order(spark):
    cols = "dataset string, split string, file_name string, source_name string, copy_key string, keep boolean, reason string"
    rows = [
        ("beta", "train", "1.jpg", "n1", "k1", True, "same_scene"), ("beta", "train", "2.rf.x.jpg", "n1", "k1", False, None), ("beta", "train", "3.jpg", "n2", "k2", False, None), ("beta", "train", "4.jpg", "n2", "k2", True, None),
        ("beta", "valid", "5.jpg", "bad", None, True, None), ("beta", "test", "6.jpg", "n5", None, True, "near_protected"), ("alpha", "test", "7.jpg", "bad", None, True, None), ("alpha", "valid", "8.jpg", "n8", None, True, "source_name"),
    ]
    got = {r["file_name"]: (r["target_split"], r["drop_reason"], r["merged_name"]) for r in merge.plan_merge(spark.createDataFrame(rows, cols), ["beta"], "bad").collect()}
    assert got["1.jpg"][:2] == ("train", "same_scene") and got["2.rf.x.jpg"] == ("train", "same_scene", "beta__2_rf_x.jpg")
    assert got["3.jpg"][1] == "copy" and got["4.jpg"][1] is None and got["5.jpg"][1] == "excluded" and got["6.jpg"][1] == "near_protected"
    assert got["7.jpg"][:2] == ("test", None) and got["8.jpg"][:2] == ("valid", None)


def test_scene_rules(spark):
    held = spark.createDataFrame([("a", "r1", 10), ("a", "r1", 12), ("g", "mp4", None)], "dataset string, recording string, frame long")
    cand = spark.createDataFrame([(1, "r1_0007.jpg"), (2, "r1_0008.jpg"), (3, "r1_0030.jpg"), (4, "r2_0011.jpg"), (5, "mp4-3.jpg")], "n int, source_name string")
    told = merge.read_scenes(cand, [("a", PATTERN, True), ("g", r"^(?P<recording>mp4)-\d+\.jpg$", False)]).withColumnRenamed("scene_dataset", "dataset")
    assert {r["n"] for r in merge.same_scene(told, held, 2).collect()} == {2, 3, 5}


def test_unmapped_labels_raise_with_all_names(spark):
    boxes = spark.createDataFrame([("1", "ball"), ("1", "car"), ("2", "bot"), ("2", "tree")], "image_id string, label string")
    mapping = spark.createDataFrame([("ball", "fuel"), ("bot", "DROP")], "label string, target string")
    with pytest.raises(stats.UnmappedLabel, match=r"\['car', 'tree'\]"):
        stats.check_mapped(boxes, mapping)
    assert [tuple(r) for r in stats.map_labels(boxes, mapping).collect()] == [("1", "fuel")]


def test_export_problems(spark):
    kind = "split string, histogram array<struct<label:string,n:long>>"
    want = spark.createDataFrame([("a.rf." + "0" * 32 + ".jpg", "train", [("fuel", 1)]), ("b.png", "valid", []), ("c.jpg", "test", [("fuel", 2)]), ("d.jpg", "train", [])], f"file_name string, {kind}")
    got = spark.createDataFrame([("a_jpg.rf." + "f" * 32 + ".jpg", "train", [("fuel", 1)]), ("a.jpg", "train", [("fuel", 3)]), ("b.jpg", "test", []), ("c.jpg", "test", [("fuel", 1)]), ("x.jpg", "test", [])], f"source_name string, {kind}")
    reconcile.check_keys(want)
    plain = {(r["problem"], r["name"]) for r in reconcile.compare_export(want, got).collect()}
    assert plain == {("extra", "a_jpg.rf." + "f" * 32 + ".jpg"), ("boxes_changed", "a.rf." + "0" * 32 + ".jpg"), ("moved", "b.png"), ("boxes_changed", "c.jpg"), ("extra", "x.jpg"), ("missing", "d.jpg")}
    loose = {(r["problem"], r["name"]) for r in reconcile.compare_export(want, got, augmented=True).collect()}
    assert loose == {("moved", "b.png"), ("boxes_changed", "c.jpg"), ("extra", "x.jpg"), ("missing", "d.jpg")}
    with pytest.raises(reconcile.AmbiguousKey):
        reconcile.check_keys(want.union(want))
