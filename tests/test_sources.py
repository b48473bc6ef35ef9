from __future__ import annotations

import hashlib
import io
import json

import pytest

from sightline.sources import coco, files


def annotation_file(images, anns):
    return {"categories": [{"id": 0, "name": "placeholder", "supercategory": "none"}, {"id": 1, "name": "fuel", "supercategory": "x"}, {"id": 2, "name": "robot", "supercategory": "x"}], "images": images, "annotations": anns}


def image(i, name, extra=None):
    return {"id": i, "file_name": name, "width": 64, "height": 48} | ({"extra": {"name": extra}} if extra else {})


def ann(i, img, cat, box):
    return {"id": i, "image_id": img, "category_id": cat, "bbox": box, "area": box[2] * box[3], "iscrowd": 0}


@pytest.fixture
def folder(tmp_path):
    for split, content in {"train": annotation_file([image(5, "b.jpg"), image(2, "a.jpg", "orig")], [ann(0, 2, 1, [1, 2, 3, 4]), ann(1, 2, 2, [0.5, 0, 10, 10])]), "valid": annotation_file([image(2, "c.jpg")], [ann(0, 2, 2, [0, 0, 5, 5])])}.items():
        (tmp_path / split).mkdir()
        (tmp_path / split / coco.ANNOTATIONS).write_text(json.dumps(content))
    return tmp_path


def test_scan_keeps_empty_images_and_names(spark, folder):
    images, boxes = coco.scan(spark, f"file://{folder}", "alpha")
    got = {(r["split"], r["file_name"]): (r["source_name"], r["width"], r["height"]) for r in images.collect()}
    assert got == {("train", "b.jpg"): ("b.jpg", 64, 48), ("train", "a.jpg"): ("orig", 64, 48), ("valid", "c.jpg"): ("c.jpg", 64, 48)}
    assert sorted((r["image_id"], r["label"], r["x"], r["x2"]) for r in boxes.collect()) == [("alpha/train/2", "fuel", 1.0, 4.0), ("alpha/train/2", "robot", 0.5, 10.5), ("alpha/valid/2", "robot", 0.0, 5.0)]


def test_files_are_read_in_parts():
    text = json.dumps({"info": {"images": [9]}, "images": [{"id": i, "n": "a,]}" * i + '"\\é'} for i in range(40)], "none": None, "preds": {f"k{i}": [[i, -1.5e3]] for i in range(9)}, "void": [], "last": 12}, indent=1)
    for size in (1, 7, 1 << 20):
        at, most = 0, 0

        def read(n, size=size):
            nonlocal at, most
            at, most = at + min(n, size), max(most, n)
            return text[at - min(n, size) : at]

        got = list(files.members(read, ("images", "preds", "void", "none")))
        assert [json.loads(v) for k, _, _, v in got if k == "images"] == json.loads(text)["images"]
        assert {n: json.loads(v) for k, _, n, v in got if k == "preds"} == json.loads(text)["preds"]
        assert [p for k, p, _, _ in got if k == "images"] == list(range(40)) and len(got) == 49
    for bad in ("", "[1]", '{"images": [1 2]}', '{"images": [1,', '{"images": 3}', '{"images": [{"a": }]}'):
        with pytest.raises(ValueError):
            list(files.members(io.StringIO(bad).read, ("images",)))


def test_no_task_holds_a_whole_file(spark, folder, tmp_path, monkeypatch):
    """Neither annotations nor a cache go through a column of whole texts."""
    def whole(*a, **k):
        raise AssertionError("read whole")

    monkeypatch.setattr(files, "read_texts", whole)
    monkeypatch.setattr(type(spark.read), "text", whole)
    images, boxes = coco.scan(spark, str(folder), "set")
    assert images.count() and boxes.count()
    (tmp_path / "c.json").write_text('{"confidence_floor": 0.1, "images": {"a": [["fuel", 0.5, 1, 2, 3, 4]], "b": []}}')
    preds, ran = files.read_predictions(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in preds.collect()] == [("a", 0, "fuel", 0.5, 1.0, 2.0, 3.0, 4.0)] and ran.count() == 2


@pytest.mark.parametrize(("img", "cat", "word"), [(9, 1, "image"), (2, 7, "category")])
def test_dangling_annotations_raise(spark, folder, img, cat, word):
    (folder / "valid" / coco.ANNOTATIONS).write_text(json.dumps(annotation_file([image(2, "c.jpg")], [ann(3, img, cat, [0, 0, 1, 1])])))
    with pytest.raises(coco.BadAnnotation, match=f"annotation 3 of valid has an unknown {word}"):
        coco.scan(spark, f"file://{folder}", "alpha")


def test_written_files_come_back(spark, folder, tmp_path):
    images, boxes = coco.scan(spark, f"file://{folder}", "alpha")
    out = tmp_path / "out"
    coco.write_splits(images, boxes, ["fuel", "robot"], f"file://{out}")
    told = json.loads((out / "train" / coco.ANNOTATIONS).read_text())
    assert [(i["id"], i["file_name"], i["extra"]) for i in told["images"]] == [(0, "a.jpg", {"name": "orig", "source_split": "train"}), (1, "b.jpg", {"name": "b.jpg", "source_split": "train"})]
    assert [(c["id"], c["name"]) for c in told["categories"]] == [(1, "fuel"), (2, "robot")]
    assert [(a["id"], a["image_id"], a["category_id"], a["bbox"], a["area"]) for a in told["annotations"]] == [(0, 0, 1, [1.0, 2.0, 3.0, 4.0], 12.0), (1, 0, 2, [0.5, 0.0, 10.0, 10.0], 100.0)]
    empty = json.loads((out / "test" / coco.ANNOTATIONS).read_text())
    assert empty["images"] == [] and empty["annotations"] == [] and len(empty["categories"]) == 2
    again, boxes2 = coco.scan(spark, f"file://{out}", "alpha", ("train", "valid"))
    assert again.count() == 3 and boxes2.count() == 3


def test_repeated_names_and_unknown_labels_raise(spark, folder, tmp_path):
    images, boxes = coco.scan(spark, f"file://{folder}", "alpha", ("train",))
    with pytest.raises(ValueError, match="more than once"):
        coco.write_split(images.union(images), boxes, ["fuel", "robot"], f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="robot"):
        coco.write_split(images, boxes, ["fuel"], f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="no annotation"):
        coco.scan(spark, f"file://{folder}", "alpha", ("nowhere",))


PREDS = "image_id string, pred_ix long, label string, conf double, x1 double, y1 double, x2 double, y2 double"


def test_prediction_cache(spark, tmp_path):
    rows = [("a.jpg", 0, "fu\"el", 0.91236, 1.06, 2.0, 3.0, 4.0), ("a.jpg", 1, "fuel", 0.5, 1.0, 2.0, 3.0, 4.0), ("a.jpg", 2, "fuel", 0.6, 1.0, 2.0, 3.0, 4.0), ("a.jpg", 3, "fuel", 0.001, 1.0, 2.0, 3.0, 4.0), ("c.jpg", 0, "fuel", 0.02, 1.0, 2.0, 3.0, 4.0)]
    preds, images = spark.createDataFrame(rows, PREDS), spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "image_id string")
    path = tmp_path / "p" / "predictions.json"
    size = files.write_predictions(preds, images, f"file://{path}", 0.01, 1, 10_000)
    assert size == len(path.read_bytes())
    told = json.loads(path.read_text())
    assert told["images"] == {"a.jpg": [["fu\"el", 0.9124, 1.1, 2.0, 3.0, 4.0], ["fuel", 0.6, 1.0, 2.0, 3.0, 4.0]], "b.jpg": [], "c.jpg": [["fuel", 0.02, 1.0, 2.0, 3.0, 4.0]]}
    back, seen = files.read_predictions(spark, f"file://{path}")
    assert sorted((r["image_id"], r["pred_ix"], r["label"], r["conf"]) for r in back.collect()) == [("a.jpg", 0, "fu\"el", 0.9124), ("a.jpg", 1, "fuel", 0.6), ("c.jpg", 0, "fuel", 0.02)]
    assert {r[0] for r in seen.collect()} == {"a.jpg", "b.jpg", "c.jpg"}
    assert files.align(images, seen, back).count() == 3
    with pytest.raises(ValueError, match="no predictions"):
        files.align(images.union(spark.createDataFrame([("z",)], "image_id string")), seen, back)
    with pytest.raises(ValueError, match="fu"):
        files.check_classes(back, ["fuel"])
    path.unlink()
    with pytest.raises(files.CacheTooLarge):
        files.write_predictions(preds, images, f"file://{path}", 0.01, 1, size - 1)
    assert not path.exists()


def test_manifest_and_field_images(spark, tmp_path):
    for name, content in {"x/a.JPG": b"one", "x/y/b.png": b"two", "notes.txt": b"three", "manifest.json": b"{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: (r["size"], r["sha256"]) for r in files.manifest(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in {"x/a.JPG": b"one", "x/y/b.png": b"two", "notes.txt": b"three"}.items()}
    assert sorted((r["split"], r["file_name"]) for r in files.field_images(spark, f"file://{tmp_path}").collect()) == [("x", "a.JPG"), ("x/y", "b.png")]


def test_predict_converts_centers_and_checks_the_model(spark):
    class Client:
        model = "org/model-3"

        def __call__(self, raw):
            return [("fuel", 0.5, 10.0, 20.0, 4.0, 6.0)] * len(raw)

    images = spark.createDataFrame([("a", b"1"), ("b", b"")], "image_id string, content binary")
    assert [tuple(r) for r in files.predict(images, Client, "model-3").collect()] == [("a", 0, "fuel", 0.5, 8.0, 17.0, 12.0, 23.0)]
    with pytest.raises(Exception, match="not model-4"):
        files.predict(images, Client, "model-4").collect()


def test_csv_reviews_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None), ("c,d", 1)], "name string, n int")
    files.write_csv(df, f"file://{tmp_path}/t.csv", ["name"])
    assert (tmp_path / "t.csv").read_text() == 'name,n\na,\nb,2\n"c,d",1\n'
    files.write_csv(df.limit(0), f"file://{tmp_path}/e.csv", ["name"])
    assert (tmp_path / "e.csv").read_text() == "name,n\n"
    (tmp_path / "review.csv").write_text("dataset,file_name,kind,x1,y1,x2,y2,verdict,note\nd,f,miss,1,2,3,4,ok,\nd,g,miss,1,2,3,4,,\n")
    assert [(r["file_name"], r["verdict"]) for r in files.read_review(spark, f"file://{tmp_path}/review.csv").collect()] == [("f", "ok")]
    for run, names in {"r1": ("metrics", "meta"), "r2": ("meta",)}.items():
        (tmp_path / "runs" / run).mkdir(parents=True)
        for n in names:
            (tmp_path / "runs" / run / f"{n}.json").write_text(json.dumps({"map50": 0.5, "created": "2026"}))
    got = files.read_runs(spark, f"file://{tmp_path}/runs", "map50 double", "created string").collect()
    assert [(r["dir"], r["metrics"]["map50"], r["meta"]["created"]) for r in got] == [("r1", 0.5, "2026")]
