from __future__ import annotations

import numpy as np

from sightline.sources import images


def gray(content: bytes, side: int) -> np.ndarray:
    small = np.random.default_rng(content[0]).uniform(0, 255, (4, 4))
    return np.kron(small, np.ones((side // 4, side // 4)))


def test_features_and_hashes(spark):
    df = spark.createDataFrame([("a", b"\x01"), ("b", b"\x02"), ("c", b"\x01")], "image_id string, content binary")
    got = {r["image_id"]: r for r in images.features(df, 8, gray).collect()}
    g = gray(b"\x01", 8)
    lap = [g[i - 1, j] + g[i + 1, j] + g[i, j - 1] + g[i, j + 1] - 4 * g[i, j] for i in range(1, 7) for j in range(1, 7)]
    assert abs(got["a"]["brightness"] - g.mean()) < 1e-9 and abs(got["a"]["sharpness"] - np.var(lap)) < 1e-6
    h = {r["image_id"]: (r["hash"], r["views"]) for r in images.hashes(df, gray).collect()}
    assert h["a"] == h["c"] and h["a"][0] == h["a"][1][0] and len(set(h["a"][1])) == 8 and h["a"][0] != h["b"][0]
    assert images.perceptual_hash(np.rot90(gray(b"\x01", 32))) == h["a"][1][1]


def test_flat_images_have_a_defined_hash():
    assert images.brightness_and_sharpness(np.full((8, 8), 7.0)) == (7.0, 0.0)
    assert isinstance(images.perceptual_hash(np.zeros((32, 32))), int)


def test_cosine_transform_matches_its_definition():
    x = np.random.default_rng(0).normal(size=8)
    want = [2 * sum(x[n] * np.cos(np.pi * k * (2 * n + 1) / 16) for n in range(8)) for k in range(8)]
    assert np.allclose(images._cosines(8) @ x, want)
