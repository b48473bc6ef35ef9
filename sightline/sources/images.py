"""Image features and perceptual hashes of decoded images, in Arrow batches.

``decode(content, side)`` turns file bytes into a side x side array of gray levels from 0 to 255.
The default needs Pillow; any other decoder can be given.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

Decode = Callable[[bytes, int], np.ndarray]


def pillow(content: bytes, side: int) -> np.ndarray:
    """Gray levels of an image stretched to a square."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images needs Pillow or a decoder of your own") from e
    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(image.convert("L").resize((side, side), Image.Resampling.BILINEAR), dtype=np.float64)


def brightness_and_sharpness(gray: np.ndarray) -> tuple[float, float]:
    """Mean level, and the variance of the four-neighbour Laplacian inside the border."""
    bend = np.diff(gray, 2, axis=0)[:, 1:-1] + np.diff(gray, 2, axis=1)[1:-1, :]  # second differences both ways
    return float(gray.mean()), float(bend.var())


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k + 1) / (2 * n))


def perceptual_hash(gray: np.ndarray, low: int = 8) -> int:
    """64 signed bits, row by row: whether each low DCT coefficient exceeds their median."""
    c = _cosines(gray.shape[0])
    part = (c @ gray @ c.T)[:low, :low]
    bits = "".join("1" if b else "0" for b in (part > np.median(part)).ravel())
    value = int(bits, 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def views(gray: np.ndarray) -> list[np.ndarray]:
    """The four quarter turns, then the mirror image of each; the first is the image itself."""
    turned = [np.rot90(gray, k) for k in range(4)]
    return turned + [np.fliplr(t) for t in turned]


def features(images: DataFrame, side: int = 320, decode: Decode = pillow) -> DataFrame:
    """(image_id, brightness, sharpness) of (image_id, content)."""

    def run(frames: Iterator):
        import pandas as pd

        for f in frames:
            told = [brightness_and_sharpness(decode(c, side)) for c in f["content"]]
            yield pd.DataFrame({"image_id": f["image_id"], "brightness": [t[0] for t in told], "sharpness": [t[1] for t in told]})

    return images.select("image_id", "content").mapInPandas(run, f"image_id {images.schema['image_id'].dataType.simpleString()}, brightness double, sharpness double")


def hashes(images: DataFrame, decode: Decode = pillow, side: int = 32) -> DataFrame:
    """(image_id, hash, views) of (image_id, content); views are the hashes of all eight orientations."""

    def run(frames: Iterator):
        import pandas as pd

        for f in frames:
            told = [[perceptual_hash(v) for v in views(decode(c, side))] for c in f["content"]]
            yield pd.DataFrame({"image_id": f["image_id"], "hash": [t[0] for t in told], "views": told})

    return images.select("image_id", "content").mapInPandas(run, f"image_id {images.schema['image_id'].dataType.simpleString()}, hash long, views array<long>")
