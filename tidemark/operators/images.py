"""Images of the image source (height, width, channels, bgr): resizing, statistics, splits by path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pixels(height: int, width: int, channels: int, bgr: bytes) -> np.ndarray:
    """height x width x 3 in RGB."""
    x = np.frombuffer(bgr, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


def bilinear(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear samples at pixel centres."""

    def places(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    r0, r1, fr = places(x.shape[0], height)
    c0, c1, fc = places(x.shape[1], width)
    x = x.astype(np.float64)
    rows = x[r0] * (1 - fr)[:, None, None] + x[r1] * fr[:, None, None]
    return rows[:, c0] * (1 - fc)[None, :, None] + rows[:, c1] * fc[None, :, None]


def resize_images(images: DataFrame, height: int = 64, width: int = 64, gray: bool = False) -> DataFrame:
    """(path, label, pixels): RGB values of 0 to 255, row by row, channels interleaved; one channel if gray."""

    def resize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, label, h, w, c, data in frame[["path", "label", "height", "width", "channels", "bgr"]].itertuples(index=False):
                x = bilinear(_pixels(h, w, c, data), height, width)
                if gray:
                    x = x @ np.array([0.299, 0.587, 0.114])
                out.append((path, label, np.round(x).astype(np.int16).ravel()))
            yield pd.DataFrame(out, columns=["path", "label", "pixels"])

    return images.mapInPandas(resize, "path string, label string, pixels array<short>")


def channel_stats(images: DataFrame) -> DataFrame:
    """(channel, mean, deviation) of pixels over 255, from sums of every batch."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                x = np.concatenate([np.asarray(p, float).reshape(-1, 3) for p in frame["pixels"]]) / 255.0
                yield pd.DataFrame({"channel": range(3), "n": len(x), "s": x.sum(axis=0), "q": (x * x).sum(axis=0)})

    parts = images.select("pixels").mapInPandas(sums, "channel int, n long, s double, q double")
    mean = F.sum("s") / F.sum("n")
    return parts.groupBy("channel").agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("deviation"))


def brightness_stats(images: DataFrame) -> DataFrame:
    """(path, label, brightness, contrast, red, green, blue) of every image."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, label, h, w, c, data in frame[["path", "label", "height", "width", "channels", "bgr"]].itertuples(index=False):
                x = _pixels(h, w, c, data).astype(float)
                g = x @ np.array([0.299, 0.587, 0.114])
                out.append((path, label, float(g.mean()), float(g.std()), *map(float, x.mean(axis=(0, 1)))))
            yield pd.DataFrame(out, columns=["path", "label", "brightness", "contrast", "red", "green", "blue"])

    return images.mapInPandas(measure, "path string, label string, brightness double, contrast double, red double, green double, blue double")


def brightness_by_class(stats: DataFrame) -> DataFrame:
    columns = ("brightness", "contrast", "red", "green", "blue")
    return stats.groupBy("label").agg(*[F.avg(c).alias(c) for c in columns])


def normalised_path(column: str):
    """The last two steps of a path: class folder and file."""
    steps = F.split(F.regexp_replace(column, r"^file:/*", "/"), "/")
    return F.concat_ws("/", F.element_at(steps, -2), F.element_at(steps, -1))


def manifest_to_images(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """The images of a manifest (label, split, path) by class folder and file."""
    m = manifest.select("split", normalised_path("path").alias("__p"))
    return images.withColumn("__p", normalised_path("path")).join(m, "__p").drop("__p")
