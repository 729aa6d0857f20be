"""Pixels of frames: grey levels, histograms, crops, channel order.

``frames`` have image (rows of pixels from the top, three bytes each: blue,
green, red), width and height. Arrow carries the images to numpy, a batch of
frames at a time; nothing is decoded here. Contrast enhancement and contours
need an image library, which isn't part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Weights of blue, green and red in grey, in parts of 2 ** 14.
GREY = (1868, 9617, 4899)


def grey(image: np.ndarray) -> np.ndarray:
    """Grey levels of (height, width, 3) bytes, rounded."""
    return ((image.astype(np.int64) @ np.array(GREY) + (1 << 13)) >> 14).astype(np.uint8)


def _each(frames: DataFrame, use: tuple[str, ...], make: Callable[..., bytes | np.ndarray | None], kind: str, name: str) -> DataFrame:
    """Add ``name``: ``make`` of each row's ``use``; null where the image isn't width * height * 3 bytes."""
    own = frames.columns
    added = {"array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for image, width, height, *more in zip(*(batch.column(own.index(c)).to_pylist() for c in ("image", "width", "height", *use)), strict=True):
                fits = image is not None and width is not None and height is not None and len(image) == width * height * 3
                got.append(make(np.frombuffer(image, np.uint8).reshape(height, width, 3), *more) if fits else None)
            yield pa.record_batch([*(c for c in batch.columns), pa.array(got, added)], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInArrow(run, f"{fields}, `{name}` {kind}")


def histogram(frames: DataFrame, name: str = "vector") -> DataFrame:
    """Add how many pixels have each of the 256 grey levels."""
    return _each(frames, (), lambda image: np.bincount(grey(image).reshape(-1), minlength=256).astype(np.int32), "array<int>", name)


def levels(frames: DataFrame, name: str = "levels") -> DataFrame:
    """Add the grey level of each pixel."""
    return _each(frames, (), lambda image: grey(image).reshape(-1).astype(np.int32), "array<int>", name)


def crop(frames: DataFrame, x: str | None = "x", y: str = "y", w: str = "w", h: str = "h") -> DataFrame:
    """Frames with the part of their image that columns x, y, w, h give, as far as there is one; without x, or where it is null, whole frames."""
    if x is None:
        return frames
    cut = _each(frames, (x, y, w, h), lambda image, x, y, w, h: image.tobytes() if None in (x, y, w, h) else image[y : y + h, x : x + w].tobytes(), "binary", "_part")
    part = lambda at, size, whole: F.when(F.col(x).isNull() | F.col(y).isNull() | F.col(w).isNull() | F.col(h).isNull(), F.col(whole)).otherwise(F.greatest(F.lit(0), F.least(F.col(at) + F.col(size), F.col(whole)) - F.col(at)))
    return cut.withColumns({"image": F.col("_part"), "width": part(x, w, "width").cast("int"), "height": part(y, h, "height").cast("int")}).drop("_part")


def reverse_channels(frames: DataFrame) -> DataFrame:
    """Frames with red, green, blue for blue, green, red, and back."""
    return _each(frames, (), lambda image: image[:, :, ::-1].tobytes(), "binary", "_rgb").withColumn("image", F.col("_rgb")).drop("_rgb")


def _compared(a: pd.Series, b: pd.Series, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.Series:
    """``of`` of rows of a and b, those of one size together; 0 for null or unequal sizes."""
    sizes = np.array([-1 if x is None or y is None or len(x) != len(y) else len(x) for x, y in zip(a, b, strict=True)], np.int64)
    out = np.zeros(len(a))
    for n in set(sizes.tolist()) - {-1}:
        at = np.flatnonzero(sizes == n)
        out[at] = of(*(np.stack(c.iloc[at].to_numpy()).astype(np.float64) for c in (a, b))) if n else 1.0
    return pd.Series(out)


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return (np.divide((a * b).sum(1), spread, out=np.ones(len(a)), where=spread > 0) + 1) / 2


@F.pandas_udf(DoubleType())
def _by_histogram(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, _correlation)


@F.pandas_udf(DoubleType())
def _by_level(a: pd.Series, b: pd.Series) -> pd.Series:
    return _compared(a, b, lambda x, y: np.maximum(0.0, 1 - ((x - y) ** 2).mean(1) / (255.0 * 255.0)))


def similarity(pairs: DataFrame, method: str = "histogram") -> Column:
    """Similarity of columns a and b: :func:`histogram` or :func:`levels` of two frames; any other method is the histogram's.

    As :func:`scrollweave.operators.frames.frame_similarity`, a batch of pairs at a time.
    """
    return (_by_level if method == "mse" else _by_histogram)(F.col("a"), F.col("b"))


def save(frames: DataFrame, folder: str) -> DataFrame:
    """Write each frame's bytes below ``folder``, partitioned by recording; gives video_id, frame_number and whether there was an image."""
    frames.select("video_id", "frame_number", "width", "height", "image").write.mode("overwrite").partitionBy("video_id").parquet(folder)
    return frames.select("video_id", "frame_number", F.col("image").isNotNull().alias("saved"))
