"""Recordings as tables: files by ``binaryFile``, properties from a probe."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import FORMATS

VIDEOS = "video_id string, path string, present boolean, width int, height int, fps double, frame_count int"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """video_id, path, length, modified of recordings below ``folder``, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return found.filter(kind.isin(*FORMATS)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("video_id"), "path", "length", "modified")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """New recordings below ``folder`` as they land."""
    form = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(form).load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("video_id"), "path", "length")


def probed(found: DataFrame, probe: Callable[[str], tuple[int, int, float, int] | None]) -> DataFrame:
    """VIDEOS of files; ``probe`` gives (width, height, fps, frames) of a path, None where it can't be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [probe(p) or (None,) * 4 for p in batch.path]
            width, height, fps, count = zip(*got, strict=True) if got else ((),) * 4
            yield pd.DataFrame({"video_id": batch.video_id, "path": batch.path, "present": True, "width": pd.array(width, "Int32"), "height": pd.array(height, "Int32"), "fps": pd.array(fps, "Float64"), "frame_count": pd.array(count, "Int32")})

    return found.select("video_id", "path").mapInPandas(run, VIDEOS)
