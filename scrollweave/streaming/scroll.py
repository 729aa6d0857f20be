"""Scroll dedup of live recordings with Structured Streaming state.

State per recording: what it has shown, the recent texts, how many blocks. A
micro-batch's frames are taken in order of their number. A recording that sends
nothing for ``idle_minutes`` (processing time) is forgotten, if that is given; a
query that is to end by itself (``availableNow``) must not give it, since Spark
goes on to run batches for timeouts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.dedup import BLOCKS, ScrollState

STATE = "shown string, recent array<string>, seq int"


def _step(threshold: float, min_new: int, window: int, idle_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shown, recent, seq = state.get if state.exists else ("", [], 0)
        scroll = ScrollState(threshold, min_new, window, shown, list(recent))
        out = []
        for r in pd.concat(list(batches)).sort_values("frame_number", kind="stable").itertuples():
            if (new := scroll.take(r.full_text)) is not None:
                out.append((key[0], seq, new, r.frame_number, r.timestamp_seconds, r.average_confidence, True))
                seq += 1
        state.update((scroll.shown, scroll.recent, seq))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return step


def frames_as_they_land(spark: SparkSession, folder: str, schema: StructType, files: int = 20) -> DataFrame:
    """A stream of the tables of frames below ``folder``; a micro-batch takes ``files`` of them at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def scroll_dedup_stream(frames: DataFrame, threshold: float = 0.85, min_new: int = 10, window: int = 3, idle_minutes: int | None = None) -> DataFrame:
    """BLOCKS of a stream of frames, appended as they come."""
    rows = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_number").cast("int").alias("frame_number"), F.col("timestamp_seconds").cast("double").alias("timestamp_seconds"), "full_text", F.col("average_confidence").cast("double").alias("average_confidence"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_minutes else GroupStateTimeout.NoTimeout
    step = _step(threshold, min_new, window, idle_minutes * 60_000 if idle_minutes else None)
    return rows.groupBy("video_id").applyInPandasWithState(step, BLOCKS, STATE, "append", timeout)
