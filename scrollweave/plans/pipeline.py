"""The whole way from frames to outputs, for any number of recordings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, frames, layout, transcript
from ..sources.config import Settings


def transcripts(regions: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """``texts``, ``blocks``, ``dedup``, ``entries``, ``statistics`` of regions with timestamp_seconds.

    Recordings don't wait for one another, and what goes wrong with one is
    found by :func:`scrollweave.operators.frames.validate` before.
    """
    s = settings or Settings()
    times = regions.groupBy("video_id", "frame_number").agg(F.first("timestamp_seconds").alias("timestamp_seconds"))
    texts = layout.read_order(regions, s["ocr.confidence_threshold"]).join(times, ["video_id", "frame_number"])
    blocks = dedup.scroll_dedup(texts, s["deduplication.similarity_threshold"], s["deduplication.min_new_chars"], s["deduplication.window_size"])
    result = dedup.dedup_result(texts, blocks)
    lines = transcript.explode_lines(result, "full_text").withColumn("confidence", F.lit(0.0))
    mean = blocks.groupBy("video_id").agg(F.avg("confidence").alias("mean"))
    lines = lines.drop("confidence").join(mean, "video_id", "left")
    entries = transcript.parse(lines, F.coalesce("mean", F.lit(0.0)), s["transcript_parsing.merge_consecutive"])
    stats = transcript.statistics(entries, result.select("video_id", F.col("full_text").alias("raw_text")))
    return {"texts": texts, "blocks": blocks, "dedup": result, "entries": entries, "statistics": stats}


def run(videos: DataFrame, regions: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """As :func:`transcripts`, of the sampled frames of valid recordings; ``errors`` has the others with the reason."""
    s = settings or Settings()
    checked = frames.validate(videos)
    taken = frames.limit_frames(frames.sample(videos, s["frame_extraction.fps"]), s["frame_extraction.max_frames"])
    out = transcripts(regions.drop("timestamp_seconds").join(taken, ["video_id", "frame_number"]), s)
    jobs = checked.select(F.col("video_id").cast("string").alias("video_id"), "error")
    return out | {"errors": checked.filter("error is not null").select("video_id", "error"), "results": transcript.batch_rows(out["statistics"], jobs)}
