"""Recordings and their frames: validation, sampling, similarity, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a recording must be.
FORMATS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
MIN_WIDTH, MIN_HEIGHT = 640, 480


class Failure(Exception):
    """What can go wrong with a recording."""


class FrameError(Failure, ValueError):
    """A recording that frames can't be taken from."""


class DedupError(Failure):
    """A text that can't be deduplicated."""


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def validate(videos: DataFrame) -> DataFrame:
    """Add ``error``: the first reason against a recording, or null.

    Needs path, present (null counts as present), width, height, frame_count
    and fps.
    """
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in videos.columns else F.lit(True)
    error = (
        F.when(~present, say("Video file not found: ", F.col("path")))
        .when(~suffix(F.col("path")).isin(*FORMATS), say("Unsupported format: ", F.regexp_extract("path", r"(\.[^./]*)$", 1)))
        .when(F.col("width").isNull() | F.col("fps").isNull(), say("Could not open video: ", F.col("path")))
        .when((F.col("width") < MIN_WIDTH) | (F.col("height") < MIN_HEIGHT), say("Resolution too low: ", F.col("width").cast("string"), "x", F.col("height").cast("string"), f" (minimum {MIN_WIDTH}x{MIN_HEIGHT})"))
        .when(F.coalesce("frame_count", F.lit(0)) == 0, F.lit("Video has no frames"))
        .when(F.col("fps") <= 0, F.lit("Could not determine video FPS"))
    )
    return videos.withColumn("error", error)


def info(videos: DataFrame) -> DataFrame:
    """Add ``duration_seconds``; 0 where the frame rate is no rate."""
    return videos.withColumn("duration_seconds", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(F.lit(0.0)))


def interval(native: Column, target: float) -> Column:
    """Frames from one that is taken to the next; halves round to even."""
    every = F.greatest(F.lit(1), F.bround(native / F.lit(float(target))).cast("int"))
    return F.when(F.lit(float(target)) >= native, F.lit(1)).otherwise(every)


def sample(videos: DataFrame, target: float | None = 2.0) -> DataFrame:
    """video_id, frame_number, timestamp_seconds of the frames taken of valid recordings.

    The numbers are made by a generator from the recording's length: nothing
    but the taken frames exists.
    """
    good = validate(videos).filter("error is null")
    step = interval(F.col("fps"), 2.0 if target is None else float(target))
    frames = good.withColumn("step", step).select("video_id", "fps", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1, F.col("step"))).alias("frame_number"))
    return frames.select("video_id", F.col("frame_number").cast("int").alias("frame_number"), (F.col("frame_number") / F.col("fps")).alias("timestamp_seconds"))


def sample_frames(frames: DataFrame, videos: DataFrame, target: float | None = 2.0) -> DataFrame:
    """The rows of ``frames`` (video_id, frame_number, ...) that sampling takes."""
    step = videos.select("video_id", interval(F.col("fps"), 2.0 if target is None else float(target)).alias("_step"))
    return frames.join(step, "video_id").filter("frame_number % _step = 0").drop("_step")


def single_frame(frames: DataFrame, frame_number: int) -> DataFrame:
    """A recording's frame by its number, no row where there is none."""
    return frames.filter(F.col("frame_number") == frame_number)


def scan(frames: DataFrame, videos: DataFrame, target: float | str | None = 2.0, most: int | None = None, similar: float | None = 0.95, vector: str = "vector") -> DataFrame:
    """The frames (with ``vector``) that are taken of recordings: sampled, unlike the one before, the first ``most``.

    ``target`` may be a text, and None is 2; ``similar`` None keeps frames that
    look alike. The result is a table to be cached or written where all of it is
    wanted at once.
    """
    taken = sample_frames(frames, videos, 2.0 if target is None else float(target))
    if similar is not None:
        taken = taken.join(skip_similar(taken, vector, similar), ["video_id", "frame_number"], "left_semi")
    return limit_frames(taken, most)


def limit_frames(frames: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` frames of each recording; 0 and None: all."""
    if not most:
        return frames
    nth = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number"))
    return frames.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")


def estimate_frames(videos: DataFrame, rates: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """video_id, fps, frames: how many frames sampling at each rate would take."""
    rate = F.explode(F.array(*map(F.lit, rates)))
    return info(videos).select("video_id", "duration_seconds", rate.alias("rate")).select("video_id", "rate", F.floor(F.col("duration_seconds") * F.col("rate")).cast("int").alias("frames"))


def histogram_similarity(a: Column, b: Column) -> Column:
    """(r + 1) / 2 with r the correlation of two histograms, 1 without variance; 0 for null or unequal sizes."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: total(c) / F.size(c)
    # The means are bound before the sums, which would make them again for each element.
    bound = F.array(F.struct(mean(a).alias("a"), mean(b).alias("b")))
    pair = lambda m: F.zip_with(a, b, lambda x, y: F.struct((x - m["a"]).alias("x"), (y - m["b"]).alias("y")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    add = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))
    r = F.transform(F.transform(bound, lambda m: F.aggregate(pair(m), zero, add)), lambda s: F.when(F.sqrt(s["xx"] * s["yy"]) > 0, s["xy"] / F.sqrt(s["xx"] * s["yy"])).otherwise(F.lit(1.0)))[0]
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise((r + 1) / 2)


def mse_similarity(a: Column, b: Column) -> Column:
    """1 less the mean squared difference over 255 squared, at least 0; 0 for null or unequal sizes."""
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - square / F.size(a) / (255.0 * 255.0)))


def frame_similarity(a: Column, b: Column, method: str = "histogram") -> Column:
    return mse_similarity(a, b) if method == "mse" else histogram_similarity(a, b)


def skip_similar(frames: DataFrame, vector: str = "vector", threshold: float = 0.95, method: str = "histogram") -> DataFrame:
    """Frames that differ from the frame kept before: its similarity is at most ``threshold``.

    The comparison is with the last *kept* frame, so it is a fold over a
    recording's frames; only their vectors are gathered, per recording.
    """
    rows = F.array_sort(F.collect_list(F.struct("frame_number", F.col(vector).cast("array<double>").alias("v"))))
    start = F.struct(F.lit(None).cast("array<double>").alias("v"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        same = state["v"].isNotNull() & (frame_similarity(state["v"], x["v"], method) > threshold)
        return F.struct(F.when(same, state["v"]).otherwise(x["v"]).alias("v"), F.when(same, state["kept"]).otherwise(F.concat(state["kept"], F.array(x["frame_number"].cast("int")))).alias("kept"))

    kept = frames.groupBy("video_id").agg(F.aggregate(rows, start, step)["kept"].alias("kept"))
    return kept.select("video_id", F.explode("kept").alias("frame_number"))
