"""Detected text regions of frames: filters, geometry, reading order, line boxes.

``regions``: video_id, frame_number, idx, text, confidence, x, y, w, h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FRAME = ("video_id", "frame_number")
#: How far a region may be from its line's first one, and what a merged box must exceed.
LINE_GAP, PAD, MIN_W, MIN_H = 20, 5, 20, 10


def confident(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return regions.filter(F.col("confidence") >= threshold)


def geometry(regions: DataFrame) -> DataFrame:
    """Add center_x, center_y (halves rounded down) and area."""
    return regions.withColumns({"center_x": F.col("x") + F.expr("w div 2").cast("int"), "center_y": F.col("y") + F.expr("h div 2").cast("int"), "area": F.col("w") * F.col("h")})


def frame_counts(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """video_id, frame_number, n_regions, has_text of all frames: regions of at least ``threshold``, counted as they are read."""
    counts = regions.groupBy(*FRAME).agg(F.count_if(F.col("confidence") >= threshold).alias("n_regions"))
    return counts.withColumn("has_text", F.col("n_regions") > 0)


def text_frames(frames: DataFrame) -> DataFrame:
    """video_id, frames_processed, frames_with_text of frames with has_text."""
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames_processed"), F.count_if("has_text").alias("frames_with_text"))


def clean_words(words: DataFrame) -> DataFrame:
    """Word detections with percent confidences: blank texts and negative confidences go, 100 becomes 1."""
    return words.filter((T.strip(F.col("text")) != "") & (F.col("confidence") >= 0)).withColumn("confidence", F.col("confidence") / 100.0)


def polygon_box(polygon: Column) -> Column:
    """Struct (x, y, w, h) around an array of (x, y) points, cut to integers."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x, y = F.array_min(xs).cast("int"), F.array_min(ys).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - F.array_min(xs)).cast("int").alias("w"), (F.array_max(ys) - F.array_min(ys)).cast("int").alias("h"))


def _lines(ordered: Column, breaks) -> Column:
    """Boxes, given in (y, x, idx) order, dealt into lines; ``breaks`` compares a box with its line's first.

    Only the y of boxes go through the fold, which says where lines begin. What
    it says is bound before it is used, or it would be made again for each use.
    """
    start = F.struct(F.lit(None).cast("int").alias("first"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, box: Column) -> Column:
        new = state["first"].isNull() | breaks(box["y"], state["first"])
        return F.struct(F.when(new, box["y"]).otherwise(state["first"]).alias("first"), F.when(new, F.concat(state["at"], F.array(box["i"]))).otherwise(state["at"]).alias("at"))

    at = F.aggregate(F.transform(ordered, lambda b, i: F.struct(b["y"].alias("y"), i.alias("i"))), start, step)["at"]
    cut = lambda at: F.transform(at, lambda a, k: F.slice(ordered, a + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - a))
    return F.flatten(F.transform(F.array(at), cut))


def _boxes(text: str) -> Column:
    return F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("idx").cast("int").alias("idx"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.col(text).cast("string").alias("text")))


def read_order(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """video_id, frame_number, full_text, n_regions, average_confidence: one row for each frame with a region.

    A region more than LINE_GAP from its line's first begins a line; a line is
    read by x. average_confidence is of the regions kept, 0 if none is.
    """
    kept = regions.withColumn("ok", F.col("confidence") >= threshold)
    by_x = lambda line: F.array_sort(F.transform(line, lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["idx"].alias("idx"), b["text"].alias("text"))))
    boxes = F.filter(_boxes("text_or_null"), lambda b: b["text"].isNotNull())
    kept = kept.withColumn("text_or_null", F.when(F.col("ok"), F.col("text")))
    out = kept.groupBy(*FRAME).agg(F.array_sort(boxes).alias("boxes"), F.count(F.when(F.col("ok"), 1)).alias("n_regions"), F.avg(F.when(F.col("ok"), F.col("confidence"))).alias("mean"))
    lines = F.transform(_lines(F.col("boxes"), lambda y, first: F.abs(y - first) > LINE_GAP), lambda line: F.array_join(F.transform(by_x(line), lambda b: b["text"]), " "))
    return out.select(*FRAME, F.array_join(lines, "\n").alias("full_text"), "n_regions", F.coalesce("mean", F.lit(0.0)).alias("average_confidence"))


def merge_lines(regions: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """video_id, frame_number, line_no, x, y, w, h: boxes of one line (less than LINE_GAP from its first) as one, padded and cut to the frame."""
    grouped = regions.withColumn("none", F.lit("")).groupBy(*FRAME).agg(F.array_sort(_boxes("none")).alias("boxes"))
    line = grouped.select(*FRAME, F.posexplode(_lines(F.col("boxes"), lambda y, first: F.abs(y - first) >= LINE_GAP)).alias("line_no", "line"))
    least = lambda f: F.array_min(F.transform("line", f))
    most = lambda f: F.array_max(F.transform("line", f))
    x, y = F.greatest(F.lit(0), least(lambda b: b["x"]) - PAD), F.greatest(F.lit(0), least(lambda b: b["y"]) - PAD)
    right, bottom = F.least(F.lit(frame_w), most(lambda b: b["x"] + b["w"]) + PAD), F.least(F.lit(frame_h), most(lambda b: b["y"] + b["h"]) + PAD)
    box = line.select(*FRAME, "line_no", x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))
    return box.filter((F.col("w") > MIN_W) & (F.col("h") > MIN_H))
