"""What recognisers detect, as regions: one normaliser for each form of raw detections.

A recogniser's library gives boxes, confidences and texts in a form of its own.
Each function here takes a table of such raw detections (video_id, frame_number,
idx, and what the form has) and gives regions (video_id, frame_number, idx,
text, confidence, x, y, w, h): projections and filters only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout

#: What stands in for a confidence or a box that isn't given; the least sizes of detected and of merged boxes.
LINE_CONFIDENCE, CROP_CONFIDENCE = 0.9, 0.85
NO_BOX = (0, 0, 100, 20)
MIN_BOX = (10, 5)


def _region(text: Column, confidence: Column, box: Column, *more: Column) -> tuple[Column, ...]:
    sides = (box[c] for c in "xywh")
    return (*map(F.col, (*layout.FRAME, "idx")), text.alias("text"), confidence.cast("double").alias("confidence"), *(s.cast("int").alias(c) for s, c in zip(sides, "xywh", strict=True)), *more)


def _box(x: Column, y: Column, right: Column, bottom: Column, least: int = 0) -> Column:
    """Struct (x, y, w, h) of corners that are cut to integers as their differences are."""
    side = lambda a, b: F.greatest(F.lit(least), (b - a).cast("int"))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side(x, right).alias("w"), side(y, bottom).alias("h"))


def _said(text: Column) -> Column:
    return T.strip(text) != ""


def from_polygons(raw: DataFrame) -> DataFrame:
    """polygon (array of (x, y)), text, confidence: the box around the polygon, which stays, its points cut to integers."""
    points = F.transform("polygon", lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))
    return raw.select(*_region(F.col("text"), F.col("confidence"), layout.polygon_box(F.col("polygon")), points.alias("polygon")))


def from_words(raw: DataFrame) -> DataFrame:
    """left, top, width, height, conf (percent), text: blank texts and negative confidences go, texts are stripped."""
    box = F.struct(F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return layout.clean_words(raw.withColumn("confidence", F.col("conf").cast("double"))).select(*_region(T.strip(F.col("text")), F.col("confidence"), box))


def from_lines(raw: DataFrame) -> DataFrame:
    """text or chars, confidence, bbox (left, top, right, bottom) or polygon; each but one of the texts may be null.

    A polygon counts from four points on. Blank lines go, others are stripped.
    """
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.array_join(F.coalesce("chars", F.array().cast("array<string>")), ""))
    side = lambda f, c: f(F.transform("polygon", lambda p: p[c].cast("double")))
    around = F.when(F.size("polygon") >= 4, F.array(side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")))
    corner = F.coalesce(F.when(F.size("bbox") >= 4, F.col("bbox").cast("array<double>")), F.when(F.col("bbox").isNull(), around), F.array(*(F.lit(float(v)) for v in NO_BOX)))
    rows = raw.withColumns({"said": text, "corner": corner}).filter(_said(F.col("said")))
    at = lambda i: F.get("corner", F.lit(i))
    return rows.select(*_region(T.strip(F.col("said")), F.coalesce("confidence", F.lit(LINE_CONFIDENCE)), _box(at(0), at(1), at(2), at(3), 1)))


def from_pages(raw: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """pages of blocks of lines of words (value, confidence, geometry: two corners as shares of the frame): a region for each word that isn't blank.

    idx numbers a frame's words in their order; raw has one row for each frame.
    """
    every = lambda outer, inner: F.flatten(F.transform(outer, inner))
    flat = every("pages", lambda p: every(p["blocks"], lambda b: every(b["lines"], lambda line: line["words"])))
    words = raw.select(*layout.FRAME, F.posexplode(flat).alias("idx", "word"))
    share = lambda i, c, size: (F.get("word.geometry", F.lit(i))[c] * size).cast("int")
    box = _box(share(0, "x", frame_w), share(0, "y", frame_h), share(1, "x", frame_w), share(1, "y", frame_h), 1)
    rows = words.filter(_said(F.col("word.value")) & (F.size("word.geometry") >= 2))
    return rows.select(*_region(T.strip(F.col("word.value")), F.coalesce("word.confidence", F.lit(0.0)), box))


def detected_boxes(boxes: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Boxes (video_id, frame_number, idx, x, y, w, h) of a detector of small shapes, as boxes of lines; tiny ones go first."""
    return layout.merge_lines(boxes.filter((F.col("w") > MIN_BOX[0]) & (F.col("h") > MIN_BOX[1])), frame_w, frame_h)


def from_crops(raw: DataFrame) -> DataFrame:
    """text, score (log-odds of a sequence, or null), x, y, w, h: confidence is the score's sigmoid; blank texts go."""
    sure = F.coalesce(1 / (1 + F.exp(-F.col("score"))), F.lit(CROP_CONFIDENCE))
    return raw.filter(_said(F.col("text"))).select(*_region(T.strip(F.col("text")), sure, F.struct("x", "y", "w", "h")))


def from_contours(boxes: DataFrame, least: float = 100.0) -> DataFrame:
    """Boxes of shapes with an ``area`` of ``least`` or more."""
    return boxes.filter(F.col("area") >= least).drop("area")


#: The normaliser of each engine's raw detections.
FORMS = {"easyocr": from_polygons, "tesseract": from_words, "surya": from_lines, "doctr": from_pages, "trocr": from_crops}


def languages_option(languages: tuple[str, ...]) -> str:
    """How the word engine is given its languages."""
    return "+".join(languages)
