"""Text recognisers: the plug-in point that turns frames into regions.

A recogniser is made once in each Python worker, by a factory, and is given one
frame at a time. Engines whose libraries aren't there can be registered all the
same; :func:`recognize` says which is missing. ``table`` reads regions from a
table and needs no library; it also serves tests.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .frames import Failure

REGIONS = "video_id string, frame_number int, timestamp_seconds double, idx int, text string, confidence double, x int, y int, w int, h int"


class EngineError(Failure, RuntimeError):
    """An engine that isn't known or can't be used."""


Found = list[tuple[str, float, int, int, int, int]]


class Recogniser(Protocol):
    """Made once in a worker. One that has ``regions_of(images)`` is given several frames at once instead."""

    def regions(self, image: bytes) -> Found:
        """(text, confidence, x, y, w, h) of each region of an image."""


@dataclass(frozen=True)
class Engine:
    name: str
    display_name: str
    requires_gpu: bool
    description: str
    module: str | None = None
    factory: Callable[..., Recogniser] | None = None

    @property
    def installed(self) -> bool:
        return self.module is None or importlib.util.find_spec(self.module) is not None


#: The engines by name.
ENGINES: dict[str, Engine] = {
    e.name: e
    for e in (
        Engine("easyocr", "EasyOCR", False, "Good balance, many languages", "easyocr"),
        Engine("tesseract", "Tesseract", False, "Fast on processors", "pytesseract"),
        Engine("surya", "Surya", True, "Accurate document layout", "surya"),
        Engine("doctr", "docTR", False, "Document recognition", "doctr"),
        Engine("trocr", "TrOCR", True, "Transformer recognition", "transformers"),
    )
}


def register(engine: Engine) -> None:
    ENGINES[engine.name] = engine


def get(name: str) -> Engine:
    if name.lower() not in ENGINES:
        raise EngineError(f"Unknown engine: {name}. Available: {', '.join(available())}")
    return ENGINES[name.lower()]


def available() -> list[str]:
    return sorted(n for n, e in ENGINES.items() if e.installed)


def is_available(name: str) -> bool:
    return name in available()


def requires_gpu(name: str) -> bool:
    return name in ENGINES and ENGINES[name].requires_gpu


def engines(spark: SparkSession) -> DataFrame:
    """name, display_name, requires_gpu, description: all that are known."""
    rows = [(e.name, e.display_name, e.requires_gpu, e.description) for e in ENGINES.values()]
    return spark.createDataFrame(rows, "name string, display_name string, requires_gpu boolean, description string")


def system_info(spark: SparkSession) -> DataFrame:
    """cores, workers, engines: what recognition can run on; engines are those that can be used."""
    cores = spark.sparkContext.defaultParallelism
    return spark.createDataFrame([(cores, int(spark.conf.get("spark.executor.instances", "1")), available())], "cores int, workers int, engines array<string>")


def _runner(engine: str, options: dict, at_once: int):
    made: dict[str, Recogniser] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if engine not in made:
                made[engine] = factory(**options)
            one, several = made[engine], getattr(made[engine], "regions_of", None)
            for lo in range(0, len(batch), at_once):
                part = batch.iloc[lo : lo + at_once]
                found = several(list(part.image)) if several else [one.regions(image) for image in part.image]
                out = [(r.video_id, r.frame_number, r.timestamp_seconds, i, *x) for r, own in zip(part.itertuples(), found, strict=True) for i, x in enumerate(own)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in REGIONS.split(", ")])

    factory = get(engine).factory
    return run


def recognize(frames: DataFrame, engine: str = "easyocr", languages: tuple[str, ...] = ("en",), gpu: bool = True, threshold: float = 0.5, at_once: int = 20, repeats: str = "error", progress: Observation | None = None) -> DataFrame:
    """REGIONS with at least ``threshold``, of frames (video_id, frame_number, timestamp_seconds, image).

    A worker is given ``at_once`` frames at a time, in their order. Frames that
    repeat a number in a recording are an error, or with ``repeats="last"`` the
    latest of them counts. ``progress`` gets how many texts were found.
    """
    found = get(engine)
    if found.factory is None:
        raise EngineError(f"{found.display_name} needs the library {found.module} and a registered factory")
    if repeats not in ("error", "last"):
        raise ValueError(f"repeats: {repeats}")
    keyed = frames.groupBy("video_id", "frame_number").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("timestamp_seconds", "image")).alias("_x"))
    number = F.col("frame_number") if repeats == "last" else F.when(F.col("_n") == 1, F.col("frame_number")).otherwise(F.raise_error(F.lit("a frame number repeats")).cast("int"))
    once = keyed.select("video_id", number.alias("frame_number"), "_x.timestamp_seconds", "_x.image")
    out = once.mapInPandas(_runner(found.name, {"languages": languages, "gpu": gpu}, at_once), REGIONS).filter(F.col("confidence") >= threshold)
    return out if progress is None else out.observe(progress, F.count(F.lit(1)).alias("texts_found"))


def recognize_from_table(frames: DataFrame, regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """REGIONS of frames out of a table of regions: a join instead of an engine."""
    return frames.select("video_id", "frame_number", "timestamp_seconds").join(regions.drop("timestamp_seconds"), ["video_id", "frame_number"]).filter(F.col("confidence") >= threshold)
