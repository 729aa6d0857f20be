"""Inputs of the catalogued queries, made from the star-schema tables.

The tables hold no recordings, so these views derive frames, regions, lines and
recordings from them by arithmetic that SQL can repeat; each covers its whole
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import spread

#: Fixed values of the made-up recordings.
NAMES = ("Alice Smith", "Bob Jones", "Carol Diaz")
ENDS = (".mp4", ".MOV", ".avi", ".mkv", ".webm", ".m4v", ".xyz")
RATES = (29.97, 30.0, 25.0, 24.0, 0.0, 60.0)
CLOCK = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, line_no, line: each turn of a conversation as a name, a time and its text."""
    c = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(F.col("conv_id") + F.expr("turn div 4"), F.lit(3)) + 1).cast("int"))
    time = T.clock(9 * 3600 + F.pmod("conv_id", F.lit(7)) * 600 + F.col("turn") * 25)
    all_lines = F.concat(F.array(name, time), F.split("text", "\n"))
    return c.select(F.col("conv_id").alias("video_id"), "turn", F.posexplode(all_lines).alias("k", "line")).select("video_id", (F.col("turn") * 100000 + F.col("k")).alias("line_no"), "line")


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, raw_text."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines(spark, sf_dir).groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("raw_text"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each conversation as a recording."""
    from ..operators.formats import metadata

    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))
    videos = n.select("video_id", F.concat(F.lit("meeting-"), F.col("video_id").cast("string"), F.lit(".mp4")).alias("path"), (F.col("n") * 25.0).alias("duration_seconds"), (F.col("n") * 2).alias("frames_processed"), F.col("n").alias("frames_with_text"))
    return metadata(videos, "table", 0.5, CLOCK)


def frames_text(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """video_id, frame_number, timestamp_seconds, full_text, average_confidence: a frame shows three turns of a conversation.

    ``costly`` is for what compares texts: conversations are spread over more tasks.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    c = table(spark, sf_dir, "conversations")
    c = spread(c, "conv_id") if costly else c
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("frame_number"), (F.col("turn") * 0.5).alias("timestamp_seconds"), F.array_join(F.collect_list("text").over(w), "\n").alias("full_text"), F.lit(0.9).alias("average_confidence"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions: each word of a document is one, sixty in a frame."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("p", "text"))
    i = F.col("p") % 60
    d = d.select(F.col("doc_id").alias("video_id"), F.expr("cast(p div 60 as int)").alias("frame_number"), i.alias("idx"), "text", (((F.col("p") * 37) % 100) / 100).alias("confidence"))
    return d.withColumns({"x": (F.col("idx") % 6) * 100, "y": F.expr("cast(idx div 6 as int)") * 30 + (F.col("idx") * 7) % 13, "w": F.length("text") * 10, "h": F.lit(12)})


def turn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with timestamp_seconds: each turn of a conversation is a frame of its words, after a name and a time. Some words are unsure."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.array(F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("turn", F.lit(3)) + 1).cast("int")), T.clock(9 * 3600 + F.col("turn") * 25)), T.words(F.col("text")))
    c = c.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("frame_number"), (F.col("turn") * 0.5).alias("timestamp_seconds"), F.posexplode(said).alias("idx", "text"))
    row = F.when(F.col("idx") < 2, F.col("idx")).otherwise(F.expr("2 + (idx - 2) div 6")).cast("int")
    sure = F.when(F.col("idx") < 2, 0.9).otherwise(((F.col("idx") * 37 + F.col("frame_number")) % 70 + 30) / 100)
    return c.withColumns({"confidence": sure, "x": F.when(F.col("idx") < 2, 0).otherwise((F.col("idx") - 2) % 6 * 100), "y": row * 30, "w": F.length("text") * 10, "h": F.lit(12)})


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings, sound and unsound, from order keys."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("video_id"),
        F.concat(F.lit("/in/v"), k.cast("string"), pick(ENDS, 7)).alias("path"),
        (k % 11 != 0).alias("present"),
        (640 + (k % 5) * 320 - (k % 3) * 160).cast("int").alias("width"),
        (480 + (k % 4) * 120 - (k % 3) * 60).cast("int").alias("height"),
        pick(RATES, 6).alias("fps"),
        ((k % 13) * 20).cast("int").alias("frame_count"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """queue and jobs from orders."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "complete", "error"))), (k % 4 + 1).cast("int"))
    jobs = o.filter(k % 3 != 0).select(k.alias("job_id"), status.alias("status"), F.concat(F.lit("v"), k.cast("string")).alias("filename"), F.when(k % 8 == 2, F.lit("done")).alias("result"))
    return o.select(k.alias("item_id"), k.alias("job_id"), (k * 7919 % 1000003).alias("added")), jobs


def document_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_number, timestamp_seconds of the frames that :func:`regions` has regions of."""
    n = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), T.word_count(F.col("text")).alias("n")).filter("n > 0")
    return n.select("video_id", F.explode(F.expr("sequence(0, cast((n - 1) div 60 as int))")).alias("frame_number")).withColumn("timestamp_seconds", F.col("frame_number") * 0.5)


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_number, idx, text, k: a detection for each order, some of them blank."""
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "").when(k % 7 == 1, " \t ").when(k % 7 == 2, F.concat(F.lit(" a b"), k.cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("w"), k.cast("string")))
    return table(spark, sf_dir, "orders").select((k % 50).alias("video_id"), (k % 9).cast("int").alias("frame_number"), k.alias("idx"), text.alias("text"), k.alias("k"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, image: a few pixels of each order, three bytes each, by arithmetic."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("image_id"), (k % 3 + 4).cast("int").alias("width"), (k % 2 + 3).cast("int").alias("height"))
    byte = F.expr("transform(sequence(0, width * height * 3 - 1), i -> lpad(hex((image_id * 31 + i * i * 17 + i * 7 + image_id % 5 * i) % 256), 2, '0'))")
    return o.withColumn("image", F.unhex(F.array_join(byte, "")))
