"""Transcripts from lines of text: entries, merging, speakers, statistics.

``lines``: video_id, line_no, line. All of it is window functions and one fold
over runs of one speaker; a recording is a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: entries of one speaker closer than this to the first of them are one.
MERGE_SECONDS = 60


def explode_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` of a table with video_id and a text."""
    return texts.select("video_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def parse_entries(lines: DataFrame, confidence: Column | float = 0.0) -> DataFrame:
    """video_id, entry_no, speaker, timestamp, timestamp_seconds, text, confidence.

    A line with a time begins an entry, whose speaker stands before the time or
    on one of the two lines above; a line that looks like a name begins one too
    (at the same time); other lines are text. Lines before the first time
    and initials are left out, and so are entries without text.
    """
    if not isinstance(confidence, Column):
        confidence = F.lit(float(confidence))
    w = Window.partitionBy("video_id").orderBy("line_no")
    rows = lines.select("video_id", "line_no", T.strip(F.col("line")).alias("l"), confidence.alias("confidence"))
    before, after = T.around_time(F.col("l"))
    rows = rows.select("*", T.is_initials(F.col("l")).alias("mark"), T.is_speaker(F.col("l")).alias("name"), T.first_time(F.col("l")).alias("t"), before.alias("head"), after.alias("tail"))
    rows = rows.withColumn("timed", (F.col("l") != "") & (F.col("t") != "") & ~F.col("mark"))
    skipped = (F.lag("l", 1).over(w) == "") | F.lag("mark", 1).over(w)
    above = F.when(skipped, F.when(F.lag("name", 2).over(w), F.lag("l", 2).over(w))).when(F.lag("name", 1).over(w), F.lag("l", 1).over(w))
    rows = rows.withColumns({"above": above, "seen": F.max("timed").over(w)})
    plain = F.col("seen") & ~F.col("timed") & (F.col("l") != "") & ~F.col("mark")
    names = plain & F.col("name") & (F.length("l") < 60)
    said = F.when(F.col("timed"), F.when(F.col("head") == "", F.col("above")).when(T.is_speaker(F.col("head")), F.col("head"))).when(names, F.col("l"))
    piece = F.when(F.col("timed") & (F.col("tail") != ""), F.col("tail")).when(plain & ~names, F.col("l"))
    rows = rows.select("video_id", "line_no", "confidence", (F.col("timed") | names).alias("begins"), T.clean_speaker(said).alias("said"), F.when(F.col("timed"), F.col("t")).alias("t"), piece.alias("piece"))
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = rows.select("video_id", "line_no", "confidence", "piece", F.sum(F.col("begins").cast("int")).over(w).alias("grp"), last("said").alias("speaker"), last("t").alias("timestamp")).filter("piece is not null")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), " ")
    out = rows.groupBy("video_id", "grp").agg(F.coalesce(F.first("speaker"), F.lit("")).alias("speaker"), F.first("timestamp").alias("timestamp"), T.strip(pieces).alias("text"), F.first("confidence").alias("confidence"))
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("grp"))
    return out.select("video_id", no.alias("entry_no"), "speaker", "timestamp", T.time_seconds(F.col("timestamp")).alias("timestamp_seconds"), "text", "confidence")


def merge_consecutive(entries: DataFrame, seconds: int = MERGE_SECONDS) -> DataFrame:
    """Entries of one speaker in a row as one, while less than ``seconds`` from the first of them.

    Only runs of one speaker are folded, each by itself.
    """
    w = Window.partitionBy("video_id").orderBy("entry_no")
    changed = F.coalesce(F.col("speaker") != F.lag("speaker").over(w), F.lit(True))
    runs = entries.withColumn("turn", changed.cast("int")).withColumn("run", F.sum("turn").over(w))
    item = F.struct(F.col("entry_no"), F.col("timestamp"), F.col("timestamp_seconds"), F.col("text"), F.col("confidence"))
    kind = "array<struct<entry_no:int,timestamp:string,timestamp_seconds:int,texts:array<string>,confidence:double>>"

    def fold(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = last.isNotNull() & (F.abs(x["timestamp_seconds"] - last["timestamp_seconds"]) < seconds)
        shape = lambda e, texts: F.struct(e["entry_no"].alias("entry_no"), e["timestamp"].alias("timestamp"), e["timestamp_seconds"].alias("timestamp_seconds"), texts.alias("texts"), e["confidence"].alias("confidence"))
        longer = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(shape(last, F.concat(last["texts"], F.array(x["text"])))))
        return F.when(near, longer).otherwise(F.concat(done, F.array(shape(x, F.array(x["text"])))))

    folded = runs.groupBy("video_id", "run", "speaker").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), fold).alias("m"))
    each = folded.select("video_id", "speaker", F.explode("m").alias("e"))
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("e.entry_no"))
    return each.select("video_id", no.alias("entry_no"), "speaker", "e.timestamp", "e.timestamp_seconds", F.array_join("e.texts", " ").alias("text"), "e.confidence")


def parse(lines: DataFrame, confidence: Column | float = 0.0, merge: bool = True) -> DataFrame:
    entries = parse_entries(lines, confidence)
    return merge_consecutive(entries) if merge else entries


def parse_with_confidence(lines: DataFrame, merge: bool = True) -> DataFrame:
    """As :func:`parse`, of lines with their own ``confidence``: each entry has the mean of its recording's."""
    mean = lines.groupBy("video_id").agg(F.avg("confidence").alias("mean"))
    return parse(lines.drop("confidence").join(mean, "video_id"), F.coalesce(F.col("mean"), F.lit(0.0)), merge)


def speakers(entries: DataFrame) -> DataFrame:
    """video_id, position, speaker: each recording's speakers as they first appear."""
    first = entries.filter("speaker <> ''").groupBy("video_id", "speaker").agg(F.min("entry_no").alias("first"))
    return first.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("first")).alias("position"), "speaker")


def by_speaker(entries: DataFrame, speaker: str) -> DataFrame:
    return entries.filter(F.col("speaker") == speaker)


def statistics(entries: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """video_id, speakers, messages, word_count, unique_words, character_count, average_confidence.

    ``raw`` (video_id, raw_text) gives the words where entries have no text, and
    recordings without entries. average_confidence is of confidences over 0.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_no", "text"))), lambda x: x["text"]), " ")
    got = entries.groupBy("video_id").agg(
        F.count_distinct(F.when(F.col("speaker") != "", F.col("speaker"))).alias("speakers"),
        F.count(F.lit(1)).alias("messages"),
        text.alias("all_text"),
        F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
    )
    if raw is not None:
        got = got.join(raw.select("video_id", "raw_text"), "video_id", "full")
        blank = T.strip(F.coalesce("all_text", F.lit(""))) == ""
        got = got.withColumn("all_text", F.when(blank & (F.coalesce("raw_text", F.lit("")) != ""), F.col("raw_text")).otherwise(F.coalesce("all_text", F.lit(""))))
    word = T.words(F.col("all_text"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return got.select("video_id", zero("speakers", "long"), zero("messages", "long"), F.size(word).cast("long").alias("word_count"), F.size(F.array_distinct(F.transform(word, F.lower))).cast("long").alias("unique_words"), F.length("all_text").cast("long").alias("character_count"), zero("average_confidence", "double"))


def job_statistics(stats: DataFrame, raw: DataFrame, frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """Statistics of jobs: video_id, total_speakers, total_messages, word_count, raw_word_count, frames_processed, frames_with_text, deduplication_ratio.

    ``stats`` as :func:`statistics` gives them, ``raw`` (video_id, raw_text),
    ``frames`` (video_id, frames_processed, frames_with_text), ``blocks``
    (video_id, n): new texts. word_count is that of the raw text where entries
    have none; the ratio is of new texts to frames, 0 without frames.
    """
    out = raw.select("video_id", T.word_count(F.coalesce("raw_text", F.lit(""))).cast("long").alias("raw_word_count"))
    out = out.join(stats.select("video_id", "speakers", "messages", "word_count"), "video_id", "left").join(frames, "video_id", "left").join(blocks.select("video_id", "n"), "video_id", "left").fillna(0)
    words = F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(F.col("raw_word_count"))
    ratio = F.when(F.col("frames_processed") > 0, F.col("n") / F.col("frames_processed")).otherwise(F.lit(0.0))
    return out.select("video_id", F.col("speakers").alias("total_speakers"), F.col("messages").alias("total_messages"), words.alias("word_count"), "raw_word_count", "frames_processed", "frames_with_text", ratio.alias("deduplication_ratio"))


def batch_rows(stats: DataFrame, jobs: DataFrame) -> DataFrame:
    """video_id, status, error, messages, word_count: one row for each job (video_id, error); ``success`` or ``error``."""
    out = jobs.join(stats, "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("video_id", F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"), "error", zero("messages"), zero("word_count"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """succeeded, failed."""
    return rows.agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))
