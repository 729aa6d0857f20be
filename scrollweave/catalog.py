"""All queries of the engine, with their SQL where SQL can say them.

Each entry runs over whole tables; see :mod:`scrollweave.plans.views` for the
inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .operators import dedup, detections, formats, frames, images, jobs, layout, recognize, transcript
from .plans import pipeline, sql, views
from .shared import scratch
from .sources import sinks
from .streaming.entries import entries_stream
from .streaming.scroll import frames_as_they_land, scroll_dedup_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(said: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: wide(f(spark, d))
        if said:
            SQL[f.__name__] = said
        return f

    return add


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as long."""
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal")} or {df.columns[0]: F.col(df.columns[0])})


def merged(spark: SparkSession, d: str) -> DataFrame:
    return transcript.parse(views.lines(spark, d))


# Recordings and frames


@query(f"WITH {sql.VIDEOS} SELECT video_id, error FROM validated")
def video_validate(spark, d):
    return frames.validate(views.videos(spark, d)).select("video_id", "error")


@query(f"WITH {sql.VIDEOS} SELECT video_id, width::BIGINT AS width, height::BIGINT AS height, fps, frame_count::BIGINT AS frame_count, CASE WHEN fps > 0 THEN frame_count / fps ELSE 0.0::DOUBLE END AS duration_seconds FROM videos")
def video_info(spark, d):
    return frames.info(views.videos(spark, d)).select("video_id", "width", "height", "fps", "frame_count", "duration_seconds")


@query(f"WITH {sql.VIDEOS} SELECT video_id, frame_number::BIGINT AS frame_number, timestamp_seconds FROM frames")
def frame_sampling(spark, d):
    return frames.sample(views.videos(spark, d), 2.0)


@query(f"WITH {sql.VIDEOS} SELECT video_id, frame_number::BIGINT AS frame_number, timestamp_seconds FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n FROM frames) WHERE n <= 3")
def max_frames_limit(spark, d):
    return frames.limit_frames(frames.sample(views.videos(spark, d), 2.0), 3)


@query(f"WITH {sql.VIDEOS} SELECT video_id, frame_number::BIGINT AS frame_number, timestamp_seconds FROM frames WHERE frame_number = 30")
def single_frame(spark, d):
    return frames.single_frame(frames.sample(views.videos(spark, d), 2.0), 30)


@query(f"WITH {sql.VIDEOS} SELECT video_id, rate, floor(CASE WHEN fps > 0 THEN frame_count / fps ELSE 0 END * rate)::BIGINT AS frames FROM videos, (SELECT unnest([1, 2, 3, 5])::BIGINT AS rate)")
def estimated_frames(spark, d):
    return frames.estimate_frames(views.videos(spark, d))


@query(f"WITH {sql.VIDEOS} SELECT video_id, frame_number::BIGINT AS frame_number, {sql.clock('floor(timestamp_seconds)::BIGINT')} AS clock, {sql.duration('timestamp_seconds * 500')} AS duration, {sql.clock('floor(timestamp_seconds)::BIGINT')} || ',' || lpad(floor((timestamp_seconds % 1) * 1000)::BIGINT::VARCHAR, 3, '0') AS srt FROM frames")
def frame_clocks(spark, d):
    t = F.col("timestamp_seconds")
    return frames.sample(views.videos(spark, d), 2.0).select("video_id", "frame_number", T.clock(t).alias("clock"), T.duration(t * 500).alias("duration"), T.srt_clock(t).alias("srt"))


def _next_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_PAIRS = "p AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


@query(f"WITH {_PAIRS}, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round((corr(x, y) + 1) / 2, 6) AS similarity FROM u GROUP BY vec_id")
def frame_similarity_hist(spark, d):
    return _next_vectors(spark, d).select("vec_id", F.round(frames.frame_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {_PAIRS}, u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round(greatest(0.0, 1 - avg((x - y) * (x - y)) / (255.0 * 255.0)), 9) AS similarity FROM u GROUP BY vec_id")
def frame_similarity_mse(spark, d):
    return _next_vectors(spark, d).select("vec_id", F.round(frames.frame_similarity(F.col("a"), F.col("b"), "mse"), 9).alias("similarity"))


@query(
    """WITH RECURSIVE o AS (SELECT label AS video_id, vec_id AS frame_number, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (
  SELECT video_id, n, v, frame_number, true AS fresh FROM o WHERE n = 1
  UNION ALL
  SELECT video_id, n, CASE WHEN same THEN v ELSE w END, frame_number, NOT same
  FROM (SELECT o.video_id, o.n, f.v, o.v AS w, o.frame_number, (list_aggregate(list_transform(list_zip(f.v, o.v), lambda x: (x[1] - list_avg(f.v)) * (x[2] - list_avg(o.v))), 'sum')
      / sqrt(list_aggregate(list_transform(f.v, lambda x: (x - list_avg(f.v)) ** 2), 'sum') * list_aggregate(list_transform(o.v, lambda x: (x - list_avg(o.v)) ** 2), 'sum')) + 1) / 2 > 0.6 AS same
    FROM f JOIN o ON o.video_id = f.video_id AND o.n = f.n + 1))
SELECT video_id, frame_number FROM f WHERE fresh"""
)
def skip_similar(spark, d):
    e = views.table(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_number"), F.col("embedding").alias("vector"))
    return frames.skip_similar(e, threshold=0.6)


# Regions


@query(f"WITH {sql.REGIONS} SELECT video_id, frame_number, count(*) FILTER (confidence >= 0.5) AS n_regions, count(*) FILTER (confidence >= 0.5) > 0 AS has_text FROM regions GROUP BY video_id, frame_number")
def confidence_filter(spark, d):
    return layout.frame_counts(views.regions(spark, d))


@query(f"WITH {sql.REGIONS}, c AS (SELECT video_id, frame_number, count(*) FILTER (confidence >= 0.99) > 0 AS has_text FROM regions GROUP BY ALL) SELECT video_id, count(*) AS frames_processed, count(*) FILTER (has_text) AS frames_with_text FROM c GROUP BY video_id")
def text_frame_count(spark, d):
    return layout.text_frames(layout.frame_counts(views.regions(spark, d), 0.99))


@query(f"WITH {sql.REGIONS} SELECT video_id, frame_number, sum(x + w // 2)::BIGINT AS center_x, sum(y + h // 2)::BIGINT AS center_y, sum(w * h)::BIGINT AS area FROM regions GROUP BY video_id, frame_number")
def region_geometry(spark, d):
    return layout.geometry(views.regions(spark, d)).groupBy(*layout.FRAME).agg(*(F.sum(c).alias(c) for c in ("center_x", "center_y", "area")))


@query(f"WITH RECURSIVE {sql.REGIONS}, {sql.lines_of('confidence >= 0.5', '> 20')}, t AS (SELECT video_id, frame_number, line_no, string_agg(text, ' ' ORDER BY x, y, idx) AS line FROM lined GROUP BY ALL) SELECT video_id, frame_number, string_agg(line, chr(10) ORDER BY line_no) AS full_text FROM t GROUP BY video_id, frame_number")
def reading_order(spark, d):
    return layout.read_order(views.regions(spark, d)).filter("n_regions > 0").select(*layout.FRAME, "full_text")


@query(f"WITH RECURSIVE {sql.REGIONS}, {sql.lines_of('true', '>= 20')}, b AS (SELECT video_id, frame_number, line_no, greatest(0, min(x) - 5) AS x, greatest(0, min(y) - 5) AS y, least(640, max(x + w) + 5) AS r, least(480, max(y + h) + 5) AS s FROM lined GROUP BY ALL) SELECT video_id, frame_number, line_no::BIGINT AS line_no, x::BIGINT AS x, y::BIGINT AS y, (r - x)::BIGINT AS w, (s - y)::BIGINT AS h FROM b WHERE r - x > 20 AND s - y > 10")
def bbox_merge(spark, d):
    return layout.merge_lines(views.regions(spark, d), 640, 480)


@query(f"WITH {sql.REGIONS} SELECT video_id, frame_number, round(coalesce(avg(confidence) FILTER (confidence >= 0.5), 0), 9) AS average_confidence FROM regions GROUP BY video_id, frame_number")
def average_confidence(spark, d):
    return layout.read_order(views.regions(spark, d)).select(*layout.FRAME, F.round("average_confidence", 9).alias("average_confidence"))


# Text


@query(f"SELECT doc_id, {sql.norm('text')} AS norm, {sql.count_words('text')}::BIGINT AS n_words FROM documents")
def normalize_text(spark, d):
    return views.table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"), T.word_count(F.col("text")).alias("n_words"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^{T.WS}]+') AS w FROM documents) SELECT doc_id, array_to_string(w[4:], ' ') AS rest, len(list_distinct(list_transform(w, lambda x: lower(x))))::BIGINT AS unique_words FROM w")
def word_functions(spark, d):
    t = F.col("text")
    return views.table(spark, d, "documents").select("doc_id", T.skip_words(t, F.lit(3)).alias("rest"), F.size(F.array_distinct(F.transform(T.words(t), F.lower))).alias("unique_words"))


@query(f"WITH {sql.LINES} SELECT video_id, line_no, regexp_extract(line, '({T.TIME})', 1) AS t, CASE WHEN regexp_matches(line, '{T.TIME}') THEN {sql.seconds(f"regexp_extract(line, '({T.TIME})', 1)")} ELSE 0 END AS seconds, {sql.initials('line')} AS initials, {sql.speaker('line')} AS speaker, {sql.clean('line')} AS cleaned FROM lines")
def line_predicates(spark, d):
    line = F.col("line")
    return views.lines(spark, d).select("video_id", "line_no", T.first_time(line).alias("t"), T.time_seconds(T.first_time(line)).alias("seconds"), T.is_initials(line).alias("initials"), T.is_speaker(line).alias("speaker"), T.clean_speaker(line).alias("cleaned"))


# Similarity


_NEXT = "n AS (SELECT x.p_partkey AS k, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)"


def _next_parts(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"))
    return p.join(p.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")


@query(f"WITH {_NEXT} SELECT k, {sql.ratio('a', 'b')} AS ratio FROM n")
def indel_ratio(spark, d):
    return _next_parts(spark, d).select("k", S.indel_ratio(F.col("a"), F.col("b"), False).alias("ratio"))


@query(f"WITH {_NEXT} SELECT k, {sql.ratio('a', 'b')} AS ratio FROM n")
def indel_ratio_native(spark, d):
    return _next_parts(spark, d).select("k", S.ratio_native(F.col("a"), F.col("b")).alias("ratio"))


@query(f"SELECT x.n_nationkey::BIGINT AS i, y.n_nationkey::BIGINT AS j, {sql.ratio('lower(x.n_name)', 'lower(y.n_name)')} AS similarity FROM nation x, nation y")
def similarity_matrix(spark, d):
    return dedup.similarity_matrix(views.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("text")))


@query()
def fuzzy_anti_lines(spark, d):
    f = views.frames_text(spark, d)
    frame = lambda shift: F.concat_ws(":", F.col("video_id"), F.col("frame_number") + shift)
    current = f.select(frame(0).alias("video_id"), F.posexplode(F.split("full_text", "\n")).alias("no", "line"))
    current = current.select("video_id", F.concat_ws(":", "video_id", "no").alias("id"), "line")
    known = f.select(frame(1).alias("video_id"), F.explode(F.split("full_text", "\n")).alias("line"))
    return dedup.fuzzy_anti(current, known).select("id", "line")


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames_text(spark, d, costly=True).select("video_id", "frame_number", F.col("full_text").alias("b"))
    return f.withColumn("a", F.lag("b").over(Window.partitionBy("video_id").orderBy("frame_number")))


@query()
def find_overlap(spark, d):
    return _turn_pairs(spark, d).select("video_id", "frame_number", S.find_overlap(F.col("a"), F.col("b")).alias("o")).select("video_id", "frame_number", "o.position", "o.length")


@query()
def find_new_content(spark, d):
    return _turn_pairs(spark, d).select("video_id", "frame_number", S.find_new_content(F.col("a"), F.col("b")).alias("new"))


# Scrolling


@query()
def scroll_dedup(spark, d):
    return dedup.scroll_dedup(views.frames_text(spark, d))


@query()
def dedup_stats(spark, d):
    f = views.frames_text(spark, d)
    return dedup.dedup_result(f, dedup.scroll_dedup(f))


@query()
def dedup_simple(spark, d):
    return dedup.simple_dedup(views.frames_text(spark, d).select("video_id", F.col("frame_number").alias("pos"), F.col("full_text").alias("text")))


@query(f"WITH {sql.FRAMES_TEXT} SELECT video_id, frame_number, coalesce(string_agg(t, chr(1)) OVER (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS recent FROM (SELECT video_id, frame_number, {sql.strip('full_text')} AS t FROM ft) WHERE t <> ''")
def recent_window(spark, d):
    return dedup.recent_window(views.frames_text(spark, d)).select("video_id", "frame_number", F.array_join("recent", "\x01").alias("recent"))


@query(f"WITH {sql.FRAMES_TEXT}, r AS (SELECT video_id, frame_number, string_agg(t, chr(10)) OVER (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM (SELECT video_id, frame_number, {sql.strip('full_text')} AS t FROM ft) WHERE t <> '') SELECT video_id, frame_number, coalesce(len(list_filter(list_distinct(list_transform(string_split(recent, chr(10)), lambda x: {sql.norm('x')})), lambda x: x <> '')), 0)::BIGINT AS n_known FROM r")
def known_lines_set(spark, d):
    return dedup.known_lines(views.frames_text(spark, d))


@query()
def cross_video_dedup(spark, d):
    texts = views.raw_texts(spark, d).select(F.col("video_id").alias("pos"), F.col("raw_text").alias("text"))
    return dedup.cross_dedup(texts)


@query(f"WITH {sql.LINES} SELECT video_id AS pos, row_number() OVER (PARTITION BY video_id ORDER BY line_no) - 1 AS line_no, {sql.strip('line')} AS line FROM lines QUALIFY {sql.strip('line')} <> ''")
def union_lines(spark, d):
    texts = views.raw_texts(spark, d).select(F.col("video_id").alias("pos"), F.col("raw_text").alias("text"))
    return dedup.union_lines(texts)


@query()
def scroll_dedup_streaming(spark, d):
    base = scratch(spark, "stream")
    frames_ = views.frames_text(spark, d)
    frames_.write.parquet(f"{base}/in")
    out = scroll_dedup_stream(frames_as_they_land(spark, f"{base}/in", frames_.schema))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"WITH RECURSIVE {sql.MERGED} SELECT video_id::VARCHAR AS video_id, entry_no, speaker, \"timestamp\", timestamp_seconds, text FROM merged")
def parse_streaming(spark, d):
    base = scratch(spark, "stream")
    lines = views.lines(spark, d)
    ends = lines.groupBy("video_id").agg((F.max("line_no") + 1).alias("seq")).select("video_id", "seq", F.lit(None).cast("string").alias("text"))
    texts = lines.select("video_id", F.col("line_no").alias("seq"), F.col("line").alias("text")).unionByName(ends)
    texts.write.parquet(f"{base}/in")
    out = entries_stream(spark.readStream.schema(texts.schema).parquet(f"{base}/in"))
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


# Transcripts


@query(f"WITH {sql.ENTRIES} SELECT video_id, entry_no, speaker, \"timestamp\", timestamp_seconds, text FROM entries")
def parse_entries(spark, d):
    return transcript.parse_entries(views.lines(spark, d)).drop("confidence")


@query(f"WITH RECURSIVE {sql.MERGED} SELECT video_id, entry_no, speaker, \"timestamp\", timestamp_seconds, text FROM merged")
def merge_consecutive(spark, d):
    return merged(spark, d).drop("confidence")


@query(f"WITH RECURSIVE {sql.MERGED} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first) AS position, speaker FROM (SELECT video_id, speaker, min(entry_no) AS first FROM merged WHERE speaker <> '' GROUP BY ALL)")
def speakers(spark, d):
    return transcript.speakers(merged(spark, d))


@query(f"WITH RECURSIVE {sql.MERGED} SELECT video_id, entry_no, text FROM merged WHERE speaker = 'Bob Jones'")
def entries_by_speaker(spark, d):
    return transcript.by_speaker(merged(spark, d), "Bob Jones").select("video_id", "entry_no", "text")


@query(f"WITH {sql.ENTRIES}, c AS (SELECT video_id, avg((line_no % 10) / 10) AS confidence FROM lines GROUP BY video_id) SELECT e.video_id, e.entry_no, round(c.confidence, 9) AS confidence FROM entries e JOIN c USING (video_id)")
def parse_confidence(spark, d):
    lines = views.lines(spark, d).withColumn("confidence", (F.col("line_no") % 10) / 10)
    return transcript.parse_with_confidence(lines, merge=False).select("video_id", "entry_no", F.round("confidence", 9).alias("confidence"))


@query(f"WITH RECURSIVE {sql.STATS}, c AS (SELECT video_id, avg((line_no % 10) / 10) AS mean FROM lines GROUP BY video_id) SELECT video_id, speakers, messages, word_count, unique_words, character_count, round(mean, 9) AS average_confidence FROM stats JOIN c USING (video_id)")
def transcript_stats(spark, d):
    lines = views.lines(spark, d).withColumn("confidence", (F.col("line_no") % 10) / 10)
    return transcript.statistics(transcript.parse_with_confidence(lines)).withColumn("average_confidence", F.round("average_confidence", 9))


@query(f"WITH RECURSIVE {sql.STATS} SELECT count(*) FILTER (video_id % 5 <> 0) AS succeeded, count(*) FILTER (video_id % 5 = 0) AS failed FROM meta")
def batch_summary(spark, d):
    jobs_ = views.meta(spark, d).select("video_id", F.when(F.col("video_id") % 5 == 0, "failed").alias("error"))
    return transcript.batch_summary(transcript.batch_rows(transcript.statistics(merged(spark, d)), jobs_))


@query(f"WITH RECURSIVE {sql.STATS}, {sql.FRAMES_TEXT}, n AS (SELECT video_id, count(*) AS frames_processed, count(*) FILTER ({sql.strip('full_text')} <> '') AS frames_with_text, count(DISTINCT full_text) AS n FROM ft GROUP BY video_id) SELECT raw.video_id, coalesce(speakers, 0) AS total_speakers, coalesce(messages, 0) AS total_messages, CASE WHEN coalesce(word_count, 0) > 0 THEN word_count ELSE {sql.count_words('raw_text')} END::BIGINT AS word_count, {sql.count_words('raw_text')}::BIGINT AS raw_word_count, frames_processed, frames_with_text, n / frames_processed AS deduplication_ratio FROM raw JOIN n USING (video_id) LEFT JOIN stats s USING (video_id)")
def job_stats(spark, d):
    f = views.frames_text(spark, d).withColumn("has_text", T.strip(F.col("full_text")) != "")
    blocks = f.groupBy("video_id").agg(F.count_distinct("full_text").alias("n"))
    return transcript.job_statistics(transcript.statistics(merged(spark, d)), views.raw_texts(spark, d), layout.text_frames(f), blocks)


# Formats


def _outputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return merged(spark, d), views.meta(spark, d), views.raw_texts(spark, d)


@query(
    f"""WITH RECURSIVE {sql.STATS},
b AS (SELECT video_id, string_agg('**' || speaker || '** (' || "timestamp" || ')' || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS blocks FROM merged GROUP BY video_id)
SELECT video_id, array_to_string(['# Meeting Transcript', '', '**Source**: ' || source_file, '**Duration**: ' || {sql.duration('duration_seconds')}, '**Date Extracted**: ' || left(extraction_timestamp, 10), '**OCR Engine**: ' || ocr_engine, '',
 '## Summary', '', '- **Speakers**: ' || coalesce(speakers, 0), '- **Messages**: ' || coalesce(messages, 0), '- **Word Count**: ' || coalesce(word_count, {sql.count_words('raw_text')}), '', '---', '',
 CASE WHEN blocks IS NOT NULL THEN '## Transcript' || chr(10) || chr(10) || blocks ELSE '## Extracted Text' || chr(10) || chr(10) || '{formats.RAW_MARKDOWN}' || chr(10) || chr(10) || {sql.strip('raw_text')} || chr(10) END,
 '---', '', '{formats.FOOTER}'], chr(10)) AS content
FROM meta JOIN raw USING (video_id) LEFT JOIN b USING (video_id) LEFT JOIN stats USING (video_id)"""
)
def format_markdown(spark, d):
    return formats.markdown(*_outputs(spark, d))


@query(
    f"""WITH RECURSIVE {sql.STATS},
b AS (SELECT video_id, string_agg('[' || "timestamp" || '] ' || speaker || ':' || chr(10) || '  ' || text || chr(10), chr(10) ORDER BY entry_no) AS blocks FROM merged GROUP BY video_id)
SELECT video_id, array_to_string(['Source: ' || source_file, 'Duration: ' || {sql.duration('duration_seconds')}, '', repeat('-', 50), '',
 CASE WHEN blocks IS NOT NULL THEN blocks ELSE '{formats.RAW_TEXT}' || chr(10) || chr(10) || {sql.strip('raw_text')} || chr(10) END], chr(10)) AS content
FROM meta JOIN raw USING (video_id) LEFT JOIN b USING (video_id)"""
)
def format_text(spark, d):
    return formats.plain_text(*_outputs(spark, d))


_CUES = f"""cues AS (SELECT video_id, entry_no AS cue_no, {sql.clock('timestamp_seconds')} || ',000' AS cue_start, {sql.clock('coalesce(lead(timestamp_seconds) OVER (PARTITION BY video_id ORDER BY entry_no), timestamp_seconds + 5)')} || ',000' AS cue_end,
  CASE WHEN speaker <> '' THEN '[' || speaker || '] ' || text ELSE text END AS body FROM merged)"""


@query(f"WITH RECURSIVE {sql.MERGED}, {_CUES} SELECT * FROM cues")
def srt_cues(spark, d):
    return formats.cues(merged(spark, d))


@query(f"WITH RECURSIVE {sql.MERGED}, {_CUES} SELECT video_id, string_agg(cue_no || chr(10) || cue_start || ' --> ' || cue_end || chr(10) || body || chr(10), chr(10) ORDER BY cue_no) AS content FROM cues GROUP BY video_id")
def format_srt(spark, d):
    return formats.subtitles(merged(spark, d))


_META_JSON = """'{"source_file":' || to_json(source_file) || ',"duration_seconds":' || duration_seconds || ',"frames_processed":' || frames_processed || ',"frames_with_text":' || frames_with_text || ',"extraction_timestamp":' || to_json(extraction_timestamp) || ',"ocr_engine":' || to_json(ocr_engine) || ',"confidence_threshold":' || confidence_threshold || '}'"""
_LISTED = f"listed AS (SELECT video_id, string_agg({sql.ENTRY_JSON}, ',' ORDER BY entry_no) AS transcript FROM merged GROUP BY video_id)"


@query(
    f"""WITH RECURSIVE {sql.STATS}, {_LISTED}
SELECT video_id, '{{"metadata":' || {_META_JSON} || ',"transcript":[' || coalesce(transcript, '') || '],"raw_text":' || to_json(raw_text) || ',"statistics":{{"total_speakers":' || coalesce(speakers, 0) || ',"total_messages":' || coalesce(messages, 0) || ',"word_count":' || coalesce(word_count, {sql.count_words('raw_text')}) || ',"unique_words":' || unique_words || ',"character_count":' || character_count || ',"average_confidence":0.0}}}}' AS content
FROM meta JOIN raw USING (video_id) LEFT JOIN listed USING (video_id) LEFT JOIN stats USING (video_id)"""
)
def format_json(spark, d):
    return formats.json_rows(*_outputs(spark, d))


@query(f"WITH RECURSIVE {sql.STATS}, {_LISTED} SELECT video_id, '{{\"transcript\":[' || coalesce(transcript, '') || ']}}' AS content FROM meta LEFT JOIN listed USING (video_id)")
def format_json_bare(spark, d):
    return formats.json_rows(*_outputs(spark, d), with_metadata=False, with_statistics=False, with_raw_text=False)


@query(
    f"""WITH RECURSIVE {sql.STATS},
b AS (SELECT video_id, string_agg('**' || speaker || '** (' || "timestamp" || ')' || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS blocks FROM merged GROUP BY video_id)
SELECT video_id, array_to_string(['# Meeting Transcript', '', '---', '', '## Transcript' || chr(10) || chr(10) || blocks, '---', '', '{formats.FOOTER}'], chr(10)) AS content FROM meta JOIN b USING (video_id)"""
)
def format_markdown_bare(spark, d):
    return formats.markdown(*_outputs(spark, d), with_metadata=False, with_statistics=False)


@query("SELECT conv_id AS video_id, 'meeting-' || conv_id || '.mp4' AS source_file, count(*) * 25.0::DOUBLE AS duration_seconds, count(*) * 2 AS frames_processed, count(*) AS frames_with_text, '2024-01-01T00:00:00Z' AS extraction_timestamp, 'table' AS ocr_engine, 0.5::DOUBLE AS confidence_threshold FROM conversations GROUP BY conv_id")
def output_metadata(spark, d):
    return views.meta(spark, d)


@query(
    f"""WITH RECURSIVE {sql.STATS},
b AS (SELECT video_id, string_agg('[' || "timestamp" || '] ' || speaker || ':' || chr(10) || '  ' || text || chr(10), chr(10) ORDER BY entry_no) AS blocks FROM merged GROUP BY video_id)
SELECT array_to_string([repeat('=', 60), 'COMBINED MEETING TRANSCRIPTS', repeat('=', 60), 'Videos: ' || count(*), 'Deduplication: Disabled', '',
 string_agg(repeat('-', 60) || chr(10) || 'FILE: ' || video_id || chr(10) || repeat('-', 60) || chr(10) || chr(10) || CASE WHEN blocks IS NOT NULL THEN blocks ELSE '{formats.RAW_TEXT}' || chr(10) || chr(10) || {sql.strip('raw_text')} || chr(10) END, chr(10) ORDER BY video_id)], chr(10)) AS content
FROM raw LEFT JOIN b USING (video_id)"""
)
def combined_output(spark, d):
    return formats.combined(_positioned(spark, d), merged(spark, d), kind="text")


def _positioned(spark: SparkSession, d: str) -> DataFrame:
    return views.raw_texts(spark, d).withColumn("pos", F.col("video_id"))


@query(
    f"""WITH RECURSIVE {sql.STATS},
b AS (SELECT video_id, string_agg('**' || speaker || '** (' || "timestamp" || ')' || chr(10) || text || chr(10), chr(10) ORDER BY entry_no) AS blocks FROM merged GROUP BY video_id),
n AS (SELECT *, row_number() OVER (ORDER BY video_id) AS no FROM raw LEFT JOIN b USING (video_id))
SELECT array_to_string(['# Combined Meeting Transcripts', '', '**Videos Combined**: ' || count(*), '**Deduplication**: Disabled', '', '## Source Files', '', string_agg(no || '. ' || video_id, chr(10) ORDER BY no), '', '---', '',
 string_agg('## ' || video_id || chr(10) || chr(10) || coalesce(blocks, '{formats.RAW_TEXTS_MARKDOWN}' || chr(10) || chr(10) || {sql.strip('raw_text')} || chr(10)) || chr(10) || '---' || chr(10), chr(10) ORDER BY no), '{formats.FOOTER}'], chr(10)) AS content FROM n"""
)
def combined_markdown(spark, d):
    return formats.combined(_positioned(spark, d), merged(spark, d), kind="markdown")


@query(
    f"""WITH RECURSIVE {sql.STATS}, {_LISTED},
s AS (SELECT video_id, string_agg(to_json(speaker), ',' ORDER BY first) AS speakers FROM (SELECT video_id, speaker, min(entry_no) AS first FROM merged WHERE speaker <> '' GROUP BY ALL) GROUP BY video_id),
v AS (SELECT video_id, raw_text, '{{"filename":' || to_json(video_id::VARCHAR) || ',"transcript":[' || coalesce(transcript, '') || '],"speakers":[' || coalesce(s.speakers, '') || '],"statistics":{{"total_speakers":' || coalesce(stats.speakers, 0) || ',"total_messages":' || coalesce(messages, 0) || ',"word_count":' || coalesce(word_count, {sql.count_words('raw_text')}) || '}}}}' AS said
  FROM raw LEFT JOIN listed USING (video_id) LEFT JOIN s USING (video_id) LEFT JOIN stats USING (video_id)),
a AS (SELECT count(*) AS n, string_agg(to_json(video_id::VARCHAR), ',' ORDER BY video_id) AS names, string_agg(said, ',' ORDER BY video_id) AS videos, string_agg(raw_text, chr(10) || chr(10) ORDER BY video_id) FILTER (raw_text <> '') AS text FROM v)
SELECT '{{"metadata":{{"combined_from":[' || names || '],"total_videos":' || n || ',"deduplicated":false}},"videos":[' || videos || '],"combined_raw_text":' || to_json(text) || ',"statistics":{{"total_words":' || {sql.count_words('text')} || '}}}}' AS content FROM a"""
)
def combined_json(spark, d):
    return formats.combined(_positioned(spark, d), merged(spark, d), kind="json")


@query()
def combined_deduplicated(spark, d):
    texts = _positioned(spark, d)
    return formats.combined(texts, merged(spark, d), dedup.cross_dedup_text(texts.select("pos", F.col("raw_text").alias("text"))), kind="markdown")


# Engines and jobs


@query("SELECT name, requires_gpu FROM (VALUES ('easyocr', false), ('tesseract', false), ('surya', true), ('doctr', false), ('trocr', true)) t(name, requires_gpu)")
def engine_registry(spark, d):
    return recognize.engines(spark).select("name", "requires_gpu")


@query(f"WITH {sql.REGIONS} SELECT video_id, frame_number, count(*)::BIGINT AS n FROM regions WHERE confidence >= 0.7 GROUP BY ALL")
def recognize_table(spark, d):
    found = recognize.recognize_from_table(views.document_frames(spark, d), views.regions(spark, d), 0.7)
    return found.groupBy("video_id", "frame_number").agg(F.count(F.lit(1)).alias("n"))


_SIDES = "video_id, frame_number, idx"


@query(f"WITH {sql.RAW_WORDS} SELECT {_SIDES}, text, (k % 100) / 100 AS confidence, trunc(k % 90 - 3.75)::BIGINT AS x, trunc(k % 40 + 0.5)::BIGINT AS y, trunc(k % 37 + 6.25)::BIGINT AS w, trunc(k % 11 + 1.5)::BIGINT AS h, 4 AS corners, trunc(k % 90 - 3.75)::BIGINT AS first_x FROM raw_words")
def detect_polygons(spark, d):
    k = F.col("k")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    left, top, right, bottom = k % 90 - 3.75, k % 40 + 0.5, k % 90 - 3.75 + k % 37 + 6.25, k % 40 + 2.0 + k % 11
    raw = views.raw_words(spark, d).withColumns({"polygon": F.array(corner(left, top + 1), corner(right, top), corner(right, bottom), corner(left + 1, bottom)), "confidence": (k % 100) / 100})
    return detections.from_polygons(raw).withColumns({"corners": F.size("polygon"), "first_x": F.col("polygon")[0]["x"]}).drop("polygon")


@query(f"WITH {sql.RAW_WORDS} SELECT {_SIDES}, {sql.strip('text')} AS text, (k % 103 - 1) / 100 AS confidence, k % 90 AS x, k % 40 AS y, k % 37 AS w, 12 AS h FROM raw_words WHERE {sql.strip('text')} <> '' AND k % 103 >= 1")
def detect_words(spark, d):
    k = F.col("k")
    raw = views.raw_words(spark, d).withColumns({"left": k % 90, "top": k % 40, "width": k % 37, "height": F.lit(12), "conf": (k % 103 - 1).cast("string")})
    return detections.from_words(raw)


@query(
    f"""WITH {sql.RAW_WORDS}, c AS (SELECT *, CASE WHEN text = '' AND k % 2 = 0 THEN 'x' || (k % 10) || 'y' ELSE text END AS said FROM raw_words)
SELECT {_SIDES}, {sql.strip('said')} AS text, CASE WHEN k % 5 = 0 THEN 0.9::DOUBLE ELSE (k % 100) / 100 END AS confidence,
 CASE WHEN k % 3 < 2 THEN trunc(k % 90 + 0.75)::BIGINT ELSE 0 END AS x, CASE WHEN k % 3 < 2 THEN k % 40 ELSE 0 END AS y, CASE WHEN k % 3 < 2 THEN greatest(1, trunc(k % 37 - 0.5)::BIGINT) ELSE 100 END AS w, CASE WHEN k % 3 < 2 THEN greatest(1, k % 9) ELSE 20 END AS h
FROM c WHERE {sql.strip('said')} <> ''"""
)
def detect_lines(spark, d):
    k = F.col("k")
    left, top, right, bottom = k % 90 + 0.75, (k % 40).cast("double"), k % 90 + 0.75 + k % 37 - 0.5, (k % 40 + k % 9).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    four, three = F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom)), F.array(corner(left, top), corner(right, top), corner(right, bottom))
    chars = F.when(k % 2 == 0, F.array(F.lit("x"), (k % 10).cast("string"), F.lit("y")))
    raw = views.raw_words(spark, d).withColumns({"chars": chars, "confidence": F.when(k % 5 != 0, (k % 100) / 100), "bbox": F.when(k % 3 == 0, F.array(left, top, right, bottom)), "polygon": F.when(k % 3 == 1, four).when(k % 3 == 2, three)})
    return detections.from_lines(raw)


@query(
    f"""WITH {sql.RAW_WORDS}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY k) - 1 AS n FROM raw_words)
SELECT video_id, frame_number, n AS idx, {sql.strip('text')} AS text, (k % 100) / 100 AS confidence, k % 90 * 10 AS x, k % 40 * 10 AS y, greatest(1, k % 7 * 10) AS w, greatest(1, k % 3 * 10) AS h FROM f WHERE {sql.strip('text')} <> ''"""
)
def detect_pages(spark, d):
    k = F.col("k")
    corner = lambda x, y: F.struct((x / 128).alias("x"), (y / 64).alias("y"))
    word = F.struct(F.col("text").alias("value"), ((k % 100) / 100).alias("confidence"), F.array(corner(k % 90, k % 40), corner(k % 90 + k % 7, k % 40 + k % 3)).alias("geometry"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("k", word.alias("word")))), lambda x: x["word"])
    frames_ = views.raw_words(spark, d).groupBy("video_id", "frame_number").agg(words.alias("all"))
    # Two pages of two blocks of two lines of words, as far as they go.
    eighth = F.greatest(F.lit(1), F.ceil(F.size("all") / 8)).cast("int")
    line = lambda i: F.struct(F.slice("all", eighth * i + 1, eighth).alias("words"))
    block = lambda i: F.struct(F.array(line(i), line(i + 1)).alias("lines"))
    page = lambda i: F.struct(F.array(block(i), block(i + 2)).alias("blocks"))
    return detections.from_pages(frames_.select("video_id", "frame_number", F.array(page(0), page(4)).alias("pages")), 1280, 640)


@query(f"WITH {sql.RAW_WORDS} SELECT {_SIDES}, {sql.strip('text')} AS text, round(CASE WHEN k % 4 = 0 THEN 0.85::DOUBLE ELSE 1 / (1 + exp(-((k % 9) - 4.0::DOUBLE))) END, 9) AS confidence, k % 90 AS x, k % 40 AS y, 30::BIGINT AS w, 12::BIGINT AS h FROM raw_words WHERE {sql.strip('text')} <> ''")
def detect_crops(spark, d):
    k = F.col("k")
    raw = views.raw_words(spark, d).withColumns({"score": F.when(k % 4 != 0, (k % 9) - 4.0), "x": k % 90, "y": k % 40, "w": F.lit(30), "h": F.lit(12)})
    return detections.from_crops(raw).withColumn("confidence", F.round("confidence", 9))


@query(f"WITH RECURSIVE {sql.RAW_WORDS}, regions AS (SELECT video_id, frame_number, k AS idx, k * 7 % 600 AS x, k * 11 % 440 AS y, k % 40 AS w, k % 13 AS h FROM raw_words), {sql.lines_of('w > 10 AND h > 5', '>= 20')}, b AS (SELECT video_id, frame_number, line_no, greatest(0, min(x) - 5) AS x, greatest(0, min(y) - 5) AS y, least(640, max(x + w) + 5) AS r, least(480, max(y + h) + 5) AS s FROM lined GROUP BY ALL) SELECT video_id, frame_number, line_no::BIGINT AS line_no, x::BIGINT AS x, y::BIGINT AS y, (r - x)::BIGINT AS w, (s - y)::BIGINT AS h FROM b WHERE r - x > 20 AND s - y > 10")
def detect_boxes(spark, d):
    k = F.col("k")
    boxes = views.raw_words(spark, d).select("video_id", "frame_number", k.alias("idx"), (k * 7 % 600).alias("x"), (k * 11 % 440).alias("y"), (k % 40).alias("w"), (k % 13).alias("h"))
    return detections.detected_boxes(boxes, 640, 480)


@query(f"WITH {sql.RAW_WORDS} SELECT {_SIDES}, k % 90 AS x FROM raw_words WHERE k % 200 >= 100")
def detect_contours(spark, d):
    return detections.from_contours(views.raw_words(spark, d).select("video_id", "frame_number", "idx", (F.col("k") % 90).alias("x"), (F.col("k") % 200).alias("area")))


# Pixels


@query(f"WITH {sql.IMAGES} SELECT image_id, level, count(*) AS n FROM grey GROUP BY ALL")
def grey_histogram(spark, d):
    counts = images.histogram(views.images(spark, d)).select("image_id", F.posexplode("vector").alias("level", "n"))
    return counts.filter("n > 0")


_IMAGE_PAIRS = "JOIN {0} y ON y.image_id = x.image_id + 6"


def _image_pairs(spark: SparkSession, d: str, of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    e = of(views.images(spark, d)).select("image_id", F.col(name).alias("a"))
    # Spark takes an array for one element in its estimates and would broadcast any number of histograms.
    return e.join(e.select((F.col("image_id") - 6).alias("image_id"), F.col("a").alias("b")).hint("merge"), "image_id")


@query(f"WITH {sql.IMAGES}, c AS (SELECT image_id, level, count(*) AS n FROM grey GROUP BY ALL), full_ AS (SELECT image_id, l AS level FROM shapes, (SELECT unnest(range(256)) AS l)), h AS (SELECT f.image_id, f.level, coalesce(n, 0) AS n FROM full_ f LEFT JOIN c ON c.image_id = f.image_id AND c.level = f.level) SELECT x.image_id, round((corr(x.n, y.n) + 1) / 2, 9) AS similarity FROM h x JOIN h y ON y.image_id = x.image_id + 6 AND y.level = x.level GROUP BY x.image_id")
def image_similarity(spark, d):
    pairs = _image_pairs(spark, d, images.histogram, "vector")
    return pairs.select("image_id", F.round(images.similarity(pairs), 9).alias("similarity"))


@query(f"WITH {sql.IMAGES} SELECT x.image_id, round(greatest(0.0, 1 - avg((x.level - y.level) ** 2) / (255.0 * 255.0)), 9) AS similarity FROM grey x JOIN grey y ON y.image_id = x.image_id + 6 AND y.p = x.p GROUP BY x.image_id")
def image_similarity_mse(spark, d):
    pairs = _image_pairs(spark, d, images.levels, "levels")
    return pairs.select("image_id", F.round(images.similarity(pairs, "mse"), 9).alias("similarity"))


_CUT = "string_agg(printf('%02X', v::INT), '' ORDER BY i)"


@query(f"WITH {sql.IMAGES}, c AS (SELECT *, i // 3 % width AS px, i // 3 // width AS py, image_id % 4 AS x, image_id % 2 AS y, image_id % 5 + 1 AS w FROM bytes) SELECT image_id, least(w, greatest(0, width - x)) AS width, height - y AS height, {_CUT} AS pixels FROM c WHERE px >= x AND px < x + w AND py >= y GROUP BY image_id, width, height, x, y, w")
def image_crop(spark, d):
    i = F.col("image_id")
    shaped = views.images(spark, d).withColumns({"x": (i % 4).cast("int"), "y": (i % 2).cast("int"), "w": (i % 5 + 1).cast("int"), "h": F.lit(9)})
    return images.crop(shaped).select("image_id", "width", "height", F.hex("image").alias("pixels")).filter("pixels <> ''")


@query(f"WITH {sql.IMAGES} SELECT image_id, string_agg(printf('%02X%02X%02X', r::INT, g::INT, b::INT), '' ORDER BY p) AS pixels FROM pixels GROUP BY image_id")
def image_channels(spark, d):
    return images.reverse_channels(views.images(spark, d)).select("image_id", F.hex("image").alias("pixels"))


_JOBS = "j AS (SELECT o_orderkey AS job_id, ['pending', 'processing', 'complete', 'error'][(o_orderkey % 4 + 1)::INT] AS status, 'v' || o_orderkey AS filename, CASE WHEN o_orderkey % 8 = 2 THEN 'done' END AS result FROM orders WHERE o_orderkey % 3 <> 0), q AS (SELECT o_orderkey AS item_id, o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderkey * 7919 % 1000003, o_orderkey) AS position FROM orders)"


@query(f"WITH {_JOBS} SELECT item_id, q.job_id, position, coalesce(status, 'queued') AS status FROM q LEFT JOIN j ON j.job_id = q.job_id")
def queue_status(spark, d):
    return jobs.queue_status(*views.jobs(spark, d))


@query(f"WITH {_JOBS} SELECT item_id, position, filename, result FROM q JOIN j ON j.job_id = q.job_id WHERE status = 'complete' AND result IS NOT NULL")
def queue_results(spark, d):
    return jobs.results(*views.jobs(spark, d))


@query(f"WITH {_JOBS}, m AS (SELECT max(position) AS n FROM q), l AS (SELECT max(o_orderkey * 7919 % 1000003) AS last FROM orders) SELECT item_id, job_id, position FROM q UNION ALL SELECT n_nationkey + 100000000, n_nationkey, n + row_number() OVER (ORDER BY n_nationkey) FROM nation, m")
def queue_add(spark, d):
    new = views.table(spark, d, "nation").select((F.col("n_nationkey") + 100000000).alias("item_id"), F.col("n_nationkey").alias("job_id"))
    return jobs.positions(jobs.add(views.jobs(spark, d)[0], new)).select("item_id", "job_id", "position")


@query(f"WITH {_JOBS} SELECT item_id, q.job_id FROM q LEFT JOIN j ON j.job_id = q.job_id WHERE item_id % 5 <> 0 OR coalesce(status, 'queued') = 'processing'")
def queue_remove(spark, d):
    q, j = views.jobs(spark, d)
    return jobs.remove(q, j, q.filter("item_id % 5 = 0")).select("item_id", "job_id")


@query(f"WITH {_JOBS} SELECT item_id, q.job_id FROM q JOIN j ON j.job_id = q.job_id WHERE status = 'processing'")
def queue_clear(spark, d):
    return jobs.remove(*views.jobs(spark, d)).select("item_id", "job_id")


@query(f"WITH {_JOBS} SELECT item_id, q.job_id, position, 'queued' AS status FROM q LEFT JOIN j ON j.job_id = q.job_id WHERE status IS NULL")
def queue_ready(spark, d):
    return jobs.ready(*views.jobs(spark, d))


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status IN ('pending', 'error') THEN 'processing' ELSE status END AS status FROM j")
def job_moves(spark, d):
    _, j = views.jobs(spark, d)
    return jobs.move(j, j.select("job_id", F.lit("processing").alias("new_status"))).select("job_id", "status")


@query("SELECT n, target FROM (VALUES ('json', '/out/a.json'), ('markdown', '/out/a.md'), ('text', '/out/a.txt'), ('all', '/out/a')) t(n, target)")
def output_routes(spark, d):
    return spark.createDataFrame([(kind, sinks.target(None, "/out/a.mp4", kind)) for kind in ("json", "markdown", "text", "all")], "n string, target string")


@query()
def whole_pipeline(spark, d):
    return pipeline.transcripts(views.turn_regions(spark, d))["statistics"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the transcripts of all conversations."""
    return QUERIES["transcript_stats"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
