"""Mixing sources to target weights (4), native.

A low-discrepancy schedule: slot t has the point frac((t + 1/2) * golden
ratio), which the sources' cumulative shares map to a source. Slots are ranked
per source, and the r-th slot of a source takes the r-th block of its shuffled
words; all blocks have ``block_words`` words, and a source that is used up
starts again. Ranks beyond a source's target are not used, ranks that the
schedule left out follow at its end, so each source gives its target, rounded.

Scale: sums per source are pre-aggregated. Both the places of documents in
their source and the ranks of slots are running sums in two levels, so that a
source with a third of all rows is spread over 4096 buckets; blocks are joined
by (source, rank), which spreads it too. The only single-task windows run over
one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_few, running_sum, settle, word_count

#: Weights of the sources, in turn; the mix in times of all words; the most a source is used.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS = 4096
GOLDEN = 0.6180339887498949


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source (null is one).

    Water filling. In order of cap / weight, a source is capped if the level,
    with all before it at their caps, is above its own cap / weight; the others
    share the rest by weight. That is where repeated resharing ends.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1).cast("double"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap", F.col("source_size") * MOST)
    per = per.withColumns({"total": F.sum("source_size").over(every) * TOTAL, "weight": F.sum("w").over(every)})
    per = per.withColumns({"caps": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(order), F.lit(0.0))})
    per = per.withColumn("capped", (F.col("total") - F.col("caps")) / (F.col("weight") - F.col("gone")) > F.col("cap") / F.col("w"))
    full = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(every)
    per = per.withColumns({"caps": full("cap"), "gone": full("w")})
    rest = F.col("w") * ((F.col("total") - F.col("caps")) / F.nullif(F.col("weight") - F.col("gone"), F.lit(0.0)))
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(rest).alias("target"))


def schedule(spark: SparkSession, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, r: slot takes block r of source. Blocks that the schedule left out have later slots, by their r.

    ``plan`` has source and words (what the source is to give).
    """
    plan = plan.filter("words > 0").withColumn("need", F.expr(f"(words + {block_words - 1}) div {block_words}"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    shares = plan.withColumns({"hi": F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("need").over(every)})
    shares = shares.select("source", "need", "all", ((F.col("hi") - F.col("need")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi"))
    slots = plan.agg(F.sum("need")).first()[0] or 0
    # A share covers cells of a grid, so that points find their source by an equal cell.
    cells = shares.withColumn("cell", F.explode(F.expr("sequence(cast(floor(lo * 1024) as int), cast(floor(hi * 1024) as int))")))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN).alias("x"))
    points = points.select("slot", (F.col("x") - F.floor("x")).alias("x"), F.expr("slot div 4096").alias("part"))
    points = points.withColumn("cell", F.floor(F.col("x") * 1024).cast("int"))
    hit = points.join(cells, "cell").filter("x >= lo and x < hi").select("slot", "source", "need", "part")
    ranked = running_sum(hit, ["source"], "part", ["slot"], F.lit(1), "r")
    used = hit.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "_s")
    late = plan.join(used, plan.source.eqNullSafe(F.col("_s")), "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
    late = late.select((F.lit(slots) + F.col("n")).alias("slot"), "source", F.explode(F.expr("sequence(n, need - 1)")).alias("r"))
    return ranked.filter("r < need").select("slot", "source", "r").unionByName(late)


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, p: the words of a source, its documents shuffled, have places; p is the first of a document."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = settle(sized.withColumn("part", F.substring("h", 1, 3)), "sized")
    return running_sum(sized, ["source"], "part", ["h", "doc_id", "size"], F.col("size"), "p").select("doc_id", "source", "size", "p")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, second_slot, source, p: one row for each row of ``docs``.

    A null text has no words, and a document without words is not taken; a null
    source is a source of its own, named last; ids may be null or repeat (each
    row has places of its own). A document across a block's edge belongs to
    both blocks. first_slot is the schedule's first slot with words of the
    document, second_slot the first in which it comes again; null where there is
    none. An empty table gives an empty result. Same rows, same result.
    """
    placed = settle(places(docs, id_col, text_col, source_col), "places")
    plan = settle(targets(placed), "targets").withColumn("words", F.floor(F.col("target") + 0.5))
    plan = plan.withColumnRenamed("source", "_src")
    slots = schedule(docs.sparkSession, plan.select(F.col("_src").alias("source"), "words"), block_words)
    full = placed.join(plan, placed.source.eqNullSafe(plan._src)).drop("_src")
    # Where a document stands in its source's words, the first time and again. Each has a first time, if only beyond the
    # target (no words then), so that no join has to bring back what isn't taken.
    turns = full.filter("size > 0").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")))
    turns = turns.withColumn("a", F.col("p") + F.col("turn") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words")))
    turns = turns.filter("turn = 0 or a < b").withColumn("r", F.explode(F.expr(f"sequence(a div {block_words}, greatest(a, b - 1) div {block_words})")))
    slots = slots.withColumnsRenamed({"source": "_src", "r": "_r"})
    held = turns.join(slots, turns.source.eqNullSafe(slots._src) & (turns.r == slots._r), "left")
    held = held.withColumn("words", F.greatest(F.lit(0), F.least("b", (F.col("r") + 1) * block_words) - F.greatest("a", F.col("r") * block_words)))
    first = lambda turn: F.min(F.when((F.col("turn") == turn) & (F.col("words") > 0), F.col("slot")))
    key = ["source", "p", "doc_id", "size", "source_size", "target"]
    taken = held.groupBy(*key).agg(F.sum("words").alias("taken"), first(0).alias("first_slot"), first(1).alias("second_slot"))
    none = full.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), *(F.lit(None).cast("long").alias(c) for c in ("first_slot", "second_slot")))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "second_slot", "source", "p")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them, in the order of the schedule: a row for each time, rounded where the target cuts a document.

    All columns stay, whatever their names; files of the result, one after the
    other, have the rows by slot. Texts without words (or null) are not taken;
    rows that repeat id, source and size are taken alike; an empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    key = lambda i, s, n: (F.col(i).alias("tid"), F.col(s).alias("tsrc"), F.col(n).alias("tsize"))
    mixed = mix(docs).groupBy(*key("doc_id", "source", "size"))
    mixed = mixed.agg(F.sum("taken").alias("words"), F.count(F.lit(1)).alias("n"), F.min("first_slot").alias("one"), F.min("second_slot").alias("two")).filter("words > 0")
    times = F.floor(F.col("words") / (F.col("n") * F.col("tsize")) + 0.5).cast("int")
    mixed = settle(mixed.select("tid", "tsrc", "tsize", F.slice(F.array_compact(F.array("one", "two")), 1, times).alias("slots")).filter("size(slots) > 0"), "taken")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), word_count(F.col("text")).alias("size"))
    out = rows.join(mixed, rows.id.eqNullSafe(mixed.tid) & rows.src.eqNullSafe(mixed.tsrc) & (rows.size == mixed.tsize)).select("row", F.explode("slots").alias("slot"), "id")
    # Slots are numbers from 0, so that their ranges need no sampling.
    parts, last = int(spark.conf.get("spark.sql.shuffle.partitions")), mixed.agg(F.max(F.array_max("slots"))).first()[0] or 0
    out = out.repartitionById(parts, F.expr(f"cast(slot * {parts} div {last + 1} as int)")).sortWithinPartitions("slot", "id")
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return in_few(mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot"))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM per),
run AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total, sum(w) OVER () AS weight,
         coalesce(sum(cap) OVER before, 0.0) AS caps, coalesce(sum(w) OVER before, 0.0) AS gone
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flag AS (SELECT *, (total - caps) / (weight - gone) > cap / w AS capped FROM run),
level AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER () AS allcaps, sum(CASE WHEN capped THEN w ELSE 0.0 END) OVER () AS allgone FROM flag),
goal AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * ((total - allcaps) / nullif(weight - allgone, 0.0)) END AS target FROM level),
plan AS (SELECT *, floor(target + 0.5)::BIGINT AS words, (floor(target + 0.5)::BIGINT + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS need FROM goal),
shares AS (
  SELECT source, need, sum(need) OVER (ORDER BY source NULLS LAST)::BIGINT AS hi, sum(need) OVER ()::BIGINT AS every FROM plan WHERE words > 0),
points AS (SELECT slot, (slot::DOUBLE + 0.5::DOUBLE) * {GOLDEN}::DOUBLE AS x FROM (SELECT unnest(range((SELECT sum(need)::BIGINT FROM plan WHERE words > 0))) AS slot)),
hit AS (
  SELECT slot, source, need, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r
  FROM points JOIN shares ON x - floor(x) >= (hi - need)::DOUBLE / every AND x - floor(x) < hi::DOUBLE / every),
used AS (SELECT source, count(*) AS n FROM hit GROUP BY source),
slots AS (
  SELECT slot, source, r FROM hit WHERE r < need
  UNION ALL
  SELECT (SELECT count(*) FROM points) + r, source, r
  FROM (SELECT s.source, unnest(range(coalesce(n, 0), need)) AS r FROM shares s LEFT JOIN used u ON s.source IS NOT DISTINCT FROM u.source)),
full_ AS (SELECT placed.*, source_size, target, words FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source),
first_ AS (
  SELECT f.source, f.p, min(slot) AS first_slot
  FROM full_ f JOIN slots s ON f.source IS NOT DISTINCT FROM s.source AND s.r >= f.p // {BLOCK_WORDS} AND s.r <= (least(f.p + f.size, f.words) - 1) // {BLOCK_WORDS}
  WHERE f.size > 0 AND f.p < f.words GROUP BY ALL)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(f.p + size, words) - f.p) + greatest(0, least(f.p + source_size + size, words) - f.p - source_size))::BIGINT AS taken,
       CASE WHEN size > 0 THEN first_slot END AS first_slot
FROM full_ f LEFT JOIN first_ ON f.source IS NOT DISTINCT FROM first_.source AND f.p = first_.p
"""
