"""Exact dedup (9): deterministic block naming.

Texts are cut into fixed-size blocks of bytes. The distinct blocks are sorted
and numbered, so equal blocks (and only these) have equal integer names. Then
the names of adjacent blocks are paired, the distinct pairs named, and so on,
until each text has one name. (level, name) is an identity without collisions:
no digest decides what is equal.

Scale: equal blocks are counted before the shuffle; a block that a third of all
rows share is one row per map task there, and its rows in the join back are
split by the skew join. A block that occurs once needs no number but its place. After the first level only integers
move. The number of levels is the logarithm of the longest text's blocks. All
of it is DataFrame operations; blocks are cut where texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

BLOCK_BYTES = 2048


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name``: equal for equal ``keys`` only. ``rows`` have a ``place`` of their own.

    Keys that occur once are named by their place, below 0. The others are
    sorted and numbered: a hash partition holds a fixed set of them, so each
    gets the same number in every run of the task. They are written, so that
    the join back is one of two tables, which is split where a key is hot.
    """
    names = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*keys).sortWithinPartitions(*keys)
    names = settle(names.select(*keys, F.monotonically_increasing_id().alias("name")), "names")
    return rows.join(names, keys, "left").withColumn("name", F.coalesce("name", -1 - F.col("place")))


#: Stands for the block after the last, where their number is odd; no name is as low.
NO_BLOCK = -(1 << 63)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, sha (its text's SHA-256), row (its number), level, name.

    (level, name) is equal for equal texts only. A null text counts as empty;
    an empty text has one empty block. Repeated rows give repeated rows. The
    digest is for those who look rows up by text; nothing here compares it.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data"), F.monotonically_increasing_id().alias("row"))
    texts = texts.withColumn("n", F.greatest(F.lit(1), F.expr(f"cast((octet_length(data) + {block_bytes - 1}) div {block_bytes} as int)")))
    head = F.when(F.col("pos") == 0, F.struct("doc_id", "sha"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = texts.select("row", "n", "doc_id", F.unhex(F.sha2("data", 256)).alias("sha"), F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.select("row", "n", "pos", head.alias("head"), "block", F.monotonically_increasing_id().alias("place"))
    level = settle(_named(blocks, ["block"]).drop("block"), "block-names")
    rows = level.filter("pos = 0").select("row", "head.doc_id", "head.sha")
    most = level.agg(F.max("n")).first()[0] or 1
    level = level.select("row", "n", "pos", "name", "place")
    done = [level.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    number = 0
    while most > 1:
        number, most = number + 1, (most + 1) // 2
        pairs = level.filter("n > 1").groupBy("row", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(pos div 2 as int)").alias("pos"))
        pairs = pairs.agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(NO_BLOCK)).alias("b"), F.min("place").alias("place"))
        level = settle(_named(pairs, ["a", "b"]).drop("a", "b"), "pair-names")
        done.append(level.filter("n = 1").select("row", F.lit(number).alias("level"), "name"))
    last = done[0]
    for more in done[1:]:
        last = last.unionByName(more)
    return rows.join(last, "row").select("doc_id", "sha", "row", "level", "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Of equal texts, the row with the largest id stays; of repeated rows with
    that id one stays. A null id is smaller than any other; keep_id is null
    only if all ids of the group are. Other columns are not looked at. An empty
    table gives an empty result.
    """
    named = settle(identities(docs, id_col, text_col, block_bytes), "identities")
    # Written before it is joined, so that a hot group can be split.
    groups = settle(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.col("row") == F.col("keep.row")
    each = named.join(groups, ["level", "name"])
    return each.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns stay.

    Columns of ``docs`` may have any names and types. Of rows that repeat an id
    and a text, one stays.
    """
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("kid"), F.unhex("text_sha256").alias("ksha"))
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    own = own.join(kept, own.id.eqNullSafe(kept.kid) & (own.sha == kept.ksha), "left_semi")
    return own.dropDuplicates(["id", "sha"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL)
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
