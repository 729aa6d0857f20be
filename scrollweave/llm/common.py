"""What the operators share: the shared folder and two-level running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget as drop_settled
from ..shared import scratch

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"


#: Files of a settled table for each core of the cluster, where its inputs are small.
FILES = 4
#: Bytes of a row group of a settled table.
ROW_GROUP = 16 << 20


def _few(df: DataFrame) -> int:
    """How many tasks are enough to write ``df``: one for each split of what it reads, or ``FILES`` for each core."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(FILES * spark.sparkContext.defaultParallelism, min(-(-size // split), 1 << 30))


def in_few(df: DataFrame) -> DataFrame:
    """``df`` written by few tasks: partitions that are small for what is read don't become a file each."""
    return df.coalesce(_few(df))


def settle(df: DataFrame, name: str, few: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a committed table that outlives any executor. The
    files go when the JVM ends. Partitions that are small for what is read are
    written several by one task, so that they don't become as many files; with
    ``few`` false, each is a task (which functions that ask for their task's
    number need).
    """
    spark = df.sparkSession
    if few:
        df = in_few(df)
    path = scratch(spark, name)
    # Row groups are held in memory until they are written, and when they are read.
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of ``group``.

    Rows are ordered by ``bucket`` and then ``order``; ``bucket`` must be a
    function of the order, coarse enough to be summed per group. No task gets
    a whole group: only the sums per bucket meet, and rows meet per bucket. A
    bucket's rows follow a row with the sum of all before it, so that they are
    dealt and sorted once, without a join. Groups may be null.
    """
    rows = df.withColumn("_v", value)
    sums = rows.groupBy(*group, bucket).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_v"), F.lit(0).alias("_own"))
    rows = rows.withColumn("_own", F.lit(1)).unionByName(sums, allowMissingColumns=True)
    within = Window.partitionBy(*group, bucket).orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum("_v").over(within), F.lit(0))).filter("_own = 1").drop("_v", "_own")


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that are no white space; null: 0."""
    some = F.regexp_replace(text, f"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x")
    return F.when(text.rlike(f"[^{SPACES}]"), F.length(some)).otherwise(0).cast("long")
