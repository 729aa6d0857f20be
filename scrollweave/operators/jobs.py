"""Jobs and the queue, as tables: status, lookups, results.

``jobs``: job_id, status, filename, result (null until complete), error.
``queue``: item_id, job_id, added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: What may follow a status.
NEXT = {"pending": {"processing"}, "queued": {"processing"}, "processing": {"complete", "error"}, "error": {"processing"}, "complete": set()}


def can_move(old: str, new: str) -> bool:
    return new in NEXT.get(old, set())


def move(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``jobs`` after changes (job_id, new_status): only those allowed take effect."""
    pairs = F.array(*(F.lit(f"{a}>{b}") for a, bs in NEXT.items() for b in sorted(bs)))
    allowed = F.array_contains(pairs, F.concat("status", F.lit(">"), "new_status"))
    return jobs.join(changes, "job_id", "left").withColumn("status", F.when(allowed, F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def positions(queue: DataFrame) -> DataFrame:
    """Add position: 1 for what was added first.

    The queue is dealt by ranges of (added, item_id), which are written, so that
    ranks in a range and the sizes of those before it agree; one row for each
    range meets in one task.
    """
    ranged = queue.repartitionByRange(F.col("added"), F.col("item_id")).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "queue")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(sizes.select("_range", before.alias("_first")))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("added", "item_id"))
    return ranged.withColumn("_nth", nth).join(first, "_range").withColumn("position", (F.col("_first") + F.col("_nth")).cast("long")).drop("_range", "_nth", "_first")


def add(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with ``items`` (item_id, job_id) after all that is in it, in the order of their ids."""
    last = queue.agg(F.coalesce(F.max("added"), F.lit(0)).alias("_last"))
    new = items.withColumn("_one", F.lit(1)).join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one")  # one row
    return queue.unionByName(new.select("item_id", "job_id", (F.col("_last") + 1).alias("added")))


def queue_status(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """item_id, job_id, position, status: items without a job are ``queued``."""
    return positions(queue).join(jobs.select("job_id", "status"), "job_id", "left").select("item_id", "job_id", "position", F.coalesce("status", F.lit("queued")).alias("status"))


def ready(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    return queue_status(queue, jobs).filter("status = 'queued'")


def results(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """item_id, position, filename, result of complete items with a result."""
    done = jobs.filter("status = 'complete' and result is not null")
    return positions(queue).join(done, "job_id").select("item_id", "position", "filename", "result")


def remove(queue: DataFrame, jobs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The queue without ``items`` (item_id; None: without any); items being processed stay."""
    busy = queue.join(jobs.filter("status = 'processing'").select("job_id"), "job_id", "left_semi").select("item_id")
    gone = (queue if items is None else items).select("item_id").join(busy, "item_id", "left_anti")
    return queue.join(gone, "item_id", "left_anti")
