"""Running sums over a whole table without one task that sees it: ranges of the order, sums of each, then offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolex.sources.checkpoints import written

RANGES = 1024  # at most; a row for each comes to the driver


def before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows``, whose ``order`` is distinct, with ``name``: the sum of ``value`` (whole numbers) over the rows before each; 0 of none.

    Rows are dealt into ranges of ``order`` once (a written table, so that each later read sees the same ranges). A range's rows
    are summed up in its task, and the sums of the ranges before it are added as one number a range."""
    session = rows.sparkSession
    ranges = min(RANGES, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()))
    total, starts = 0, []
    for r in sorted(dealt.groupBy("_range").agg(F.sum(value).alias("n")).collect(), key=lambda r: r["_range"]):
        starts += [F.lit(r["_range"]), F.lit(total)]
        total += r["n"] or 0
    if not starts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.create_map(*starts), F.col("_range"))
    return dealt.withColumn(name, (F.coalesce(F.sum(value).over(within), F.lit(0)) + start).cast("long")).drop("_range")
