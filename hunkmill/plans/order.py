"""Positions and running sums over a whole table, without a window that gathers all rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkmill.plans.lineage import cut


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions of the order, written once so that partition numbers stay as they are."""
    return cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _with_offsets(placed: DataFrame, amount: Column) -> DataFrame:
    """``placed`` with ``_before``: the sum of ``amount`` over all earlier ranges. One row a partition goes to the driver and back."""
    sums = sorted((r[0], r[1]) for r in placed.groupBy("_range").agg(F.sum(amount)).collect())
    befores = [0, *accumulate(n or 0 for _, n in sums)]
    offsets = placed.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(sums, befores)], "_range int, _before bigint")
    return placed.join(F.broadcast(offsets), "_range")


def indexed(rows: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """``rows`` with their 0-based position in ``order`` as ``name``. The order should be total: rows that tie share a range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = _with_offsets(_ranged(rows, cols), F.lit(1).cast("bigint"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*cols)) - 1
    return placed.withColumn(name, F.col("_before") + within).drop("_range", "_before")


def running_sum(rows: DataFrame, value: str, *order: Column | str, name: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to and with their own in ``order``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = _with_offsets(_ranged(rows, cols), F.col(value))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, F.col("_before") + within).drop("_range", "_before")
