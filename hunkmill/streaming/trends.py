"""Trends over a stream of merged changes. The reference has none; these follow its batch trends with a watermark on the time of merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T
from hunkmill.operators.confidence import change_times


def adoption_by_window(diffs: DataFrame, pattern: list[str], window: str = "30 days", late: str = "60 days") -> DataFrame:
    """(start, adopted): applied changes a window of merge time; rows later than ``late`` are left out, so state stays bounded.

    A time without zone is read in the session's zone.
    """
    times = change_times(diffs, pattern).select(F.col("merged_at").cast("timestamp").alias("merged_at")).withWatermark("merged_at", late)
    return times.groupBy(F.window("merged_at", window).alias("w")).agg(F.count(F.lit(1)).alias("adopted")).select(F.col("w.start").alias("start"), "adopted")


def occurrence_by_window(lines: DataFrame, pattern: list[str], time: str = "merged_at", line: str = "line", window: str = "365 days", late: str = "60 days") -> DataFrame:
    """(start, old_lines, new_lines): lines with the old and with the new form of a pattern a window of time."""
    p = F.array(*[F.lit(t) for t in pattern])
    rows = lines.select(F.col(time).cast("timestamp").alias("at"), F.coalesce(line, F.lit("")).alias("line")).withWatermark("at", late)
    sums = rows.groupBy(F.window("at", window).alias("w")).agg(F.count_if(T.triggers(p, F.col("line"))).alias("old_lines"), F.count_if(T.applied(p, F.col("line"))).alias("new_lines"))
    return sums.select(F.col("w.start").alias("start"), "old_lines", "new_lines")
