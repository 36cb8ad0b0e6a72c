"""How the number of distinct token combinations grows with the number of hunks read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.operators.mining import combinations_of
from hunkmill.plans.order import indexed, running_sum


def growth_curve(sequences: DataFrame, *order: Column | str, tokens: str = "tokens", batch: int = 10, max_size: int = 10, exact_total: bool = True) -> DataFrame:
    """(batch, sequences, combinations): after each batch of ``batch`` sequences in ``order``, how many were read and how many distinct
    combinations of 2 to ``max_size`` tokens they have given so far.

    A combination counts in the first batch that gives it; only combinations with their batch are shuffled, with a map-side minimum, and
    positions and running sums go by range partitions. ``exact_total=False`` counts a short last batch as a full one, as the reference does.
    Null sequences count as read and give nothing. The combinations of one sequence grow as its length to the power ``max_size``.
    """
    rows = indexed(sequences, *order, name="_at").select(F.floor(F.col("_at") / batch).cast("bigint").alias("batch"), F.col(tokens).alias("tokens"))
    read = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    made = rows.select("batch", F.explode(combinations_of(F.col("tokens"), max_size)).alias("combination"))
    fresh = made.groupBy("combination").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("fresh"))
    both = read.join(fresh, "batch", "left").select("batch", F.col("n") if exact_total else F.lit(batch).cast("bigint").alias("n"), F.coalesce("fresh", F.lit(0)).cast("bigint").alias("fresh"))
    summed = running_sum(running_sum(both, "n", "batch", name="sequences"), "fresh", "batch", name="combinations")
    return summed.select("batch", "sequences", "combinations")
