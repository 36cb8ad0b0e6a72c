"""Operators over tables of mined patterns: (pattern array<string>, support bigint)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T
from hunkmill.plans.lineage import cut
from hunkmill.plans.order import indexed, running_sum


def merge(patterns: DataFrame) -> DataFrame:
    """One row a pattern with its supports added up; null supports count as nothing, null patterns are left out."""
    return patterns.filter("pattern is not null").groupBy("pattern").agg(F.coalesce(F.sum("support"), F.lit(0)).cast("bigint").alias("support"))


def by_support(patterns: DataFrame) -> DataFrame:
    """Ordered by support, the highest first, ties by pattern; a range sort, so that writing keeps the order across files."""
    return patterns.orderBy(F.desc("support"), "pattern")


def at_least(patterns: DataFrame, min_support: int) -> DataFrame:
    return patterns.filter(F.col("support") >= min_support)


def maximal(patterns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Patterns that are no subsequence of a longer pattern of the same group; of equal patterns the one with the highest support stays.

    A longer pattern that contains p contains every ordered pair of neighbours of p. So p is looked up by its rarest such pair among all
    ordered pairs of the longer patterns (a pattern of n tokens has n(n-1)/2 at most), and only what meets there is compared token by token.
    Single tokens are looked up by themselves; the empty pattern falls away if any other stands beside it. Pair counts use map-side sums; a
    hot pair is split by Spark's skew join, as the anti join streams its left side. Null patterns are left out.
    """
    group = list(by)
    unique = cut(patterns.filter("pattern is not null").groupBy(*group, "pattern").agg(F.max("support").alias("support")))
    seq, n = F.col("pattern"), F.size("pattern")
    long = unique.filter(n >= 2)
    pairs_of = F.array_distinct(
        F.flatten(
            F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(seq, i + 1, n - i), lambda b: F.array(F.get(seq, i - 1), b)))
        )
    )
    held = long.select(*group, seq.alias("whole"), F.explode(pairs_of).alias("key"))
    counts = held.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n"))
    own = long.select(*group, "pattern", "support", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.slice(seq, i, 2)))).alias("key"))
    best = own.join(counts, [*group, "key"]).groupBy(*group, "pattern", "support").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    other = held.select(*[F.col(g).alias(f"_{g}") for g in group], "whole", F.col("key").alias("_key"))
    on = (F.col("key") == F.col("_key")) & (F.size("whole") > F.size("pattern")) & T.is_subsequence(F.col("pattern"), F.col("whole"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    kept = best.join(other, on, "left_anti").select(*group, "pattern", "support")
    covered = long.select(*group, F.explode(F.array_distinct("pattern")).alias("one")).distinct()
    single = unique.filter(n == 1).withColumn("one", F.get("pattern", F.lit(0)))
    kept = kept.unionByName(single.join(covered, [*group, "one"], "left_anti").select(*group, "pattern", "support"))
    some = unique.filter(n > 0).select(*group).distinct() if group else unique.filter(n > 0).select(F.lit(1).alias("_any")).limit(1)
    empty = unique.filter(n == 0)
    if group:
        kept = kept.unionByName(empty.join(some, group, "left_anti"))
    elif not some.take(1):
        kept = kept.unionByName(empty)
    return kept


def filter_patterns(patterns: DataFrame, scope: str = "period_then_global", period: str = "period") -> dict[str, DataFrame]:
    """The filter stage over patterns of several periods: ``merged``, ``maximal``, ``structural`` and ``changing``.

    ``period_then_global`` drops contained patterns within each period before supports are added up, as the reference does, which lowers
    supports; ``global`` drops them only afterwards. ``structural`` are the maximal ones that are not symbols only and have paired brackets;
    ``changing`` are the maximal ones with a gone and a new token (not a part of ``structural``).
    """
    if scope not in ("period_then_global", "global"):
        raise ValueError(scope)
    rows = patterns.withColumnRenamed(period, "period")
    start = maximal(rows, ("period",)) if scope == "period_then_global" else rows
    merged = cut(merge(start))
    top = cut(maximal(merged))
    return {
        "merged": merged,
        "maximal": top,
        "structural": structural(top),
        "changing": top.filter(T.removes_and_adds(F.col("pattern"))),
    }


def structural(patterns: DataFrame) -> DataFrame:
    return patterns.filter(~T.all_symbols(F.col("pattern")) & T.brackets_paired(F.col("pattern")))


def loss_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(merged, contained, malformed bigint): how many patterns merging left, and how many each of the two later filters dropped.

    The reference gives only the sum of the two as its number of structural errors; here they are apart.
    """
    n = [stages[k].agg(F.count(F.lit(1)).alias(k)) for k in ("merged", "maximal", "structural")]
    one = n[0].withColumn("_k", F.lit(1)).join(n[1].withColumn("_k", F.lit(1)), "_k").join(n[2].withColumn("_k", F.lit(1)), "_k")
    return one.select("merged", (F.col("merged") - F.col("maximal")).alias("contained"), (F.col("maximal") - F.col("structural")).alias("malformed"))


def ranked(patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``rank``: 1 + the number of rows with a higher support (1, 1, 3, ...); null supports rank last.

    Ranks are made on the counts by support and joined back, so no task sees all patterns; a support that most patterns share is one row on
    the other side of the join.
    """
    key = F.coalesce("support", F.lit(-(2**63)))
    rows = patterns.withColumn("_key", key)
    counts = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sum(counts, "_n", F.desc("_key"), name="_upto").select("_key", (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return rows.join(upto, "_key").drop("_key")


def rank_of(patterns: DataFrame, pattern: list[str]) -> DataFrame:
    """(rank, support) of one pattern; no row if it is absent."""
    wanted = F.array(*[F.lit(t) for t in pattern]) if pattern else F.array().cast("array<string>")
    return ranked(patterns).filter(F.col("pattern") == wanted).select("rank", "support")


def length_histogram(patterns: DataFrame) -> DataFrame:
    """(length, n): number of patterns by their number of tokens; null patterns are left out."""
    return patterns.filter("pattern is not null").groupBy(F.size("pattern").cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def sequence_counts(sequences: DataFrame, period: str = "period", tokens: str = "tokens") -> DataFrame:
    """(period, total, all_symbols, unpaired) per period and, with a null period and ``is_total`` 1, over all of them."""
    flags = sequences.select(
        F.col(period).alias("period"), T.all_symbols(F.col(tokens)).alias("s"), (~T.brackets_paired(F.col(tokens))).alias("u")
    ).filter(F.col("s").isNotNull())
    return flags.rollup("period").agg(
        F.grouping("period").cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count_if("s").alias("all_symbols"), F.count_if("u").alias("unpaired")
    )


def first_rows(tables: dict[str, DataFrame], n: int = 100) -> DataFrame:
    """(source, place, pattern text, support): the first ``n`` patterns of each table by support, one below the other."""
    out = None
    for name, df in tables.items():
        top = df.orderBy(F.desc_nulls_last("support"), "pattern").limit(n)
        rows = indexed(top, F.desc_nulls_last("support"), "pattern", name="place").select(
            F.lit(name).alias("source"), F.col("place") + 1, T.rendered(F.col("pattern")).alias("pattern"), "support"
        )
        rows = rows.toDF("source", "place", "pattern", "support")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no table")
    return out
