"""Frequent ordered patterns by prefix projection, with the length gate of the reference, and token combinations.

The measure: at each prefix, a suffix counts for its distinct items only while it is at most ``cap`` tokens long, but it is projected
whatever its length. So a pattern may have more support than its prefix, and is reported only if every prefix is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T
from hunkmill.plans.lineage import cut
from hunkmill.plans.order import indexed


def prefix_patterns(
    sequences: DataFrame, tokens: str = "tokens", min_support: int = 10, cap: int | None = 15, max_len: int | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """(*by, pattern array<string>, support bigint) of all patterns with at least ``min_support`` sequences, per group of the ``by`` columns.

    Level by level: (group, prefix, item) is counted with map-side sums, and each suffix is cut behind the first place of each frequent item.
    Before that, equal sequences become one weighted row, and items that stand in fewer than ``min_support`` sequences leave; each kept
    item carries the number of tokens behind it, so the gate still sees the full length. ``cap=None`` switches the gate off.

    The work grows with the number of patterns; ``max_len`` bounds their length (None: no bound). Joins are on (group, prefix, item), so no
    key holds all rows; Spark broadcasts a level's patterns only below its own size threshold. Each level is written to the checkpoint
    folder. Null and empty sequences and null tokens give nothing; repeated rows count each; an empty table gives no row.
    """
    if min_support < 1:
        raise ValueError("min_support must be a positive integer")
    group = list(by)
    clean = sequences.select(*group, F.filter(tokens, lambda t: t.isNotNull()).alias("tokens")).filter(F.size("tokens") > 0)
    merged = clean.groupBy(*group, "tokens").agg(F.count(F.lit(1)).alias("w"))
    merged = cut(merged.withColumn("sid", F.monotonically_increasing_id()))
    at = merged.select("sid", *group, "w", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    present = merged.select(*group, "w", F.explode(F.array_distinct("tokens")).alias("token"))
    often = present.groupBy(*group, "token").agg(F.sum("w").alias("n")).filter(F.col("n") >= min_support)
    numbers = cut(indexed(often.select("token").distinct(), "token", name="id").select("token", F.col("id").cast("int").alias("id")))
    often = cut(often.join(numbers, "token").select(*group, "token", "id"))
    kept = _join(at, often, [*group, "token"])
    state = (
        kept.groupBy("sid", *group, "w", "n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("at"))
        .select(
            *group, F.array().cast("array<int>").alias("prefix"), F.col("n").alias("left"), "w",
            F.transform("at", lambda x: F.struct(x["id"].alias("id"), (F.col("n") - x["pos"] - 1).alias("behind"))).alias("items"),
        )
    )
    found: list[DataFrame] = []
    level = 0
    while max_len is None or level < max_len:
        level += 1
        state = cut(state)
        counted = state if cap is None else state.filter(F.col("left") <= cap)
        counted = counted.select(*group, "prefix", "w", F.explode(F.array_distinct(F.col("items")["id"])).alias("id"))
        frequent = cut(counted.groupBy(*group, "prefix", "id").agg(F.sum("w").alias("support")).filter(F.col("support") >= min_support))
        if frequent.isEmpty():
            break
        found.append(frequent)
        ids = F.col("items")["id"]
        steps = state.select(*group, "prefix", "w", "items", F.explode(F.array_distinct(ids)).alias("id"))
        steps = _join(steps, frequent.drop("support"), [*group, "prefix", "id"])
        place = F.array_position(ids, F.col("id")).cast("int")
        state = steps.select(
            *group, F.array_append("prefix", F.col("id")).alias("prefix"), F.get("items", place - 1)["behind"].alias("left"), "w",
            F.slice("items", place + 1, F.greatest(F.size("items") - place, F.lit(0))).alias("items"),
        ).filter(F.size("items") > 0)
    if not found:
        kinds = dict(sequences.dtypes)
        return sequences.sparkSession.createDataFrame([], ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "pattern array<string>", "support bigint"]))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    coded = union.select(*group, F.array_append("prefix", F.col("id")).alias("ids"), "support")
    named = coded.select(*group, "ids", "support", F.posexplode("ids").alias("pos", "id")).join(numbers, "id")
    named = named.groupBy(*group, "ids", "support").agg(F.sort_array(F.collect_list(F.struct("pos", "token")))["token"].alias("pattern"))
    return named.select(*group, "pattern", "support")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join where null keys (a null group) meet; the right side's other columns come along."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_{k}" for k in keys])


def mine_periods(sequences: DataFrame, period: str = "period", min_support: int = 10, cap: int = 15, max_len: int | None = None, prefilter: bool = False) -> DataFrame:
    """(period, pattern, support): each period mined on its own with the same support; only changing patterns of two tokens or more stay.

    ``prefilter`` leaves out sequences of symbols only and sequences with unpaired brackets; the reference computes that filter and then
    mines everything, so it is off by default.
    """
    rows = sequences
    if prefilter:
        rows = rows.filter(~T.all_symbols(F.col("tokens")) & T.brackets_paired(F.col("tokens")))
    found = prefix_patterns(rows.withColumnRenamed(period, "period"), "tokens", min_support, cap, max_len, ("period",))
    return found.filter(T.changes(F.col("pattern")))


def combinations_of(tokens: Column, max_size: int = 10) -> Column:
    """All combinations of 2 to min(n, ``max_size``) places of ``tokens``, order kept, as an array of arrays.

    The number grows as n to the power ``max_size``; the caller bounds one of them. Equal tokens at different places give equal results.
    """
    n = F.size(tokens)
    level = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(i))
    level = F.when(n > 0, level).otherwise(F.array().cast("array<array<int>>"))
    out = F.array().cast("array<array<int>>")
    for _ in range(2, max_size + 1):
        can = F.filter(level, lambda c: F.element_at(c, -1) < n - 1)
        level = F.flatten(F.transform(can, lambda c: F.transform(F.sequence(F.element_at(c, -1) + 1, n - 1), lambda j: F.array_append(c, j))))
        out = F.concat(out, level)
    return F.transform(out, lambda c: F.transform(c, lambda i: F.get(tokens, i)))
