"""Sub-patterns of one hunk and the triggers they stand for: an older, counting way to patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T


def anchored_subsequences(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(pattern): for each sequence, all subsequences that keep its first token, have two tokens or more and at least one ``-`` or ``+``.

    One row a choice of places, in JVM code; a sequence of n tokens gives 2**(n-1) - 1 at most, so it is for short sequences (runs merged).
    """
    seq = F.col("_seq")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    choices = bit(F.size(seq) - 1) - 1
    rows = sequences.select(F.col(tokens).alias("_seq")).filter(F.size("_seq") > 1).select("_seq", F.explode(F.sequence(F.lit(1).cast("bigint"), choices)).alias("_mask"))
    chosen = F.filter(seq, lambda x, i: (i == 0) | (F.col("_mask").bitwiseAND(bit(F.greatest(i - 1, F.lit(0)))) != 0))
    return rows.select(chosen.alias("pattern")).filter(T.changes(F.col("pattern")))


def counted(patterns: DataFrame) -> DataFrame:
    """(pattern, n bigint)."""
    return patterns.filter("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def added(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of counts as one."""
    return one.select("pattern", "n").unionByName(other.select("pattern", "n")).groupBy("pattern").agg(F.sum("n").alias("n"))


def trigger_of(pattern: Column) -> Column:
    """The pattern without its new tokens: what a hunk must hold before the change."""
    return F.filter(pattern, lambda t: ~F.startswith(F.coalesce(t, F.lit("")), F.lit("+")))


def confident(patterns: DataFrame, triggerable: DataFrame, changed: DataFrame, threshold: float = 0.1, min_count: int = 2) -> DataFrame:
    """Patterns with at least ``min_count`` occurrences whose changes, as a share of the places where their trigger stands, reach ``threshold``.

    ``patterns``, ``triggerable`` (by trigger) and ``changed`` (by pattern) hold (pattern, n). A pattern whose trigger was never seen is left out.
    """
    rows = patterns.filter(F.col("n") >= min_count).withColumn("trigger", trigger_of(F.col("pattern")))
    rows = rows.join(triggerable.select(F.col("pattern").alias("trigger"), F.col("n").alias("places")), "trigger")
    rows = rows.join(changed.select("pattern", F.col("n").alias("done")), "pattern")
    return rows.filter(F.try_divide("done", "places") >= threshold).select("pattern", "n")


def repeated_changes(sequences: DataFrame, tokens: str = "tokens", min_count: int = 2) -> DataFrame:
    """(pattern, n): merged token sequences that occur ``min_count`` times or more and change something."""
    merged = sequences.select(T.merge_runs(F.col(tokens)).alias("pattern")).filter(T.changes(F.col("pattern")))
    return counted(merged).filter(F.col("n") >= min_count)


def without_placeholders(code: Column) -> Column:
    """``${0:NAME}`` as ``NAME``."""
    return F.regexp_replace(code, r"\$\{\d+:(\w+)\}", "$1")


def line_pairs(rows: DataFrame, condition: str = "condition", consequent: str = "consequent") -> DataFrame:
    """(before, after): the lines of both sides that stand at the same place; a side with fewer lines gives nulls."""
    zipped = F.arrays_zip(F.col(condition).alias("before"), F.col(consequent).alias("after"))
    return rows.select(F.explode(zipped).alias("p")).select("p.before", "p.after")


def parsed_key(text: Column) -> Column:
    """The tokens of a written tuple such as ``('=a', '-b')``; quotes that do not close stay in part."""
    inner = F.regexp_replace(text, r"^\(|\)$", "")
    return F.transform(F.split(inner, ", "), lambda t: F.regexp_replace(t, "^'+|'+$", ""))


def triggers_of_keys(counts: DataFrame, key: str = "key") -> DataFrame:
    """(trigger): the distinct triggers of patterns that are kept under written tuples."""
    return counts.select(trigger_of(parsed_key(F.col(key))).alias("trigger")).filter("trigger is not null").distinct()
