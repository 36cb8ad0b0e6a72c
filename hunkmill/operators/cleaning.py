"""Cutting raw review rows to a period and into training and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.functions.files import day_of
from hunkmill.plans.order import indexed

_LINES = "array<string>"


def oldest(rows: DataFrame, project: str = "project", created: str = "created_at") -> DataFrame:
    """(project, oldest date): null where no row of the project has a readable date."""
    return rows.groupBy(F.col(project).alias("project")).agg(F.min(day_of(F.col(created))).alias("oldest"))


def _trained(rows: DataFrame, *more: Column | str) -> DataFrame:
    """author, condition and consequent with '' and empty lists for what is missing."""
    empty = F.array().cast(_LINES)
    return rows.select(*more, F.coalesce("author", F.lit("")).alias("author"), F.coalesce("condition", empty).alias("condition"), F.coalesce("consequent", empty).alias("consequent"))


def term(rows: DataFrame, start: str, end: str, created: str = "created_at", more: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose date lies between ``start`` and ``end``, both included, cut to (*more, author, condition, consequent, created_at)."""
    day = day_of(F.col(created))
    inside = rows.filter(day.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return _trained(inside, *more, F.coalesce(F.col(created), F.lit("")).alias("created_at"))


def eligible(rows: DataFrame, start: str, end: str, project: str = "project", created: str = "created_at") -> DataFrame:
    """(project) that are older than ``start`` and have a row between ``start`` and ``end``; one pass, sums made before the shuffle."""
    day = day_of(F.col(created))
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    seen = rows.groupBy(F.col(project).alias("project")).agg(F.min(day).alias("oldest"), F.count_if(day.between(low, high)).alias("n"))
    return seen.filter((F.col("oldest") < low) & (F.col("n") > 0)).select("project")


def split(rows: DataFrame, *order: Column | str, project: str = "project", test_share: float = 0.2, more: tuple[str, ...] = ()) -> DataFrame:
    """(project, *more, author, condition, consequent, part): in each project the first int(n * share) rows in ``order`` are ``test``, the others ``train``.

    Positions come from one range sort by project and order, so a project of any size is spread over tasks.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = indexed(rows, F.col(project), *cols, name="_at")
    sizes = placed.groupBy(F.col(project).alias("_project")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, F.col(project).eqNullSafe(F.col("_project")))
    tested = (F.col("_at") - F.col("_first")) < F.floor(F.col("_n") * F.lit(test_share))
    return _trained(joined, F.col(project).alias("project"), *more, F.when(tested, "test").otherwise("train").alias("part"))
