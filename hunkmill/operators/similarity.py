"""How much two projects share: patterns, developers, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.plans.lineage import cut
from hunkmill.plans.order import indexed


def author_counts(rows: DataFrame, project: str = "project", author: str = "author") -> DataFrame:
    """(project, author, n): rows a project and author; rows without an author are left out."""
    kept = rows.filter(F.col(author).isNotNull())
    return kept.groupBy(F.col(project).alias("project"), F.col(author).alias("author")).agg(F.count(F.lit(1)).alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    """(project, developers, commits) of ``author_counts``."""
    return counts.groupBy("project").agg(F.count(F.lit(1)).alias("developers"), F.sum("n").alias("commits"))


def _numbered(projects: DataFrame) -> DataFrame:
    return cut(indexed(projects.filter("project is not null"), "project", name="k").select("project", F.col("k").cast("int").alias("k")))


def _all_pairs(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """Every two projects once, the smaller first. Each project names its partners by number, so this is an equi-join as large as its result."""
    n = numbered.count()
    left = numbered.select("k", *[F.col(c).alias(f"{c}_a") for c in columns])
    left = left.filter(F.col("k") < n - 1).withColumn("j", F.explode(F.sequence(F.col("k") + 1, F.lit(n - 1))))
    right = numbered.select(F.col("k").alias("j"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, "j").withColumnRenamed("j", "kb").withColumnRenamed("k", "ka")


def _shared(counts: DataFrame, numbered: DataFrame) -> DataFrame:
    """(ka, kb, shared, dot): of each two projects with a common author, the number of those and the sum of products of their counts.

    Authors with the very same projects and counts become one weighted row before pairs are made, so bots and idle accounts cost one row a
    kind; an author then gives pairs of projects, never pairs of authors.
    """
    rows = counts.join(numbered, "project").groupBy("author").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("held"))
    kinds = rows.filter(F.size("held") > 1).groupBy("held").agg(F.count(F.lit(1)).alias("w"))
    one = kinds.select("w", "held", F.posexplode("held").alias("at", "a"))
    two = one.filter(F.col("at") < F.size("held") - 1).select("w", "a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"))
    return two.groupBy(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).agg(
        F.sum("w").alias("shared"), F.sum(F.col("w") * F.col("a.n") * F.col("b.n")).alias("dot")
    )


def developer_overlap(counts: DataFrame) -> DataFrame:
    """(project_a, project_b, shared, either, jaccard) of every two projects, project_a the smaller; unrounded, 0.0 where both are empty.

    ``counts`` is as from ``author_counts``. The full matrix is symmetric, with 0 on the diagonal in the reference's files.
    """
    sizes = counts.groupBy("project").agg(F.count(F.lit(1)).alias("size"))
    numbered = _numbered(sizes.select("project"))
    pairs = _all_pairs(numbered.join(sizes, "project"), ["project", "size"])
    full = pairs.join(_shared(counts, numbered), ["ka", "kb"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
    full = full.withColumn("either", F.col("size_a") + F.col("size_b") - F.col("shared"))
    return full.select("project_a", "project_b", "shared", "either", F.coalesce(F.try_divide("shared", "either"), F.lit(0.0)).alias("jaccard"))


def commit_cosine(counts: DataFrame) -> DataFrame:
    """(project_a, project_b, dot, cosine) of the vectors of commits by author of every two projects; 0.0 for no common author."""
    norms = counts.groupBy("project").agg(F.sum(F.col("n") * F.col("n")).alias("square"))
    numbered = _numbered(norms.select("project"))
    pairs = _all_pairs(numbered.join(norms, "project"), ["project", "square"])
    full = pairs.join(_shared(counts, numbered), ["ka", "kb"], "left").withColumn("dot", F.coalesce("dot", F.lit(0)).cast("bigint"))
    bottom = F.sqrt(F.col("square_a").cast("double")) * F.sqrt(F.col("square_b").cast("double"))
    return full.select("project_a", "project_b", "dot", F.coalesce(F.try_divide(F.col("dot").cast("double"), bottom), F.lit(0.0)).alias("cosine"))


def matrix(pairs: DataFrame, value: str) -> DataFrame:
    """The pairs as a symmetric table, one row and one column a project, 0.0 on the diagonal: what the reference writes as CSV."""
    both = pairs.select("project_a", "project_b", value).union(pairs.select("project_b", "project_a", value))
    wide = both.groupBy(F.col("project_a").alias("project")).pivot("project_b").agg(F.first(value))
    return wide.na.fill(0.0).orderBy("project")


def pattern_overlap(first: DataFrame, second: DataFrame, min_a: int = 0, min_b: int = 0) -> DataFrame:
    """(shared, either, jaccard) of the distinct patterns of two tables with at least the given supports; 0.0 if there are none."""
    grid = _support_cells(first, second)
    a, b = F.coalesce(F.col("a") >= min_a, F.lit(False)), F.coalesce(F.col("b") >= min_b, F.lit(False))
    sums = grid.agg(F.count_if(a & b).alias("shared"), F.count_if(a | b).alias("either"))
    return sums.withColumn("jaccard", F.coalesce(F.try_divide("shared", "either"), F.lit(0.0)))


def _support_cells(first: DataFrame, second: DataFrame) -> DataFrame:
    one = first.filter("pattern is not null").groupBy("pattern").agg(F.max("support").alias("a"))
    two = second.filter("pattern is not null").groupBy("pattern").agg(F.max("support").alias("b"))
    return one.join(two, "pattern", "full")


def overlap_grid(first: DataFrame, second: DataFrame, thresholds: range = range(2, 21, 2)) -> DataFrame:
    """(min_a, min_b, shared, either, jaccard) for every two thresholds, from one pass.

    Each pattern falls into one cell by the number of thresholds that its two supports reach; only the counts of those (at most
    (len(thresholds) + 1) squared) cells meet the grid.
    """
    steps = list(thresholds)
    cells = _support_cells(first, second)
    reach = lambda c: sum((F.coalesce(F.col(c) >= t, F.lit(False)).cast("int") for t in steps[1:]), F.coalesce(F.col(c) >= steps[0], F.lit(False)).cast("int"))
    few = cells.select(reach("a").alias("ra"), reach("b").alias("rb")).groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(len(steps)) for j in range(len(steps))]))
    met = few.select("ra", "rb", "n", grid.alias("g"))
    a, b = F.col("ra") > F.col("g.i"), F.col("rb") > F.col("g.j")
    sums = met.groupBy("g").agg(F.coalesce(F.sum(F.when(a & b, F.col("n"))), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.when(a | b, F.col("n"))), F.lit(0)).alias("either"))
    at = F.array(*[F.lit(t) for t in steps])
    return sums.select(
        F.get(at, F.col("g.i")).cast("bigint").alias("min_a"), F.get(at, F.col("g.j")).cast("bigint").alias("min_b"), "shared", "either",
        F.coalesce(F.try_divide("shared", "either"), F.lit(0.0)).alias("jaccard"),
    )
