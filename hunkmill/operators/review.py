"""The review model: changes, their revisions and files, the metadata of the two sides, and the hunks between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIDE = ("hash", "committer", "subject", "commit_message")


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row a change: the one fetched last (repeated fetches of a change fall away). Rows without a change_id are left out."""
    rest = [c for c in changes.columns if c != "change_id"]
    newest = changes.filter("change_id is not null").groupBy("change_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("fetched_at"), F.xxhash64(*rest))).alias("r"))
    return newest.select("change_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def revision_pairs(changes: DataFrame, min_revisions: int = 2) -> DataFrame:
    """(change_id, project, branch, merged_at, file_name, revisions, base, target): each file of a change with its first and last revision.

    ``revisions`` are taken in the order they are stored; a file counts if at least ``min_revisions`` of them name it. base and target hold hash,
    committer, subject and commit_message. Null revisions, null lists and null file names give nothing; a file named twice by a revision
    counts once.
    """
    keys = ["change_id", "project", "branch", "merged_at"]
    at = changes.select(*keys, F.posexplode("revisions").alias("at", "r")).filter("r is not null")
    files = at.select(*keys, "at", F.struct(*[F.col(f"r.{c}").alias(c) for c in _SIDE]).alias("side"), F.explode(F.array_distinct("r.changed_files")).alias("file_name"))
    pairs = files.filter("file_name is not null").groupBy(*keys, "file_name")
    ends = pairs.agg(F.count(F.lit(1)).alias("revisions"), F.min_by("side", "at").alias("base"), F.max_by("side", "at").alias("target"))
    return ends.filter(F.col("revisions") >= min_revisions)


def with_sides(files: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """Each file with its two sides as structs (null where a side is missing); a 1:1 relation by file_id, so the joins add no rows."""

    def side(meta: DataFrame, name: str) -> DataFrame:
        return meta.select(F.col("file_id").alias("id"), F.struct(*_SIDE, "file_path").alias(name))

    return files.join(side(base, "base"), "id", "left").join(side(target, "target"), "id", "left")


def by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(F.col("id") == file_id)


def by_change(files: DataFrame, change_id: str) -> DataFrame:
    """The filter reaches the Parquet scan, in place of the reference's index."""
    return files.filter(F.col("change_id") == change_id)


def page(files: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` by id; the reference gives no order, so its pages are not defined."""
    return files.orderBy("id").offset(skip).limit(limit)


def updated(files: DataFrame, file_id: int, **values) -> DataFrame:
    """``files`` with the given values in the row ``file_id``; names that are no columns are ignored."""
    known = {k: F.when(F.col("id") == file_id, F.lit(v).cast(files.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items() if k in files.columns}
    return files.withColumns(known) if known else files


def deleted(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(~F.col("id").eqNullSafe(F.lit(file_id)))


def inserted(files: DataFrame, base: DataFrame, target: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables with the rows of ``rows`` (file columns, base and target structs) added; ids of metadata are those of the file."""

    def meta(name: str, like: DataFrame) -> DataFrame:
        return like.unionByName(rows.select("id", F.col("id").alias("file_id"), *[F.col(f"{name}.{c}").alias(c) for c in (*_SIDE, "file_path")]))

    return files.unionByName(rows.select(*files.columns)), meta("base", base), meta("target", target)


def merged_pulls(pulls: DataFrame, start: str, end: str) -> DataFrame:
    """Merged pull requests updated between the two dates, both included."""
    return pulls.filter(F.col("merged_at").isNotNull() & F.to_date("updated_at").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def pull_revisions(commits: DataFrame) -> DataFrame:
    """(pr_number, file_name, revisions, base_hash, base_message, target_hash, target_message, merged_date): first and last commit a file, if it has two.

    ``commits`` has one row a pull request, commit position and file.
    """
    side = F.struct("hash", "message")
    ends = commits.filter("file_name is not null").groupBy("pr_number", "file_name", "merged_date")
    ends = ends.agg(F.count_distinct("position").alias("revisions"), F.min_by(side, "position").alias("b"), F.max_by(side, "position").alias("t")).filter("revisions >= 2")
    return ends.select(
        "pr_number", "file_name", "revisions", F.col("b.hash").alias("base_hash"), F.col("b.message").alias("base_message"), F.col("t.hash").alias("target_hash"), F.col("t.message").alias("target_message"), "merged_date"
    )


def catalog(repositories: DataFrame, language: str = "Python") -> DataFrame:
    """(name, commits) of the repositories whose languages hold ``language``; commits is the page number of the last link of the answer's header
    when pages hold one commit, 1 where there is no such link."""
    last = F.regexp_extract("link", r'[?&]page=(\d+)[^>]*>;\s*rel="last"', 1).try_cast("bigint")
    return repositories.filter(F.array_contains("languages", language)).select("name", F.coalesce(last, F.lit(1).cast("bigint")).alias("commits"))


def typed_hunks(hunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hunks (change_id, file_name, diff_hunk) with the first and last revision of their file: the rows of ``diffs``."""
    return hunks.join(pairs.select("change_id", "branch", "file_name", "merged_at", "base", "target"), ["change_id", "file_name"]).select(
        "change_id", "branch", "file_name", "merged_at", "diff_hunk", "base", "target"
    )
