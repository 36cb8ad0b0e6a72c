"""JSON, CSV and text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkmill.functions import files as P
from hunkmill.functions import tokens as T

SIDE = "struct<hash:string,committer:string,subject:string,commit_message:string>"
DIFFS = f"change_id string, branch string, file_name string, merged_at timestamp_ntz, diff_hunk struct<condition:array<string>,consequent:array<string>>, base {SIDE}, target {SIDE}"
PATTERNS = "pattern array<string>, support bigint"


def read_array(spark: SparkSession, path: str | list[str], schema: str | None = None, strict: bool = False) -> DataFrame:
    """Files that each hold one JSON array (or one object): read whole, one task a file. Large data should be JSON lines (``read_lines``)."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str | list[str], schema: str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines, in splits of any file: the form for incremental reading."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_diffs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Typed diff rows; a file that is missing or does not fit the schema fails the query."""
    return read_array(spark, path, DIFFS, strict=True)


def read_patterns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_array(spark, path, PATTERNS).select("pattern", "support")


def _existing(spark: SparkSession, pattern: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(conf).globStatus(where)
    return [str(s.getPath()) for s in found] if found else []


def read_period(spark: SparkSession, root: str, owner: str, repo: str, period: str, schema: str = PATTERNS) -> DataFrame:
    """The rows of one owner, repository and period; a missing file has no rows."""
    paths = _existing(spark, f"{root}/{owner}/{period}/{repo}.json")
    return read_array(spark, paths, schema) if paths else spark.createDataFrame([], schema)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name) of the entries of a folder; none if it cannot be read."""
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in _existing(spark, f"{folder}/*")], "file_name string")


def count_rows(spark: SparkSession, path: str) -> int:
    return read_array(spark, path).count()


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, line) of all lines of the files below ``root`` whose names match ``glob``."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", *partitions: str) -> None:
    """JSON lines under ``path``; ``mode="append"`` writes only the new rows, where the reference rewrites the file."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def append_diffs(diffs: DataFrame, path: str, owner: str) -> None:
    """Diff rows appended under owner and year of the merge."""
    period = P.period_of(F.col("merged_at"))
    write_json(diffs.withColumn("owner", F.lit(owner)).withColumn("period", period), path, "append", "owner", "period")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; array columns, which CSV cannot hold, are written as rendered patterns."""

    def plain(name: str, kind: str) -> Column:
        return T.rendered(F.col(name)).alias(name) if kind == "array<string>" else F.col(name)

    whole = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*[plain(c, k) for c, k in df.dtypes]).write.mode(mode).options(**whole).csv(path)
