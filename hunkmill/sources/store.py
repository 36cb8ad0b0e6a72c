"""The review tables (files, base_metadata, target_metadata) kept as Parquet folders.

Plain files have no transactions: an insert is three appends, and an update or a delete writes a new version of the table and then swaps the
name of the current version. A table format with MERGE would do the same in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hunkmill.operators import review

TABLES = {
    "files": "id bigint, change_id string, branch string, file_name string, merged_at timestamp_ntz, project string",
    "base_metadata": "id bigint, file_id bigint, hash string, committer string, subject string, commit_message string, file_path string",
    "target_metadata": "id bigint, file_id bigint, hash string, committer string, subject string, commit_message string, file_path string",
}


class ReviewStore:
    """``root`` holds ``<table>/v<n>`` folders; the highest complete one is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        for name in TABLES:
            if self._version(name) is None:
                self.spark.createDataFrame([], TABLES[name]).write.parquet(f"{root}/{name}/v0")

    def _version(self, name: str) -> int | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v*/_SUCCESS")
        found = where.getFileSystem(conf).globStatus(where)
        return max((int(s.getPath().getParent().getName()[1:]) for s in found or []), default=None)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{self._version(name)}")

    def register(self) -> None:
        """Temporary views of the three tables, for SQL."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    def insert(self, rows: DataFrame) -> None:
        """``rows``: the columns of files, and ``base`` and ``target`` structs."""
        new = review.inserted(*(self.spark.createDataFrame([], TABLES[n]) for n in TABLES), rows)
        for name, df in zip(TABLES, new, strict=True):
            df.write.mode("append").parquet(f"{self.root}/{name}/v{self._version(name)}")

    def get(self, file_id: int) -> DataFrame:
        return review.by_id(self.table("files"), file_id)

    def of_change(self, change_id: str) -> DataFrame:
        return review.by_change(self.table("files"), change_id)

    def page(self, skip: int = 0, limit: int = 100) -> DataFrame:
        return review.page(self.table("files"), skip, limit)

    def _replace(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}/v{(self._version(name) or 0) + 1}")

    def update(self, file_id: int, **values) -> DataFrame | None:
        """The changed row; None if there is no such file."""
        if self.get(file_id).isEmpty():
            return None
        self._replace("files", review.updated(self.table("files"), file_id, **values))
        return self.get(file_id)

    def delete(self, file_id: int) -> bool:
        if self.get(file_id).isEmpty():
            return False
        self._replace("files", review.deleted(self.table("files"), file_id))
        for name in ("base_metadata", "target_metadata"):
            self._replace(name, self.table(name).filter(f"file_id <> {int(file_id)} or file_id is null"))
        return True
