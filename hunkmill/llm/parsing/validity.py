"""Which stored files do not parse in the language of their extension, and the rates of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.llm.parsing.languages import EXTENSIONS, first_error

_COLUMNS = "blob_id bigint, file_id bigint, language string, broken boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        broken = [first_error(x, body) is not None for x, body in zip(b.column("language").to_pylist(), b.column("body").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("blob_id"), b.column("file_id"), b.column("language"), pa.array(broken, pa.bool_())], ["blob_id", "file_id", "language", "broken"])


def parsed(sources: DataFrame) -> DataFrame:
    """(blob_id, file_id, language, broken) of every file with a known extension and a body that is neither null nor empty, read whole."""
    ending = F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1))
    language = F.coalesce(*[F.when(ending == e, F.lit(name)) for e, name in EXTENSIONS.items()])
    rows = sources.select("blob_id", "file_id", language.alias("language"), "body").filter("language is not null and body is not null and body != ''")
    return rows.mapInArrow(_parse, _COLUMNS)


def unparsable(sources: DataFrame) -> DataFrame:
    """(blob_id) of the files whose body does not parse in the language of their extension."""
    return parsed(sources).filter("broken").select("blob_id")


def rates(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(project, language, files, broken, rate): a file whose project is null or unknown counts under a null project."""
    counted = parsed(sources).join(files.select(F.col("id").alias("file_id"), "project"), "file_id", "left").groupBy("project", "language")
    return counted.agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken")).withColumn("rate", F.col("broken") / F.col("files"))
