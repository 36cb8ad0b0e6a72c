"""Nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns with clashing names."""

import time

import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import bpe, copies, leaks, mining, names, produced, queries, reading
from hunkmill.llm.parsing import validity


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


SOURCES = "blob_id bigint, file_id bigint, side string, file_path string, body string, n_bytes bigint, language string, broken string, path string"
AT = "blobs/x/2020to2021/ab/target/"


def test_files(spark):
    deep = "x = " + "(" * 150 + "1" + ")" * 150 + "\n"
    rows = [
        (1, None, None, None, None, None), (2, 1, None, AT + "a.py", "", 0), (3, 1, None, AT + "a.py", "x = 1\n" * 60_000, 0), (4, None, None, AT + "a.py", "x = (\n", 0), (4, None, None, AT + "a.py", "x = (\n", 0),
        (5, 7, None, AT + "a.json", "[" * 2_000 + "]" * 2_000, 0), (6, 7, None, AT + "B.JAVA", "class {", 0), (None, 7, None, AT + "a.js", "let = = 1", 0), (7, 1, None, AT + "a.py", deep, 0), (8, 1, None, "no_extension", "(", 0),
        (9, 1, None, AT + "a.js", "/*" + "x" * 300_000, 0), (10, 1, None, AT + "a.py", "'''" + "y" * 300_000, 0), (11, 1, None, AT + "\x00.py", "\x00", 0), (12, 1, None, AT + "a.py", "# " + "generated " * 30_000, 0),
    ]
    df = spark.createDataFrame([(*r, "java", "no", "vendor/") for r in rows], SOURCES)
    began = time.time()
    got = sorted(str(r[0]) for r in validity.unparsable(df).collect())
    assert got == sorted(["4", "4", "6", "None", "9", "10", "11"])
    assert time.time() - began < 60
    files = spark.createDataFrame([(1, "o/p", 1), (7, None, 1)], "id bigint, project string, rate int")
    assert sum(r["files"] for r in validity.rates(df, files).collect()) == 11
    # rows of numbers and runs of one letter look like data, a long line of signs looks minified; null bodies, other extensions and short code do not
    assert {r[0] for r in produced.not_by_hand(df).collect()} == {3, 7, 9, 10}
    empty = df.filter("false")
    assert validity.unparsable(empty).collect() == [] == produced.not_by_hand(empty).collect() == validity.rates(empty, files).collect()
    named = spark.createDataFrame([(None, 1), ("vendor/x.py", 2), ("", 3)], "file_name string, path int")
    assert [r[0] for r in produced.flagged_names(named, named.filter("false")).collect()] == ["vendor/x.py"]


def test_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None), (None, "a b", "en"), (1, "x" * 100_000, None)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(None, "a b c d e f g h i j k l m"), (None, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(None, None, None)], "doc_id bigint, rater string, reading_level int")
    assert leaks.leaked(docs, items).collect() == [] == leaks.paraphrased(docs, items).collect() == reading.reading_levels(docs, labels).collect()
    assert bpe.encode_documents(docs).count() == 3
    assert copies.copies(spark.createDataFrame([(None, '{"condition": ["a"]}'), (None, '{"condition": ["A"]}')], "record_id bigint, payload string")).collect() == []
    hunk = "diff_id bigint, change_id string, diff_hunk struct<condition:array<string>,consequent:array<string>>, tokens int"
    diffs = spark.createDataFrame([(1, None, None, 1), (2, "c", None, 1), (3, "c", (None, [None]), 1)], hunk)
    assert mining.change_patterns(diffs).collect() == []
    revision = "array<struct<hash:string,committer:string>>"
    changes = spark.createDataFrame([(None,), ([],), ([None, ("h", None), ("h", "Ann Lovell")],)], f"revisions {revision}")
    side = spark.createDataFrame([(None,), ("ann lovell",)], "committer string")
    short = spark.createDataFrame([], "given_name string, short_form string")
    assert [tuple(r) for r in names.variants(names.committers(changes, side, side), short).collect()] == [("Ann Lovell", "ann lovell")]


def test_every_query_is_registered():
    assert {f"p{n}_" for n in range(1, 9)} == {q[:3] for q in queries.QUERIES} and set(queries.SQL) <= set(queries.QUERIES)
