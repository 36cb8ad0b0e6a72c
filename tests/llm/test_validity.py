from pyspark.sql import SparkSession

from hunkmill.llm.parsing import validity
from hunkmill.llm.parsing.languages import first_error


def test_java_with_a_package_line_and_a_throws_clause_parses():
    body = "package a.b;\n\nimport java.util.List;\n\npublic class A {\n    A() throws E {}\n    int f(int x) throws E, F { return x; }\n    void g() throws E;\n}\n"
    assert first_error("java", body) is None
    assert first_error("java", body.replace("return x;", "return x")) is not None


def test_flags_and_rates():
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    rows = [
        (1, 1, "a.py", "x = 1\r\n"), (2, 1, "a.PY", "x = (\n"), (3, 2, "a.java", "package a;\nclass A {}\n"), (4, 2, "a.js", "let x = ;\n"), (5, 9, "a.json", "{'a': 1}"),
        (6, 1, "a.py", None), (7, 1, "a.py", ""), (8, 1, "a.rst", "x = ("), (9, 1, None, "x = ("),
    ]
    sources = spark.createDataFrame(rows, "blob_id bigint, file_id bigint, file_path string, body string")
    files = spark.createDataFrame([(1, "o/p"), (2, "o/q")], "id bigint, project string")
    assert sorted(r[0] for r in validity.unparsable(sources).collect()) == [2, 4, 5]
    got = {(r[0], r[1]): tuple(r[2:]) for r in validity.rates(sources, files).collect()}
    assert got == {("o/p", "python"): (2, 1, 0.5), ("o/q", "java"): (1, 0, 0.0), ("o/q", "javascript"): (1, 1, 1.0), (None, "json"): (1, 1, 1.0)}
