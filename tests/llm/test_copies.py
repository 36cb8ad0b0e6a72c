"""Copies against a brute-force grouping."""

import json
import random
import re

import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import copies


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def stripped(lines):
    return re.sub(r"[\W_]+", "", " ".join(x for x in lines or [] if x is not None).lower())


def model(rows):
    groups = {}
    for i, payload in set(rows):
        try:
            doc = json.loads(payload or "")
        except ValueError:
            continue
        if isinstance(doc, dict) and ("condition" in doc or "consequent" in doc):
            key = stripped(doc.get("condition")), stripped(doc.get("consequent"))
            if any(key):
                groups.setdefault(key, set()).add(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}, {(min(g), len(g)) for g in groups.values()}


def written(rng, old, new):
    mess = lambda x: "".join(c.upper() if rng.random() < 0.3 else c + rng.choice(["", " ", "  ", ";"]) for c in x)
    parts = [("condition", [mess(x) for x in old]), ("consequent", [mess(x) for x in new])]
    rng.shuffle(parts)
    return json.dumps(dict(parts), indent=rng.choice([None, 1]))


def test_like_brute_force(spark):
    rng = random.Random(1)
    hunks = [([rng.choice(["ab", "ba", "abc", "a1", "é"]) for _ in range(rng.randint(0, 2))], [rng.choice(["xy", "yx", "", "x y"])]) for _ in range(60)]
    rows = [(i, written(rng, *rng.choice(hunks))) for i in range(500)]
    rows += [(1000 + i, written(rng, ["hot"], ["one"])) for i in range(300)] + rows[:20]  # a class with a third of all rows; repeated rows
    rows += [(2000, None), (2001, ""), (2002, '{"condition": ["a"'), (2003, "[]"), (2004, "{}"), (2005, '{"condition": ["--"], "consequent": []}'), (2006, '{"condition": ["' + "long " * 50_000 + '"]}'),
             (2007, '{"condition": [null, "' + "LONG" * 50_000 + '"], "consequent": null}')]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id bigint, payload string, digest string, n int")
    found, counts = model(rows)
    got = copies.copies(df).collect()
    assert {tuple(r) for r in got} == found and len(got) == len(found)
    assert {tuple(r) for r in copies.copy_counts(df).collect()} == counts
    assert copies.copies(df.filter("false")).collect() == [] == copies.copy_counts(df.filter("false")).collect()


def test_small_tables_of_bits_only_let_more_rows_pass(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, written(rng, [f"w{rng.randint(0, 40)}"], [f"v{rng.randint(0, 3)}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id bigint, payload string")
    monkeypatch.setattr(copies, "MOST_BITS", 3)
    assert {tuple(r) for r in copies.copies(df).collect()} == model(rows)[0]
