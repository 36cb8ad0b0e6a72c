import random
from itertools import combinations

import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import mining


def model(rows, least):
    held = {}
    for entity, seq in rows:
        for k in (3, 4, 5):
            for p in combinations(seq, k):
                held.setdefault(p, set()).add(entity)
    return {p: len(e) for p, e in held.items() if len(e) >= least}


@pytest.mark.parametrize("cold", [0, 6])
def test_as_many_hot_entities_as_the_support_lose_no_pattern(cold):
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    rng = random.Random(7)
    rows = [(f"h{e}", [rng.choice("abcdef") for _ in range(6)]) for e in range(10) for _ in range(6)]
    rows += [(f"c{e}", [rng.choice("abcdef") for _ in range(6)]) for e in range(cold)]
    frame = spark.createDataFrame(rows, "entity string, tokens array<string>")
    got = mining.frequent_patterns(frame, hot_rows=3, min_support=lambda n: 8).collect()
    assert {tuple(r[0]): r[1] for r in got} == model(rows, 8) != {}


def rows_of(seed, n_entities, per, alphabet="abcdefg", longest=7):
    rng = random.Random(seed)
    return [(f"e{e}", [rng.choice(alphabet) for _ in range(rng.randint(0, longest))]) for e in range(n_entities) for _ in range(per)]


@pytest.mark.parametrize(
    "options",
    [{}, {"block_rows": 20}, {"block_rows": 20, "candidates": 5}, {"hot_rows": 2}, {"hot_rows": 3, "block_rows": 30, "candidates": 7}],
)
def test_every_way_of_splitting_gives_the_same_patterns(options):
    spark = SparkSession.builder.getOrCreate()
    rows = rows_of(1, 60, 2, "abcd", 8) + [("e0", list("abcabc"))] * 3 + rows_of(2, 3, 6, "abcd", 8)
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(None, ["a", "b", "c"], ""), ("e1", None, ""), ("e2", [None, "a"], "")], "entity string, tokens array<string>, pattern string")
    got = mining.frequent_patterns(frame, min_support=lambda n: 12, **options).collect()
    assert {tuple(r[0]): r[1] for r in got} == model([(e, s) for e, s in rows], 12) != {}
    assert len(got) == len({tuple(r[0]) for r in got})


def test_items_are_coded_by_a_join_where_they_are_many(monkeypatch):
    spark = SparkSession.builder.getOrCreate()
    rows = rows_of(3, 40, 2, "abcd", 8)
    frame = spark.createDataFrame(rows, "entity string, tokens array<string>")
    monkeypatch.setattr(mining, "DICTIONARY", 0)
    got = mining.frequent_patterns(frame, min_support=lambda n: 9).collect()
    assert {tuple(r[0]): r[1] for r in got} == model(rows, 9) != {}


def test_one_very_long_sequence_costs_its_own_length():
    spark = SparkSession.builder.getOrCreate()
    rows = rows_of(4, 300, 2, "abcdefgh", 8) + [("long", list("abcdefgh") * 4000)]
    frame = spark.createDataFrame(rows, "entity string, tokens array<string>")
    got = {tuple(r[0]): r[1] for r in mining.frequent_patterns(frame, min_support=lambda n: 20, max_len=3).collect()}
    want = {p: n for p, n in model(rows[:-1], 19).items() if len(p) == 3}
    assert got == {p: n + 1 for p, n in want.items()} != {}


def test_empty_table_and_nothing_frequent():
    spark = SparkSession.builder.getOrCreate()
    frame = spark.createDataFrame([], "entity string, tokens array<string>")
    assert mining.frequent_patterns(frame).collect() == []
    assert mining.frequent_patterns(spark.createDataFrame([("a", ["x", "y", "z"])], "entity string, tokens array<string>")).collect() == []
