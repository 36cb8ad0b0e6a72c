import itertools
import random

import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import names


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def test_distance_counts_a_swap_once_and_stays_in_its_band():
    assert names.distance("gramozap", "garmozap") == 1
    assert names.distance("abc", "abc") == 0
    assert names.distance("abcd", "badc") == 2
    assert names.distance("garmozap", "falvenus") == 2


def test_variants_of_people_and_organisations(spark):
    spelled = [
        "Katherine Garmozap", "K. Garmozap", "Katherine Gramozap", "Garmozap, K.", "kate garmozap", "kgarmozap",
        "Francisco Maramrol", "Ignacio Maramrol", "Nacho Maramrol",
        "Lunnemot Systems", "The Lunnemot Systems Team", "Systems team, Lunnemot", "", None,
    ]
    groups = [spelled[:6], spelled[6:7], spelled[7:9], spelled[9:12]]
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    fields = spark.createDataFrame([(x,) for x in spelled], "name string")
    short = spark.createDataFrame([("Katherine", "Kate")], "given_name string, short_form string")
    assert {tuple(r) for r in names.variants(fields, short).collect()} == want


def test_words_one_edit_apart_meet_in_the_index():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        at, kind = rng.randrange(len(a)), rng.randrange(4)
        b = [a[:at] + rng.choice("abcd") + a[at + 1 :], a[:at] + a[at + 1 :], a[:at] + rng.choice("abcd") + a[at:], a[:at] + a[at : at + 2][::-1] + a[at + 2 :]][kind]
        short, long = sorted((a, b), key=len)
        assert names.distance(a, b) <= 1
        met = set(names.segments(short)) & set(names.lookups(long)) or len(a) == len(b) and set(names.segments(long)) & set(names.lookups(short))
        assert a == b or met, (a, b)


def test_given_names_that_agree_share_a_key():
    short = names.short_forms([("Katherine", "Kate"), ("William", "Bill"), ("Robert", "Bob")])
    pool = ["katherine", "kate", "atherine", "ktaherine", "k", "bill", "william", "b", "w", "bob", "robert", "r", "rob", "robret", "wiliam", "#cloud", "#"]
    for a in pool:
        for b in pool:
            if names.same_given(a, b, short, False):
                assert set(names.given_keys(a, short)) & set(names.given_keys(b, short)), (a, b)


def test_empty_tables_and_odd_values(spark):
    empty = spark.createDataFrame([], "name string")
    short = spark.createDataFrame([(None, "Kate"), ("Katherine", None)], "given_name string, short_form string")
    assert names.variants(empty, short).collect() == []
    odd = spark.createDataFrame([("",), (" ",), ("x",), (None,), ("é" * 5000,), ("Ann Lo", ), ("Ann Lo",)], "name string")
    assert names.variants(odd, short).collect() == []


def test_short_families_and_other_spellings_that_had_no_reading(spark):
    groups = [
        ["Wei Li", "wei li", "Li, Wei", "W. Li", "wli"], ["Hana Lee", "Lee, Hana", "Hana Leee"], ["Hana Lu"], ["Mira Lu", "MIRA LU"], ["bob", "BOB"], ["jo", "Jo"], ["an"],
        ["K. J. Garmozap", "Garmozap, K. J.", "Katherine Garmozap", "Katherine Anne Garmozap", "Garmozap, Katherine Anne"],
        ["Michael Thomas", "Thomas, Michael", "Mike Thomas", "M. Thomas"], ["Cloud Services", "The Cloud Services Team"], ["(Ann Oz)", "ann oz"], ["???"],
    ]
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    fields = spark.createDataFrame([(x,) for g in groups for x in g], "name string")
    short = spark.createDataFrame([("Michael", "Mike"), ("Thomas", "Tom")], "given_name string, short_form string")
    assert {tuple(r) for r in names.variants(fields, short).collect()} == want


def test_short_words_one_edit_apart_meet_in_the_index():
    words = ["".join(w) for n in (2, 3, 4) for w in itertools.product("abc", repeat=n)]
    held, asked = ({w: set(f(w)) for w in words} for f in (names.segments, names.lookups))
    for a, b in itertools.combinations(words, 2):
        short, long = sorted((a, b), key=len)
        if names.distance(a, b) == 1:
            assert held[short] & asked[long] or len(a) == len(b) and held[long] & asked[short], (a, b)
