"""Leak search against brute force over words, and the paraphrase checks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import leaks


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def shared(a, b, n):
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in runs for i in range(len(a) - n + 1))


VOCABULARY = [f"w{i}" for i in range(60)] + ["naïve", "ÉTÉ", "x_y", "数", "3"]


def corpus(seed=1):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, say(rng.choice([0, 3, 11, 12, 13, 40, 80]))) for i in range(40)] + [(90, None), (91, ""), (5, "w1 w1 w1")]
    docs = []
    for i in range(150):
        part = words(rng.choice(items)[1])
        n = rng.choice([8, 11, 12, 13, 20])
        at = rng.randrange(max(1, len(part) - n + 1))
        docs.append((i, f"{say(rng.choice([0, 1, 5, 60]))}, {', '.join(part[at : at + n]).upper()}\n{say(rng.choice([0, 2, 30]))}"))
    docs += [(500, None), (501, ""), (502, "___"), (503, " ".join(say(500) for _ in range(100)) + " " + items[3][1] + " tail"), docs[0]]
    return docs, items


@pytest.mark.parametrize("slice_words", [200_000, 60])
def test_shared_runs_like_brute_force(spark, slice_words, monkeypatch):
    monkeypatch.setattr(leaks, "SLICE_WORDS", slice_words)
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(f"i{k}", t) for k, t in items], "item_id string, text string")
    want = {(a, f"i{b}") for a, x in docs for b, y in items if shared(words(x), words(y), 12)}
    got = leaks.leaked(d, i).collect()
    assert {tuple(r) for r in got} == want != set() and len(got) == len(want)
    assert want <= {(r[0], r[1]) for r in leaks.paraphrased(d, i).collect()}


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for f in (leaks.leaked, leaks.paraphrased):
        assert f(d.filter("false"), i).collect() == [] == f(d, i.filter("false")).collect()
    with pytest.raises(ValueError):
        leaks.leaked(d, i, window=5)


FILLER = "the broker keeps one entry for each open session and drops it when the client leaves "


def templated(name, a, b):
    return f"In the first draft {name} returned the raw probe whereas the merged form wraps it in a packet with {a} fields and a lease of {b} bytes"


def test_a_restated_passage_is_found_and_one_from_the_same_template_is_not(spark):
    names = ["Gefagaga", "Vomimofo", "Kinalenu", "Setamofi", "Manekuli", "Rinogili", "Bevodipa", "Lemolata"]
    items = [(k, templated(n, 40 + k, 300 + k)) for k, n in enumerate(names)]
    restated = "In our first draft Gefagaga returned the bare probe whereas a merged form wraps it in one packet with 40 fields and some lease of 300 bytes"
    docs = [(1, FILLER * 3 + restated + " " + FILLER * 2), (2, FILLER + templated("Nobody", 11, 12) + " " + FILLER), (3, FILLER * 5), (4, None), (5, FILLER + restated.replace("Gefagaga", "Nobody").replace("300", "7").replace("40", "8"))]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r[0], r[1]): r[2] for r in leaks.paraphrased(d, i, few=0.13).collect()}
    assert {k for k in found if k[0] == 1} == {(1, 0)} and 0.5 <= found[1, 0] < 1
    # a whole shared run of the template is a leak by its words, whatever the name
    assert {k for k in found if k[0] != 1} == {tuple(r) for r in leaks.leaked(d, i).collect()}
    assert not [k for k in found if k[0] in (3, 4, 5)]


def test_short_items_are_searched(spark):
    items = spark.createDataFrame([(1, "which port does the copper relay listen on"), (3, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, FILLER * 3 + "which port would the copper relay listen on " + FILLER * 3), (2, FILLER * 6)], "doc_id bigint, text string")
    assert {(r[0], r[1]) for r in leaks.paraphrased(docs, items, few=1.0).collect()} == {(1, 1)}


def basis_of(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    return leaks.fit_basis(d, pa.array(sorted({w for t in texts for w in words(t)})), rank=6)


def test_the_basis_is_the_leading_singular_space(spark):
    rng = random.Random(3)
    topics = [[f"t{k}x{j}" for j in range(8)] for k in range(4)]
    texts = [" ".join(rng.choice(t) for _ in range(24)) for t in topics for _ in range(20)]
    b = basis_of(spark, texts)
    at = {t: i for i, t in enumerate(b.terms.to_pylist())}
    a = np.zeros((len(texts), len(at)))
    for i, t in enumerate(texts):
        for w in words(t):
            a[i, at[w]] += b.idf[at[w]]
    s = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a @ b.vectors[:, :4]) >= 0.99 * np.linalg.norm(s[:4])
    assert np.allclose(b.vectors.T @ b.vectors, np.eye(b.vectors.shape[1]), atol=1e-5)


def test_recall_of_the_search_and_the_part_of_the_basis(spark):
    docs, items = corpus(5)
    texts = [t for _, t in docs if t]
    b = leaks.fit_basis(spark.createDataFrame([(t,) for t in texts], "text string"), pa.array(sorted({w for _, t in items for w in words(t)})))
    held, at = leaks.tokenized(pa.array([t for _, t in items if t]))
    x = leaks._index(b, held, at, 1)
    found, ids_at = leaks.tokenized(pa.array(texts))
    ids = leaks._numbers(found, b.terms)
    near = lambda index, probes: set(zip(*(c.tolist() for c in leaks._candidates(index, ids, ids_at, 0.8, probes))))
    whole, some = near(x, 10**6), near(x, 4)
    assert some <= whole and len(some) >= 0.9 * len(whole) > 0
    other = leaks._index(leaks.Basis(b.terms, b.idf, b.unknown, np.linalg.qr(np.random.default_rng(0).standard_normal(b.vectors.shape))[0]), held, at, 1)
    assert near(other, 10**6) != whole  # another space gives other candidates
