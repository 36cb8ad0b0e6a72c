"""Reading levels: planted styles, held-out accuracy and odd texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from hunkmill.llm import reading


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()


EASY, HARD = "We fix the bad code now. ", "Notwithstanding the referential commutativity, it remains indispensable. "
STYLES = [
    ["The dog can run.", "We see the box.", "It is a red cup.", "You can open it."], ["The team moved the module because it was small.", "After the release we repeat the test.", "Users asked for a simple page."],
    ["The scheduler persists intermediate results before validation.", "Concurrent writers require explicit coordination.", "This revision replaces the persistent connection."],
    ["Notwithstanding the asymptotic quiescence, provenance remains indeterminate.", "The methodological consequence presupposes concomitant interoperability.", "Insofar as stochastic replicas circumscribe nondeterminism, the bound is tight."],
]


def document(rng, level, n=12):
    pick = lambda: STYLES[level if rng.random() < 0.7 else rng.randrange(4)]
    return " ".join(rng.choice(pick()) for _ in range(n))


def test_held_out_accuracy_with_mixed_documents_and_wrong_ratings():
    rng = random.Random(1)
    levels = [rng.randrange(4) for _ in range(500)]
    texts = [document(rng, k) for k in levels]
    rated = [k if rng.random() < 0.95 else rng.randrange(4) for k in levels[:300]]
    model = reading.Model(pa.array(texts[:300]), np.eye(4)[rated])
    got, total = model.levels(pa.array(texts[300:]))
    assert (got - 1 == levels[300:]).mean() > 0.9
    assert (total == [len(t.replace(",", "").split()) for t in texts[300:]]).all()


def test_every_english_document_of_forty_words_gets_its_level(spark):
    rows = [(i, (EASY if i % 2 else HARD) * 8, "en") for i in range(8)]
    rows += [(8, EASY * 6, "en"), (9, EASY * 7, "en"), (10, HARD * 9, "de"), (11, None, "en"), (12, HARD * 9, "en"), (13, "", "en"), (14, EASY * 9, None), (9, EASY * 7, "en")]
    rows += [(15, "word " * 60_000, "en"), (16, "- a\n- b\n" * 30, "en")]
    documents = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, reading_level int")
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 4) for i in range(8)] + [(0, "s", 4), (99, "r", 2), (1, "r", None), (2, "r", 7)], "doc_id bigint, rater string, reading_level int")
    got = sorted((r[0], r[1]) for r in reading.reading_levels(documents, labels).collect())
    assert [g for g in got if g[0] < 15] == [(i, 1 if i % 2 else 4) for i in range(8)] + [(9, 1), (9, 1), (12, 4)]
    assert {g[0] for g in got} >= {15, 16}
    assert reading.reading_levels(documents.filter("false"), labels).collect() == []
    assert {r[1] for r in reading.reading_levels(documents, labels.filter("false")).collect()} == {1}


def test_sentences():
    p = reading.Parts(pa.array(["Title here now\nOne two three. Four five six! \"Seven eight nine.\" end", "- a b c\n- d", "x", None, "..."]))
    assert p.doc.tolist() == [0, 0, 0, 1, 2] and p.total.tolist() == [13, 4, 1, 0, 0]
    assert p.words.to_pylist()[:3] == ["one", "two", "three"]
