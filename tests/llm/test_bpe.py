"""The encoder against the public libraries."""

import random
import time

import pytest

from hunkmill.llm import bpe

PATH = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "", " ", "a", "Hello  world's\n\n\tfoo_bar(1234)  ", "aaa" * 50, "日本語のテキスト", "naïve café 🙂🙂", "<|endoftext|>", "x" * 3000, "ab" * 1001, "\r\n \r\n", "don't we'll I'M", "  x", "Ⅷ²½", "=" * 500,
    "é" * 90, "\x00\x01", "word " * 400, "a" * 129, " " * 300 + "x",
]


def test_equal_to_the_library(library):
    rng = random.Random(1)
    alphabet = "etaoin shrdlu_().,\n\t0123456789éß漢🙂'\"=+-ABC"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    assert bpe.loaded(PATH).encode(texts) == library(texts)


def test_long_pieces_equal_and_quick(library):
    rng = random.Random(2)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    began = time.time()
    got = bpe.ByteBpe(PATH).encode([long])
    assert time.time() - began < 20
    assert got == library([long])


def test_table():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    rows = [(1, None, "x"), (2, "", "x"), (3, "hi there", "x"), (3, "hi there", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_documents(df).collect())
    assert got == [(1, []), (2, []), (3, bpe.loaded(PATH).encode(["hi there"])[0])] + [(3, bpe.loaded(PATH).encode(["hi there"])[0])]
    assert bpe.encode_documents(df.filter("false")).collect() == []


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(f"{bpe.TOKENIZER_DIR}/word_bpe_49k.json")
