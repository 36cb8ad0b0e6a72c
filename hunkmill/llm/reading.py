"""Reading levels of English documents: a regularised word and character model of sentences, gathered to one calibrated level a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4)
LEAST_WORDS = 40
SAMPLE_DOCS = 3_000  # rated documents that the model is fitted on at most, by a hash of their id; all documents are scored
_LEAST_SEEN = 3  # features in fewer sentences of the sample are left out
_L2_SENTENCE, _L2_DOCUMENT = 2e-5, 1e-3
_STEPS = 120
_SHORT = 3  # parts of fewer words are no sentences
_SMOOTH = 1e-3


class Parts:
    """The sentences of a batch of texts as flat arrays: words, the sentence of each word, the document of each sentence.

    A text is cut at line ends and behind ``. ! ?``. Titles, list items and code end with no such mark and count only in a text without any
    sentence; where no part has ``_SHORT`` words, every part with a word counts. ``total`` has the words of each whole text.
    """

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        marked = pc.replace_substring_regex(low, pattern=r"([.!?][\"')\]]*)\s+", replacement="\\1\n")
        lists = pc.split_pattern_regex(marked, pattern=r"[\r\n]+")
        parts = lists.flatten()
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        ended = pc.match_substring_regex(parts, pattern=r"[.!?][\"')\]]*\s*$").to_numpy(zero_copy_only=False)
        split = pc.split_pattern_regex(parts, pattern=r"[^\p{L}\p{N}]+")
        words = split.flatten()
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        offsets = split.offsets.to_numpy()
        n = np.add.reduceat(np.r_[real, False], offsets[:-1]).astype(np.int64) * (np.diff(offsets) > 0) if len(parts) else np.zeros(0, np.int64)
        self.total = np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)
        rank = np.where(n >= _SHORT, np.where(ended, 3, 2), np.where(n > 0, 1, 0))
        best = np.zeros(len(texts), np.int64)
        np.maximum.at(best, doc, rank)
        take = (rank == best[doc]) & (rank > 0)
        owner = np.repeat(np.arange(len(parts)), np.diff(offsets))
        keep = real & take[owner] if len(parts) else real
        self.words = words.filter(pa.array(keep, pa.bool_()))
        self.sentence = (np.cumsum(take) - 1)[owner[keep]] if len(parts) else np.zeros(0, np.int64)
        self.doc = doc[take]

    def features(self) -> list[pa.Array]:
        """Three features a word: itself, its first four and its last four letters."""
        return [self.words, pc.utf8_slice_codeunits(self.words, 0, 4), pc.utf8_slice_codeunits(self.words, -4)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(step, size: tuple[int, int], rounds: int, rate: float) -> np.ndarray:
    """Full gradients with a rate of their own for each weight (Adam)."""
    w, m, v = (np.zeros(size) for _ in range(3))
    for t in range(1, rounds + 1):
        g = step(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    """Sentence weights by feature (one vocabulary each for words, beginnings and endings), then weights from sentences to documents.

    Level 1: softmax regression with an L2 penalty; a sentence takes part with the rating of its document. Level 2: the mean of the sentences'
    distributions, the mean of their logarithms and the logarithm of their number go through a second softmax regression, which is what
    makes the result calibrated: it learns how pure the documents of a level are.
    """

    def __init__(self, texts: pa.Array, shares: np.ndarray):
        parts = Parts(texts)
        self.vocabularies, self.weights, columns = [], [], []
        n = len(parts.doc)
        size = np.maximum(np.bincount(parts.sentence, minlength=n), 1) if n else np.zeros(0)
        for f in parts.features():
            counts = pc.value_counts(f)
            often = counts.field("values").filter(pc.greater_equal(counts.field("counts"), _LEAST_SEEN))
            self.vocabularies.append(often)
            at = pc.fill_null(pc.index_in(f, often), -1).to_numpy(zero_copy_only=False) if len(often) else np.full(len(f), -1)
            columns.append(at)
        bases = np.cumsum([0, *map(len, self.vocabularies)])
        rows = np.concatenate([parts.sentence[c >= 0] for c in columns])
        cols = np.concatenate([c[c >= 0] + b for c, b in zip(columns, bases)])
        y = shares[parts.doc] if n else np.zeros((0, 4))
        scale = 1 / np.sqrt(size) if n else size
        bias = int(bases[-1])

        def step(w: np.ndarray) -> np.ndarray:
            z = np.stack([np.bincount(rows, weights=w[cols, k], minlength=n) for k in range(4)], 1) * scale[:, None] + w[bias]
            r = (_softmax(z) - y) / max(n, 1)
            s = r * scale[:, None]
            g = np.stack([np.bincount(cols, weights=s[rows, k], minlength=bias + 1) for k in range(4)], 1)
            g[bias] = r.sum(0)
            return g + _L2_SENTENCE * w

        w = _descend(step, (bias + 1, 4), _STEPS if n else 0, 0.1)
        self.weights = [w[a:b] for a, b in zip(bases, bases[1:])]
        self.bias = w[bias]
        x = self._gathered(parts, len(texts))
        self.mean, self.spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(9), np.ones(9))
        x = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]

        def step2(v: np.ndarray) -> np.ndarray:
            return x.T @ (_softmax(x @ v) - shares) / max(len(x), 1) + _L2_DOCUMENT * v

        self.top = _descend(step2, (10, 4), 3 * _STEPS if len(x) else 0, 0.1)

    def _sentences(self, parts: Parts) -> np.ndarray:
        n = len(parts.doc)
        z = np.zeros((n, 4))
        for f, vocabulary, w in zip(parts.features(), self.vocabularies, self.weights):
            if not len(vocabulary) or not n:
                continue
            at = pc.fill_null(pc.index_in(f, vocabulary), -1).to_numpy(zero_copy_only=False)
            hit = at >= 0
            rows, at = parts.sentence[hit], at[hit]
            for k in range(4):
                z[:, k] += np.bincount(rows, weights=w[at, k], minlength=n)
        return _softmax(z / np.sqrt(np.maximum(np.bincount(parts.sentence, minlength=n), 1))[:, None] + self.bias) if n else z

    def _gathered(self, parts: Parts, n_docs: int) -> np.ndarray:
        p = self._sentences(parts)
        n = np.maximum(np.bincount(parts.doc, minlength=n_docs), 1)
        by = lambda x: np.stack([np.bincount(parts.doc, weights=x[:, k], minlength=n_docs) for k in range(4)], 1) / n[:, None]
        return np.c_[by(p), by(np.log(p + _SMOOTH)), np.log(n)]

    def levels(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(level, number of words) of each text."""
        parts = Parts(texts)
        x = (self._gathered(parts, len(texts)) - self.mean) / self.spread
        return (np.c_[x, np.ones(len(x))] @ self.top).argmax(1) + 1, parts.total


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of at most ``sample_docs`` rated English documents (the same ones on every run, whatever the order of rows)."""
    rated = labels.filter("reading_level between 1 and 4").groupBy("doc_id").agg(
        F.array(*[F.avg((F.col("reading_level") == k).cast("double")) for k in LEVELS]).alias("share")
    )
    order = F.xxhash64("doc_id"), F.col("doc_id")
    rated = rated.orderBy(*order).limit(4 * sample_docs)  # others are in another language or null
    rows = documents.filter("lang = 'en' and text is not null").select("doc_id", "text").join(F.broadcast(rated), "doc_id").dropDuplicates(["doc_id"])
    table = rows.orderBy(*order).limit(sample_docs).select("text", "share").toArrow()
    shares = np.array(table.column("share").to_pylist(), float).reshape(-1, 4)
    return Model(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), shares)


def reading_levels(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, reading_level) of every English document with at least ``LEAST_WORDS`` words, rated or not.

    The model (see ``Model``) is fitted at the driver on a bounded sample of the rated documents, ``sample_docs``; a document that raters
    disagree on takes part with its shares. Every document is then scored whole, in one pass without a shuffle.

    Defined results: null texts and other languages give no row; without any label every document gets level 1; a text without a sentence
    is judged by its lines; a repeated row gives a row each.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit(documents, labels, sample_docs))
    english = documents.filter("lang = 'en' and text is not null").select("doc_id", "text")
    kind = dict(documents.dtypes)["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                level, n = model.levels(b.column(1).slice(lo, 1024))
                keep = pa.array(n >= LEAST_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, 1024).filter(keep), pa.array(level.astype(np.int32)).filter(keep)], ["doc_id", "reading_level"]
                )

    return english.mapInArrow(score, f"doc_id {kind}, reading_level int")
