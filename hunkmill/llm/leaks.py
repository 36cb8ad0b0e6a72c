"""Evaluation passages that leak into training text: latent semantic retrieval, then sequence checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 24  # words of a passage in the corpus statistics, and around a candidate in the paraphrase check
BLOCK = 6  # words of a passage in the candidate search
STRIDE = 3  # of the blocks of a document; the windows of an item start at every word
RANK = 32  # latent dimensions
MIN_COSINE = 0.8  # of a candidate; equal blocks have 1, so no shared run of BLOCK + STRIDE - 1 words or more can be missed
DRIFT = 4  # words by which a name or figure of a restated passage may be out of place
SLICE_WORDS = 200_000  # item words a broadcast index holds; more items are searched in slices of this size
ROWS = 256  # documents handled at once


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (maximal runs of letters and digits, in lower case) of the texts, and where each text begins; null texts have none."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}\p{N}]+")
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real, pa.bool_())), np.r_[0, np.cumsum(real)][split.offsets.to_numpy() - split.offsets[0].as_py()]


def _numbers(words: pa.Array, terms: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


@dataclass
class Basis:
    """Terms of the items, their inverse document frequencies over all passages of the corpus, and the latent basis."""

    terms: pa.Array
    idf: np.ndarray
    unknown: float  # the inverse document frequency of a word that no item has
    vectors: np.ndarray  # terms x rank, orthonormal columns


def fit_basis(texts: DataFrame, terms: pa.Array, rank: int = RANK, seed: int = 7) -> Basis:
    """Distributed randomised SVD of the TF-IDF matrix of all passages of ``texts`` (one string column), over the given terms.

    With the counts C (passages x terms) and the weights D, the matrix is CD, and its right singular vectors are the eigenvectors of
    G = D C'C D. One pass over the corpus gives the document frequencies and Z = C'C.Omega for a random Omega; as Omega stands for
    D^-1.Omega before weighting, G is recovered from DZ and Omega'Z alone (Nystroem). A task emits only terms that it met, summed; the sums
    over tasks are made in the JVM. Terms x (rank + 8) numbers reach the driver, whatever the size of the corpus.
    """
    spark = texts.sparkSession
    n, width = len(terms), min(len(terms), rank + 8)
    omega = np.random.default_rng(seed).standard_normal((n, width))
    shared = spark.sparkContext.broadcast((terms, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, omega = shared.value
        z, df, passages = np.zeros((n, width)), np.zeros(n + 1), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                words, at = tokenized(batch.column(0).slice(lo, ROWS))
                ids = _numbers(words, terms)
                size = np.diff(at)
                per = -(-size // PASSAGE)
                first = np.cumsum(per) - per
                passage = np.repeat(first, size) + (np.arange(len(ids)) - np.repeat(at[:-1], size)) // PASSAGE
                passages += int(per.sum())
                known = ids >= 0
                t, p = ids[known], passage[known]
                if not len(t):
                    continue
                begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                y = np.add.reduceat(omega[t], begin, axis=0)
                row = np.cumsum(np.r_[False, p[1:] != p[:-1]])
                order = np.argsort(t, kind="stable")
                ts = t[order]
                start = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
                z[ts[start]] += np.add.reduceat(y[row[order]], start, axis=0)
                seen = np.r_[True, (ts[1:] != ts[:-1]) | (row[order][1:] != row[order][:-1])]
                df[:n] += np.bincount(ts[seen], minlength=n)
        df[n] = passages
        met = np.flatnonzero(df)
        full = np.vstack([z, np.zeros((1, width))])[met]
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(df[met]), *(pa.array(full[:, k]) for k in range(width))], names)

    names = ["term", "df", *(f"z{k}" for k in range(width))]
    parts = texts.mapInArrow(sketch, ", ".join(["term int", *(f"{c} double" for c in names[1:])]))
    z, df = np.zeros((n, width)), np.zeros(n + 1)
    for r in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names[1:]]).toLocalIterator():
        df[r[0]] = r[1]
        if r[0] < n:
            z[r[0]] = r[2:]
    idf = np.log((df[n] + 1) / (df[:n] + 1)) + 1
    y, small = idf[:, None] * z, omega.T @ z
    shift = 1e-9 * max(np.linalg.norm(y), 1e-9)
    value, vector = np.linalg.eigh((small + small.T) / 2 + shift * np.eye(width))
    half = vector / np.sqrt(np.maximum(value, shift))
    u, s, _ = np.linalg.svd(y @ half, full_matrices=False)
    good = s > 1e-9 * max(s.max(initial=0), 1e-300)
    return Basis(terms, idf, float(np.log(df[n] + 1) + 1), u[:, good][:, :rank])


@dataclass
class _Index:
    """The windows of a slice of items, grouped around centres of their latent directions."""

    basis: Basis
    ids: np.ndarray  # words of all items as term numbers
    begin: np.ndarray  # of each item in ids
    item: np.ndarray  # of each window
    place: np.ndarray  # of each window in ids
    unit: np.ndarray  # direction of each window in the latent space
    centres: np.ndarray
    cells: list[np.ndarray]  # windows around each centre
    own: np.ndarray  # of each term: stands in so few items that it is one of an item's names and figures


def _vectors(basis: Basis, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Directions of passages in the latent space, as long as the share of their TF-IDF length that the terms make up: words outside the terms
    shorten them, so that the product with an item's direction is a cosine that such words lower."""
    at = _spread(starts, sizes)
    owner = np.repeat(np.arange(len(starts)), sizes)
    terms = ids[at]
    known = terms >= 0
    weight = np.where(known, basis.idf[terms], basis.unknown)
    # equal terms of a passage add before they are squared
    key = owner * (len(basis.idf) + 1) + terms + 1
    order = np.argsort(key, kind="stable")
    ks = key[order]
    first = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]]) if len(ks) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], first) if len(ks) else np.zeros(0)
    stranger = ks[first] % (len(basis.idf) + 1) == 0
    squared = np.where(stranger, sums * basis.unknown, sums**2)  # unknown words count as different ones
    holder = owner[order][first]
    share = np.sqrt(np.bincount(holder, weights=squared * ~stranger, minlength=len(starts)) / np.maximum(np.bincount(holder, weights=squared, minlength=len(starts)), 1e-12))
    latent = np.zeros((len(starts), basis.vectors.shape[1]), np.float32)
    weighted = (basis.idf[:, None] * basis.vectors).astype(np.float32)
    filled = np.flatnonzero(sizes > 0)
    if len(filled):
        vec = np.where(known[:, None], weighted[terms], np.float32(0))
        latent[filled] = np.add.reduceat(vec, (np.cumsum(sizes) - sizes)[filled], axis=0)
    length = np.linalg.norm(latent, axis=1)
    return latent * np.where(length > 1e-9, share / np.maximum(length, 1e-9), 0)[:, None].astype(np.float32)


def _index(basis: Basis, words: pa.Array, at: np.ndarray, few: int, seed: int = 5) -> _Index:
    ids = _numbers(words, basis.terms)
    size = np.diff(at)
    per = np.where(size > 0, np.maximum(size - BLOCK + 1, 1), 0)
    item = np.repeat(np.arange(len(size)), per)
    place = _spread(at[:-1], per)
    unit = _vectors(basis, ids, place, np.minimum(BLOCK, at[1:][item] - place))
    holders = np.zeros(len(basis.idf), np.int64)
    pairs = np.unique(np.repeat(np.arange(len(size)), size) * len(basis.idf) + ids)
    np.add.at(holders, pairs % len(basis.idf), 1)
    # centres: a few rounds of spherical k-means; a window belongs to its nearest centre, whatever the sample
    direction = unit
    k = max(1, int(np.sqrt(len(unit))))
    rng = np.random.default_rng(seed)
    centres = direction[rng.choice(len(direction), k, replace=False)]
    for _ in range(4):
        near = np.concatenate([(direction[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(direction), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, direction)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres).astype(np.float32)
    near = np.concatenate([(direction[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(direction), 4096)])
    order = np.argsort(near, kind="stable")
    cells = np.split(order, np.searchsorted(near[order], np.arange(1, k)))
    return _Index(basis, ids, at, item, place, unit, centres, cells, holders <= few)


def _candidates(x: _Index, ids: np.ndarray, at: np.ndarray, min_cosine: float, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place of the block, window) of all blocks and item windows with a cosine of at least ``min_cosine``.

    A block is looked up in the ``probes`` cells whose centres lie nearest. Equal passages have equal vectors and so the same nearest centre;
    for others the search is approximate (its recall is measured in the tests).
    """
    size = np.diff(at)
    per = np.where(size > 0, np.maximum(-(-(size - BLOCK) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(size)), per)
    start = np.minimum(np.repeat(at[:-1], per) + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)), np.maximum(at[1:][doc] - BLOCK, at[:-1][doc]))
    length = np.minimum(BLOCK, at[1:][doc] - start)
    # words outside the terms lower every cosine: with too few known words none can reach the threshold
    known = np.r_[0, np.cumsum(np.where(ids >= 0, x.basis.idf[ids] ** 2, 0.0) if len(x.basis.idf) else np.zeros(len(ids)))]
    strange = np.r_[0, np.cumsum(ids < 0)] * x.basis.unknown**2
    inner, outer = known[start + length] - known[start], strange[start + length] - strange[start]
    able = (inner > 0) & (BLOCK * inner >= min_cosine**2 * (BLOCK * inner + outer))
    doc, start, length = doc[able], start[able], length[able]
    v = _vectors(x.basis, ids, start, length)
    strong = np.linalg.norm(v, axis=1) >= min_cosine - 1e-4
    doc, start, v = doc[strong], start[strong], v[strong]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    many = min(probes, len(x.centres))
    for lo in range(0, len(v), 8192):
        part = v[lo : lo + 8192]
        close = part @ x.centres.T
        cells = np.argpartition(-close, many - 1, axis=1)[:, :many]
        flat = cells.ravel()
        order = np.argsort(flat, kind="stable")
        rows = order // many
        bounds = np.searchsorted(flat[order], np.arange(len(x.centres) + 1))
        for c in np.unique(flat):
            mine, theirs = rows[bounds[c] : bounds[c + 1]], x.cells[c]
            if not len(theirs):
                continue
            for b in range(0, len(theirs), 4096):
                r, w = np.nonzero(part[mine] @ x.unit[theirs[b : b + 4096]].T >= min_cosine - 1e-4)
                found.append((lo + mine[r], theirs[b + w]))
    if not found:
        return doc[:0], start[:0], start[:0]
    r, w = (np.concatenate(p) for p in zip(*found))
    return doc[r], start[r], w


def _runs(x: _Index, ids: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, w: np.ndarray, need: int) -> np.ndarray:
    """Whether the shared run around each candidate has at least ``need`` words, read along its diagonal word by word."""
    ok = np.zeros(len(doc), bool)
    equal = np.minimum(x.begin[x.item[w] + 1] - x.place[w], at[doc + 1] - start) >= BLOCK  # such a run holds a whole block of the document
    for k in range(BLOCK):
        some = np.flatnonzero(equal)
        equal[some] = ids[start[some] + k] == x.ids[x.place[w[some]] + k]
    equal = np.flatnonzero(equal)
    span = np.arange(-need, need + BLOCK)
    for lo in range(0, len(equal), 50_000):
        part = equal[lo : lo + 50_000]
        i, j = start[part, None] + span, x.place[w[part], None] + span
        inside = (i >= at[doc[part], None]) & (i < at[doc[part] + 1, None]) & (j >= x.begin[x.item[w[part]], None]) & (j < x.begin[x.item[w[part]] + 1, None])
        same = inside & (ids[np.clip(i, 0, len(ids) - 1)] == x.ids[np.clip(j, 0, len(x.ids) - 1)])
        run = np.zeros(len(same), np.int64)
        best = np.zeros(len(same), np.int64)
        for k in range(same.shape[1]):
            run = (run + 1) * same[:, k]
            np.maximum(best, run, out=best)
        ok[part] = best >= need
    return ok


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & place.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _restated(x: _Index, ids: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, w: np.ndarray, min_common: float, min_answer: float) -> dict[tuple[int, int], float]:
    """(document, item) -> best common share, of the candidates whose surroundings pass the answer check and the subsequence check.

    The item passage is PASSAGE words around the window, the document's DRIFT words more on each side. The answer check asks for the names and
    figures of the item passage: ``min_answer`` of them must stand at their place in the document, give or take DRIFT words, and they must
    be two different ones at least, or all that the passage has.
    """
    best: dict[tuple[int, int], float] = {}
    side = (PASSAGE - BLOCK) // 2
    own_item, own_doc = np.r_[0, np.cumsum(x.own[x.ids])], np.r_[0, np.cumsum((ids >= 0) & x.own[ids])]
    item = x.item[w]
    a, b = np.maximum(x.place[w] - side, x.begin[item]), np.minimum(x.place[w] + BLOCK + side, x.begin[item + 1])
    c, d = np.maximum(start - side - DRIFT, at[doc]), np.minimum(start + BLOCK + side + DRIFT, at[doc + 1])
    able = (own_item[b] > own_item[a]) & (own_doc[d] - own_doc[c] >= min_answer * np.minimum(own_item[b] - own_item[a], 1))
    doc, item, start, w = doc[able], item[able], start[able], w[able]
    if not len(w):
        return best
    # one candidate for each document, item passage and diagonal, to the nearest few words
    slant = (start - x.place[w]) // DRIFT
    slant -= slant.min()
    key = np.unique(((doc * (len(x.ids) + 1)) + x.place[w] // STRIDE) * (slant.max() + 1) + slant, return_index=True)[1]
    doc, item, start, place = doc[key], item[key], start[key], x.place[w[key]]
    span = np.arange(-side, BLOCK + side)
    for lo in range(0, len(doc), 20_000):
        part = slice(lo, lo + 20_000)
        j, i = place[part, None] + span, start[part, None] + span
        inside = (j >= x.begin[item[part], None]) & (j < x.begin[item[part] + 1, None])
        theirs = np.where(inside, x.ids[np.clip(j, 0, len(x.ids) - 1)], -2)
        named = inside & x.own[theirs]
        met = np.zeros(named.shape, bool)
        low, high = at[doc[part], None], at[doc[part] + 1, None]
        for drift in range(-DRIFT, DRIFT + 1):
            k = i + drift
            met |= (k >= low) & (k < high) & (ids[np.clip(k, 0, len(ids) - 1)] == theirs)
        met &= named
        asked, answered = named.sum(1), met.sum(1)
        words = np.stack([np.where(met, theirs, -1).max(1), np.where(met, theirs, 1 << 40).min(1)], 1)  # two different ones, or all there are
        able = (answered > 0) & (answered >= min_answer * asked) & ((words[:, 0] != words[:, 1]) | (answered == asked))
        for n in np.flatnonzero(able):
            g = lo + n
            a, b = max(place[g] - side, x.begin[item[g]]), min(place[g] + BLOCK + side, x.begin[item[g] + 1])
            c, d = max(start[g] - side - DRIFT, at[doc[g]]), min(start[g] + BLOCK + side + DRIFT, at[doc[g] + 1])
            share = common_subsequence(x.ids[a:b].tolist(), ids[c:d].tolist()) / (b - a)
            pair = int(doc[g]), int(item[g])
            if share >= min_common and share > best.get(pair, 0):
                best[pair] = share
    return best


def _slices(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, words, begins) of the distinct items, in slices of about SLICE_WORDS words; one slice is held at a time."""
    kind = items.select(item_id).limit(0).toArrow().schema.field(0).type
    keys: list = []
    texts: list = []
    size = 0
    for r in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).distinct().orderBy(item_id, item_text).toLocalIterator():
        keys.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 6 + 1
        if size >= SLICE_WORDS:
            yield pa.array(keys, kind), *tokenized(pa.array(texts, pa.string()))
            keys, texts, size = [], [], 0
    if keys:
        yield pa.array(keys, kind), *tokenized(pa.array(texts, pa.string()))


def _searched(documents: DataFrame, items: DataFrame, check, id_col: str, text_col: str, item_id: str, item_text: str, min_cosine: float, probes: int, few: float) -> DataFrame:
    """(doc_id, item_id, score double) of what ``check`` keeps of the candidates; it maps (index, ids, at, doc, start, window) to (doc, item, score)."""
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[id_col], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double"
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    result = None
    for keys, words, at in _slices(items, item_id, item_text):
        if not len(words):
            continue
        basis = fit_basis(texts.select("text"), pc.unique(words))
        shared = spark.sparkContext.broadcast((_index(basis, words, at, max(1, int(few * len(keys)))), keys))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, keys = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    words, at = tokenized(part.column(1))
                    ids = _numbers(words, index.basis.terms)
                    doc, item, score = check(index, ids, at, *_candidates(index, ids, at, min_cosine, probes))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), keys.take(pa.array(item, pa.int64())), pa.array(score, pa.float64())], ["doc_id", "item_id", "score"])

        rows = texts.mapInArrow(search, schema)
        result = rows if result is None else result.unionByName(rows)
    return result if result is not None else spark.createDataFrame([], schema)


def _leaks(x: _Index, ids, at, doc, start, w, window: int):
    ok = _runs(x, ids, at, doc, start, w, window)
    pairs = np.unique(doc[ok] * len(x.begin) + x.item[w[ok]])
    return pairs // len(x.begin), pairs % len(x.begin), np.ones(len(pairs))


def leaked(
    documents: DataFrame, items: DataFrame, window: int = 12, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_cosine: float = MIN_COSINE, probes: int = 4,
) -> DataFrame:
    """(doc_id, item_id): the pairs that share a run of at least ``window`` consecutive words (BLOCK + STRIDE - 1 at least).

    Blocks of documents and windows of items (BLOCK words) are TF-IDF passages in the latent space of ``fit_basis``; pairs with a cosine of
    ``min_cosine`` are candidates, and the shared run around a candidate is then measured word by word. A shared run holds a whole block of
    the document, whose cosine with the same words of the item is 1, so none is missed.

    Defined results: null, empty and short texts give no row; repeated rows give one row a (doc_id, item_id); texts are searched whole; empty
    tables give an empty result; clashing column names do not matter. The items are the stated query set: they are read to the driver and
    searched in slices of SLICE_WORDS words, each with its own basis, so the corpus is read twice a slice.
    """
    if window < BLOCK + STRIDE - 1:
        raise ValueError(f"window must be at least {BLOCK + STRIDE - 1}")
    check = lambda *c: _leaks(*c, window=window)
    found = _searched(documents, items, check, id_col, text_col, item_id, item_text, min_cosine, probes, 0.02)
    return found.select("doc_id", "item_id").distinct()


def paraphrased(
    documents: DataFrame, items: DataFrame, window: int = 12, min_common: float = 0.5, min_answer: float = 0.6, few: float = 0.02,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_cosine: float = MIN_COSINE, probes: int = 8,
) -> DataFrame:
    """(doc_id, item_id, common double): documents that leak an item word by word (``leaked``) or restate a passage of it, word order kept in the main.

    The candidates are those of ``leaked``. One is kept if the longest common subsequence covers ``min_common`` of the item passage of PASSAGE
    words around it, and ``min_answer`` of the passage's names and figures stand at their place in the document (see ``_restated``). Names and
    figures are the terms that at most ``few`` of the items have; so two texts from one template with other names are no restatement, nor
    is a passage without any of them. ``common`` is the best share over the passages, rounded to 6 places, and 1.0 for a shared run.

    An item of fewer than BLOCK words is one window and meets blocks of BLOCK words. Null and empty texts give no row; a pair comes once.
    """

    def check(x, ids, at, doc, start, w):
        d, i, _ = _leaks(x, ids, at, doc, start, w, window)
        rest = ~np.isin(doc * len(x.begin) + x.item[w], d * len(x.begin) + i)
        best = _restated(x, ids, at, doc[rest], start[rest], w[rest], min_common, min_answer)
        best |= dict.fromkeys(zip(d.tolist(), i.tolist()), 1.0)
        return [a for a, _ in best], [b for _, b in best], [round(s, 6) for s in best.values()]

    found = _searched(documents, items, check, id_col, text_col, item_id, item_text, min_cosine, probes, few)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("common"))
