"""Encoding of texts with a public byte-level BPE vocabulary, by numpy over length-bucketed padded matrices."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame

#: Split pattern of the public byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = os.environ.get("HUNKMILL_TOKENIZER_DIR", "/opt/tokenizers")

_NONE = np.int32(2**31 - 1)
_LONG = 128  # longer pieces merge all places of a round's pair at once
_KEPT = 100_000  # pieces kept in a worker's memory; above that the memory starts anew


def _printable_bytes() -> dict[str, int]:
    """The vocabulary writes each byte as one printable character: printable Latin-1 ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return table | {chr(0x100 + i): b for i, b in enumerate(others)}


class PairTable:
    """Open-addressing hash table in numpy: pair of ids -> (rank, merged id)."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 2 + 1))) + 1)
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(pairs))
        slot = self._slot(pairs)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            put = left[first]
            self.keys[slot[first]], self.ranks[slot[first]], self.merged[slot[first]] = pairs[put], ranks[put], merged[put]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of the keys, in their shape; the rank is _NONE where there is no such pair."""
        flat = keys.ravel()
        rank, merged = np.full(flat.shape, _NONE, np.int32), np.zeros(flat.shape, np.int32)
        at, slot = np.arange(len(flat)), self._slot(flat)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == flat[at]
            rank[at[hit]], merged[at[hit]] = self.ranks[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            at, slot = at[on], (slot[on] + 1) & self.mask
        return rank.reshape(keys.shape), merged.reshape(keys.shape)


class ByteBpe:
    """A byte-level BPE encoder; ``encode_pieces`` is vectorised over pieces of similar length."""

    def __init__(self, path: str, text: str | None = None):
        import regex

        if text is None:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        whole = json.loads(text)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix") if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or odd:
            raise ValueError(f"{path} is no plain byte-level BPE with the usual split pattern")
        vocab, back = model["vocab"], _printable_bytes()
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in back.items():
            self.byte_ids[b] = vocab[ch]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        new = np.array([vocab[x + y] for x, y in merges], np.int32)
        ranks = np.arange(len(merges), dtype=np.int32)
        self.table = PairTable((a << 20) | b, ranks, new)
        made = np.full(len(vocab) + 1, -1, np.int64)
        made[new] = ranks
        # every merge uses tokens that only earlier merges make, so merging all places of a pair at once is the same as one by one
        self.ordered = bool((made[a] < ranks).all() and (made[b] < ranks).all() and len(np.unique(new)) == len(new))
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _rounds(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a padded matrix (-1 right of a row's end): each round merges the leftmost minimum-rank pair of every row."""
        out: list[np.ndarray] = [None] * len(ids)  # type: ignore[list-item]
        rows = np.arange(len(ids))
        ids = ids.astype(np.int64)
        rank, new = self._pairs(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            if width > 1:
                at = rank.argmin(axis=1)
                live = rank[np.arange(len(ids)), at] != _NONE
            else:
                live = np.zeros(len(ids), bool)
            for r in np.flatnonzero(~live):
                out[rows[r]] = ids[r][ids[r] >= 0]
            if not live.any():
                return out
            ids, rank, new, rows, at = ids[live], rank[live], new[live], rows[live], at[live]  # compaction of ended rows
            r = np.arange(len(ids))
            take = np.arange(width - 1)[None, :]
            take = take + (take > at[:, None])
            made = new[r, at]
            ids = np.take_along_axis(ids, take, 1)
            ids[r, at] = made
            if width == 2:
                rank, new = np.full((len(ids), 0), _NONE, np.int32), np.zeros((len(ids), 0), np.int32)
                continue
            rank, new = (np.take_along_axis(x, take[:, : width - 2], 1) for x in (rank, new))
            for shift in (-1, 0):  # only the two pairs beside the merged id are new
                col = at + shift
                ok = (col >= 0) & (col < width - 2)
                rr, cc = r[ok], col[ok]
                rank[rr, cc], new[rr, cc] = self._pairs(ids[rr, cc], ids[rr, cc + 1])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, new = self.table.find((a << 20) | (b & 0xFFFFF))
        rank[(a < 0) | (b < 0)] = _NONE
        return rank, new

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: each round merges all places of its minimum-rank pair, from the left; only the pairs beside them are looked up anew."""
        ids = ids.astype(np.int64)
        rank, new = self._pairs(ids[:-1], ids[1:])
        while len(ids) > 1:
            least = rank.min()
            if least == _NONE:
                break
            at = np.flatnonzero(rank == least)
            if not self.ordered:
                at = at[:1]
            elif len(at) > 1 and (np.diff(at) == 1).any():  # overlaps, as in aaa: every second one of a run
                start = np.r_[True, np.diff(at) != 1]
                first = at[start][np.cumsum(start) - 1]
                at = at[(at - first) % 2 == 0]
            ids[at] = new[at[0]]
            ids, rank, new = np.delete(ids, at + 1), np.delete(rank, at), np.delete(new, at)
            made = at - np.arange(len(at))  # where the merged ids stand now
            beside = np.unique(np.concatenate([made - 1, made]))
            beside = beside[(beside >= 0) & (beside < len(ids) - 1)]
            rank[beside], new[beside] = self._pairs(ids[beside], ids[beside + 1])
        return ids

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: dict[str, list[int]] = {}
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > _LONG:
                out[pieces[i]] = self._long(self.byte_ids[np.frombuffer(b, np.uint8)]).tolist()
            else:
                buckets.setdefault(len(b) if len(b) < 8 else 8 << ((len(b) - 1) >> 3).bit_length(), []).append(i)
        for idx in buckets.values():
            for lo in range(0, len(idx), 4096):
                part = idx[lo : lo + 4096]
                wide = max(len(raw[i]) for i in part)
                flat = np.frombuffer(b"".join(raw[i].ljust(wide, b"\0") for i in part), np.uint8).reshape(len(part), wide)
                ids = self.byte_ids[flat].astype(np.int64)
                ids[np.arange(wide)[None, :] >= np.array([len(raw[i]) for i in part])[:, None]] = -1
                for i, x in zip(part, self._rounds(ids)):
                    out[pieces[i]] = x.tolist()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text without special tokens; a null and an empty text give the empty list."""
        cut = [self.split(t) if t else [] for t in texts]
        known = self.known
        fresh = {p for ps in cut for p in ps if p not in known}
        if len(known) + len(fresh) > _KEPT:
            known.clear()
            fresh = {p for ps in cut for p in ps}
        new = self.encode_pieces(list(fresh))
        known.update(new)
        result = []
        for ps in cut:
            ids: list[int] = []
            for p in ps:
                ids += known[p]
            result.append(ids)
        if len(known) > 2 * _KEPT:
            known.clear()
        return result


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str, text: str | None = None) -> ByteBpe:
    """The encoder of a vocabulary file, made once a process; ``text`` is the file's content where the file itself may not be there."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path, text)
    return _loaded[path]


def encode_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", tokenizer_dir: str | None = None
) -> DataFrame:
    """(doc_id, ids array<int>): every row of ``documents`` with the ids of its whole text, without special tokens.

    Defined results: null and empty texts give an empty array; the written forms of special tokens in a text are ordinary text; repeated
    rows are encoded each; an empty table gives an empty result. Extra columns are ignored. One narrow stage, no shuffle.
    The vocabulary file ``name``.json is read from ``tokenizer_dir`` (default: the environment's HUNKMILL_TOKENIZER_DIR) at the driver and sent
    to the workers, about 2 MB; a file of another kind of tokenizer is refused.
    """
    path = os.path.join(tokenizer_dir or TOKENIZER_DIR, f"{name}.json")
    with open(path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches):
        import pyarrow as pa

        model = loaded(path, shared.value)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 512):  # bounds what one step holds, whatever the batch size
                ids = model.encode(texts.slice(lo, 512).to_pylist())
                flat = np.fromiter((i for x in ids for i in x), np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 512), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"]
                )

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(encode, f"doc_id {kind}, ids array<int>")
