"""Frequent ordered token patterns, with gaps, across many entities: pivot-item partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.plans.lineage import cut
from hunkmill.plans.order import indexed
from hunkmill.plans.skew import HOT_SHARE, attach_by_key

#: Words of a line, with the sign of the side they stand on.
TOKEN = "[A-Za-z_][A-Za-z0-9_]*"

BLOCK_ROWS = 150_000  # distinct sequences of one block of a pivot's partition, on average: bounds what a task holds, at any size of the data
HOT_ROWS = 20_000  # an entity with more distinct sequences than this is spread over tasks
CANDIDATES = 200_000  # candidate patterns that one broadcast holds; more are counted in further passes
DICTIONARY = 200_000  # frequent items that one broadcast holds; with more, sequences are coded by a join


def signed_tokens(hunk: str = "diff_hunk"):
    """Array of the signed tokens of a hunk: ``-word`` for condition, then ``+word`` for consequent; null lines and sides give none."""

    def side(name: str, sign: str):
        lines = F.filter(F.coalesce(F.col(f"{hunk}.{name}"), F.array().cast("array<string>")), lambda x: x.isNotNull())
        words = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(f"({TOKEN})"), F.lit(1))
        return F.transform(words, lambda w: F.concat(F.lit(sign), w))

    return F.concat(side("condition", "-"), side("consequent", "+"))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _reduced(values, lengths, entities, n_items, least, size):
    """Keep the items that occur in at least ``least`` entities, then the sequences of ``size`` items or more."""
    while len(lengths):
        rows = np.repeat(np.arange(len(lengths)), lengths)
        key = np.unique(entities[rows].astype(np.int64) * n_items + values)
        keep = (np.bincount(key % n_items, minlength=n_items) >= least)[values]
        if keep.all() and (lengths >= size).all():
            break
        values, rows = values[keep], rows[keep]
        lengths = np.bincount(rows, minlength=len(lengths))
        long = lengths >= size
        values = values[long[rows]]
        lengths, entities = lengths[long], entities[long]
    return values, lengths, entities


def _once(values, lengths, entities):
    """Each (entity, sequence) once; sequences of one length are compared together, so none is padded."""
    starts = np.cumsum(lengths) - lengths
    keep = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        flat = values[_spread(starts[rows], lengths[rows])].reshape(len(rows), n)
        keep.append(rows[np.unique(np.column_stack([entities[rows], flat]), axis=0, return_index=True)[1]])
    rows = np.sort(np.concatenate(keep)) if keep else np.zeros(0, np.int64)
    return values[_spread(starts[rows], lengths[rows])], lengths[rows], entities[rows]


class _Places:
    """Where each item stands in the sequences of a block, laid end to end: ``after`` finds an item's next place in many sequences at once."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        order = np.argsort(values, kind="stable")
        self.names, first = np.unique(values[order], return_index=True)
        self.of = dict(zip(self.names.tolist(), np.split(order, first[1:])))

    def after(self, item: int, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows, those in which ``item`` stands at ``at`` or later, and the place behind it."""
        places = self.of.get(item)
        if places is None:
            return rows[:0], at[:0]
        k = np.searchsorted(places, at)
        found = places[np.minimum(k, len(places) - 1)]
        ok = (k < len(places)) & (found < self.end[rows])
        return rows[ok], found[ok] + 1


def mine_block(values: np.ndarray, lengths: np.ndarray, entities: np.ndarray, pivot: int, least: int, min_len: int, max_len: int):
    """Patterns of ``min_len`` to ``max_len`` items that contain ``pivot`` and occur in at least ``least`` entities: (items, support).

    Depth-first projection over flat arrays, without padding, so one very long sequence costs its own length: a node holds the rows that
    contain the prefix and the place behind its first occurrence; a prefix without the pivot keeps only the rows in which the pivot still
    follows, so no other pattern is enumerated.
    """
    out: list[tuple[tuple[int, ...], int]] = []
    if not len(lengths):
        return out
    n_items = int(values.max()) + 1
    entities = np.unique(entities, return_inverse=True)[1]
    values, lengths, entities = _once(*_reduced(values, lengths, entities, n_items, least, min_len))
    places = _Places(values, lengths)
    if pivot not in places.of:
        return out
    ent = np.unique(entities, return_inverse=True)[1]
    local = np.searchsorted(places.names, values)
    n_local, n_ent = len(places.names), int(ent.max()) + 1
    mine = places.of[pivot]
    k = np.searchsorted(mine, places.end)  # behind the last pivot of each row
    last = np.where(k > 0, mine[np.maximum(k - 1, 0)], -1)
    last = np.where(last >= places.start, last + 1, places.start)

    def supports(rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = np.maximum(end - at, 0)
        key = np.repeat(ent[rows], n).astype(np.int64) * n_local + local[_spread(at, n)]
        if n_ent * n_local <= 4_000_000:
            seen = np.zeros(n_ent * n_local, bool)
            seen[key] = True
            return seen.reshape(n_ent, n_local).sum(0)
        return np.bincount(np.unique(key) % n_local, minlength=n_local)

    def grow(prefix: tuple[int, ...], rows: np.ndarray, at: np.ndarray, has: bool) -> None:
        counts = supports(rows, at, places.end[rows] if has else last[rows])
        for x in np.flatnonzero(counts >= least):
            item = int(places.names[x])
            inner, new = places.after(item, rows, at)
            now = has or item == pivot
            if not now:
                still = last[inner] > new
                inner, new = inner[still], new[still]
                if len(np.unique(ent[inner])) < least:
                    continue
            items = (*prefix, item)
            if now and len(items) >= min_len:
                out.append((items, int(counts[x])))
            if len(items) < max_len:
                grow(items, inner, new, now)

    grow((), np.arange(len(lengths)), places.start.copy(), False)
    return out


def _containing(values, lengths, patterns: list[tuple[int, ...]]):
    """(pattern, rows that contain it) of each pattern, by shared prefixes."""
    places = _Places(values, lengths)
    known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {(): (np.arange(len(lengths)), places.start.copy())}
    for pattern in sorted(set(patterns)):
        for k in list(known):
            if k != pattern[: len(k)]:
                del known[k]
        for n in range(1, len(pattern) + 1):
            if pattern[:n] not in known:
                known[pattern[:n]] = places.after(pattern[n - 1], *known[pattern[: n - 1]])
        yield pattern, known[pattern][0]


def count_block(values, lengths, entities, patterns: list[tuple[int, ...]]) -> list[int]:
    """Exact number of entities with a sequence that contains each pattern."""
    if not len(lengths) or not patterns:
        return [0] * len(patterns)
    held = {p: len(np.unique(entities[rows])) for p, rows in _containing(values, lengths, patterns)}
    return [held[p] for p in patterns]


def _arrays(table):
    seq = table.column("seq").combine_chunks()
    if hasattr(seq, "chunks"):
        seq = seq.chunk(0) if seq.num_chunks else None
    values = seq.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(seq.offsets.to_numpy()).astype(np.int64)
    return values, lengths, table.column("entity").to_numpy()


def _coded(rows: DataFrame, frequent: DataFrame, n_frequent: int, min_len: int) -> DataFrame:
    """(entity, seq array<int>) of the sequences with ``min_len`` or more frequent items, as item numbers; each (entity, seq) once."""
    if n_frequent <= DICTIONARY:
        names = [r[1] for r in sorted(frequent.select("id", "item").collect())]
        shared = rows.sparkSession.sparkContext.broadcast(names)

        def code(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            order = pa.array(shared.value)
            for b in batches:
                items = b.column(1)
                at = pc.index_in(items.flatten(), order)
                keep = pc.is_valid(at).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(keep)])[items.offsets.to_numpy() - items.offsets[0].as_py()].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), at.drop_null().cast(pa.int32()))], ["entity", "seq"])

        seqs = rows.mapInArrow(code, "entity bigint, seq array<int>")
    else:
        at = rows.withColumn("_row", F.monotonically_increasing_id()).select("entity", "_row", F.posexplode("tokens").alias("pos", "item"))
        seqs = at.join(frequent, "item").groupBy("entity", "_row").agg(F.sort_array(F.collect_list(F.struct("pos", "id")))["id"].alias("seq")).drop("_row")
    return cut(seqs.filter(F.size("seq") >= min_len).distinct())


def _pivoted(seqs: DataFrame, min_len: int, *more) -> DataFrame:
    """Each sequence once for each item in it as pivot, cut to the items that rank no lower than the pivot."""
    rows = seqs.select("entity", "seq", *more, F.explode(F.array_distinct("seq")).alias("pivot"))
    kept = rows.withColumn("seq", F.filter("seq", lambda x: x <= F.col("pivot")))
    return kept.filter(F.size("seq") >= min_len)


def frequent_patterns(
    sequences: DataFrame,
    entity: str = "entity",
    tokens: str = "tokens",
    min_support=lambda n_entities: max(8, -(-3 * n_entities // 100)),
    min_len: int = 3,
    max_len: int = 5,
    n_entities: int | None = None,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = HOT_ROWS,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """(pattern array<string>, support bigint): ordered patterns, gaps allowed, that occur in at least ``min_support`` entities.

    An entity supports a pattern if one of its sequences contains the pattern's items in order. ``min_support`` maps the number of
    entities (``n_entities``, else the distinct non-null values of ``entity``) to the least support.

    1. Items are counted by distinct (entity, item) and ranked by support; infrequent items leave the sequences, and each (entity, sequence)
       stays once.
    2. Each sequence sends, for every frequent item in it as pivot, its items that rank no lower than the pivot to the pivot's partition.
    3. A pivot's partition is split by entity into blocks of ``block_rows`` sequences on average (fewer blocks where a block's share of the
       support would fall under 4). A block mines the patterns that contain its pivot, with its share of the support; a pattern that is
       frequent overall reaches that share in some block.
    4. Supports of candidates that some blocks did not report are counted exactly in those blocks' sequences, and all are summed. The
       candidates are broadcast, ``candidates`` at a time.
    5. Entities with more than ``hot_rows`` distinct sequences are spread over tasks by sequence, in as many parts as their rows need; as each
       adds at most 1 to a support, candidates are mined with the support less by their number and then counted. Where they are more than
       half the support, half of it is asked of the others, and the patterns that have the other half among the hot entities are mined from
       their sequences, level by level, and counted too.

    The support should grow with the data, as the default does: a small absolute one over very many entities leaves blocks with little to
    prune by. Entities travel as 64-bit hashes. Rows with a null entity, null or empty sequences give nothing; null items are left out;
    repeated rows change nothing; empty tables give an empty result; extra columns are ignored.
    """
    spark = sequences.sparkSession
    rows = sequences.select(F.col(entity).alias("entity"), F.filter(F.col(tokens), lambda x: x.isNotNull()).alias("tokens"))
    rows = rows.filter("entity is not null")
    if n_entities is None:
        n_entities = rows.select("entity").distinct().count()
    least = max(1, int(min_support(n_entities)))
    rows = rows.filter(F.size("tokens") >= min_len).select(F.xxhash64("entity").alias("entity"), "tokens")
    # 1. ranks
    pairs = rows.select("entity", F.explode(F.array_distinct("tokens")).alias("item")).distinct()
    often = cut(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    n_frequent = often.count()
    if not n_frequent:
        return spark.createDataFrame([], "pattern array<string>, support bigint")
    ranks = cut(indexed(often, F.desc("n"), "item", name="id").select("item", F.col("id").cast("int").alias("id")))
    seqs = _coded(rows, ranks, n_frequent, min_len)
    total = seqs.count()
    # 5. hot entities
    hot = cut(seqs.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows))
    n_hot, hot_total = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cold, spread = seqs, None
    if n_hot:
        spread = cut(attach_by_key(seqs, hot, "entity", "n", total))
        cold = cut(_without(seqs, hot, total))
    n_blocks = max(1, min(-(-(total - hot_total) // block_rows), least // 4))
    block = F.pmod(F.xxhash64("entity"), F.lit(n_blocks)).cast("int")
    # 2. pivots
    pivots = _pivoted(cold, min_len, block.alias("block"))
    if n_blocks > 1 or n_hot:
        pivots = cut(pivots)
    # a block has its share of the entities that carry sequences
    shares = {r[0]: r[1] for r in cold.select("entity").distinct().groupBy(block.alias("block")).agg(F.count(F.lit(1))).collect()}
    everyone = max(1, sum(shares.values()))
    alone = 2 * n_hot > least
    low = -(-least // 2) if alone else least - n_hot
    local = spark.sparkContext.broadcast({b: max(1, -(-low * n // everyone)) for b, n in shares.items()})

    def mine(key, tab):
        import pyarrow as pa

        pivot, b = key[0].as_py(), key[1].as_py()
        share = local.value[b]
        found = mine_block(*_arrays(tab), pivot, share, min_len, max_len)
        one = lambda x, t: pa.array([x] * len(found), t)
        return pa.table({"pivot": one(pivot, pa.int32()), "block": one(b, pa.int32()), "items": pa.array([list(i) for i, _ in found], pa.list_(pa.int32())),
                         "n": pa.array([n for _, n in found], pa.int64()), "below": one(share - 1, pa.int64())})

    mined = pivots.groupBy("pivot", "block").applyInArrow(mine, "pivot int, block int, items array<int>, n bigint, below bigint")
    if n_blocks == 1 and not n_hot:
        return _named(mined.select("items", "n"), ranks, least)
    mined = cut(mined)
    # 4. what the blocks did not report is below their share each: candidates whose bound stays under the support are out
    slack = sum(s - 1 for s in local.value.values())
    cand = mined.groupBy("pivot", "items").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    bound = F.col("n") + F.lit(slack) - F.col("below") >= low
    if alone:
        # n < low among the others leaves at least this many to the hot entities
        extra = _level_wise(spread, least - low + 1, min_len, max_len)
        extra = extra.select(F.array_max("items").alias("pivot"), "items", F.lit(True).alias("extra"))
        cand = cand.join(extra, ["pivot", "items"], "full").filter(bound | F.col("extra"))
        cand = cand.select("pivot", "items", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    else:
        cand = cand.filter(bound).select("pivot", "items", "n")
    cand = cut(cand)
    parts = cand.select("items", "n")
    slices = max(1, -(-cand.count() // candidates))
    salts = max(1, -(-hot_total // hot_rows))
    salted = _pivoted(spread, min_len, F.pmod(F.xxhash64("entity", "seq"), F.lit(salts)).alias("salt")) if n_hot else None
    if salted is not None:
        salted = cut(salted)
    for k in range(slices):
        by_pivot: dict[int, list[tuple[int, ...]]] = {}
        for r in cand.filter(F.pmod(F.xxhash64("items"), F.lit(slices)) == k).select("pivot", "items").toLocalIterator():
            by_pivot.setdefault(r[0], []).append(tuple(r[1]))
        wanted = spark.sparkContext.broadcast(by_pivot)
        more = pivots.groupBy("pivot", "block").cogroup(mined.groupBy("pivot", "block")).applyInArrow(_counter(wanted), "items array<int>, n bigint")
        parts = parts.unionByName(more)
        if salted is None:
            continue
        in_hot = salted.groupBy("pivot", "salt").applyInArrow(_holder(wanted), "items array<int>, entity bigint").distinct()
        parts = parts.unionByName(in_hot.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    return _named(parts, ranks, least)


def _counter(wanted):
    """Counts, in a block, the candidates of its pivot that the block did not report."""

    def count(key, left, right):
        import pyarrow as pa

        told = set(map(tuple, right.column("items").to_pylist()))
        items = [x for x in wanted.value.get(key[0].as_py(), ()) if x not in told]
        ns = count_block(*_arrays(left), items) if left.num_rows else [0] * len(items)
        some = [(list(i), n) for i, n in zip(items, ns) if n]
        return pa.table({"items": pa.array([i for i, _ in some], pa.list_(pa.int32())), "n": pa.array([n for _, n in some], pa.int64())})

    return count


def _holder(wanted):
    """Which hot entities have, among the sequences of one part, one that contains a candidate of the pivot."""

    def held(key, tab):
        import pyarrow as pa

        values, lengths, ent = _arrays(tab)
        items, entities = [], []
        for pattern, found in _containing(values, lengths, wanted.value.get(key[0].as_py(), ())):
            some = np.unique(ent[found]).tolist()
            items += [list(pattern)] * len(some)
            entities += some
        return pa.table({"items": pa.array(items, pa.list_(pa.int32())), "entity": pa.array(entities, pa.int64())})

    return held


def _without(rows: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """The rows whose entity is not in ``keyed``: the few that hold over 1/HOT_SHARE of all rows go by a broadcast, the others by a shuffle."""
    limit = max(1, total // HOT_SHARE)
    large, small = keyed.filter(F.col("n") > limit).select("entity"), keyed.filter(F.col("n") <= limit).select("entity")
    return rows.join(F.broadcast(large), "entity", "left_anti").join(small, "entity", "left_anti")


def _level_wise(spread: DataFrame, need: int, min_len: int, max_len: int) -> DataFrame:
    """(items array<int>) of the patterns that at least ``need`` entities of ``spread`` hold, each sequence read where it lies.

    Level k extends, in every sequence, the frequent patterns of level k - 1 at their leftmost end; supports are counted by distinct entity.
    """
    spark = spread.sparkSession
    spread = cut(spread)
    levels: list[set[tuple[int, ...]]] = []
    out = spark.createDataFrame([], "items array<int>")
    for k in range(1, max_len + 1):
        shared = spark.sparkContext.broadcast(levels)

        def extend(batches, shared=shared):
            import pyarrow as pa

            known = shared.value
            for b in batches:
                held: set[tuple[int, tuple[int, ...]]] = set()
                for one, seq in zip(b.column("entity").to_pylist(), b.column("seq").to_pylist()):
                    ends: dict[tuple[int, ...], int] = {(): 0}
                    for level in [*known, None]:
                        new: dict[tuple[int, ...], int] = {}
                        for p, end in ends.items():
                            for at in range(end, len(seq)):
                                new.setdefault((*p, seq[at]), at + 1)
                        ends = new if level is None else {p: e for p, e in new.items() if p in level}
                    held.update((one, p) for p in ends)
                rows = list(held)
                yield pa.RecordBatch.from_pydict({"entity": pa.array([e for e, _ in rows], pa.int64()), "items": pa.array([list(p) for _, p in rows], pa.list_(pa.int32()))})

        found = spread.select("entity", "seq").mapInArrow(extend, "entity bigint, items array<int>").distinct()
        found = cut(found.groupBy("items").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).select("items"))
        if k >= min_len:
            out = out.unionByName(found)
        if k < max_len:
            levels = [*levels, {tuple(r[0]) for r in found.toLocalIterator()}]
            if not levels[-1]:
                break
    return out


def _named(counts: DataFrame, ranks: DataFrame, least: int) -> DataFrame:
    """Sums by pattern, those of at least ``least``, with the items' names."""
    sums = counts.groupBy("items").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
    at = sums.select("items", "support", F.posexplode("items").alias("pos", "id")).join(ranks, "id")
    named = at.groupBy("items", "support").agg(F.sort_array(F.collect_list(F.struct("pos", "item")))["item"].alias("pattern"))
    return named.select("pattern", "support")


def change_patterns(diffs: DataFrame, min_len: int = 3, max_len: int = 5, **options) -> DataFrame:
    """Patterns of signed tokens over the changes of ``diffs``; rows without a change_id are left out. See ``frequent_patterns``."""
    rows = diffs.filter("change_id is not null").select("change_id", signed_tokens().alias("tokens"))
    return frequent_patterns(rows, "change_id", "tokens", min_len=min_len, max_len=max_len, **options)
