"""Patterns against hunks and lines: how often a pattern could apply and did, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T
from hunkmill.plans.order import running_sum

#: Patterns whose texts one broadcast holds; more patterns are counted in further passes over the hunks.
SLICE = 100_000


class _Texts:
    """Finds which of many short texts stand in a long one: an Aho-Corasick automaton where the library is there, else one search a text."""

    def __init__(self, texts: list[str]):
        self.texts, self.machine = texts, None
        try:
            import ahocorasick
        except ImportError:
            return
        machine = ahocorasick.Automaton()
        for i, t in enumerate(texts):
            if t:
                machine.add_word(t, i)
        if len(machine):
            machine.make_automaton()
            self.machine = machine

    def find(self, text: str) -> set[int]:
        if self.machine is None:
            return {i for i, t in enumerate(self.texts) if t and t in text}
        return {i for _, i in self.machine.iter(text)}


def confidence(patterns: DataFrame, hunks: DataFrame, condition: str = "condition", consequent: str = "consequent", slice_rows: int = SLICE) -> DataFrame:
    """(pattern, triggered, changed, confidence): of the hunks whose old side holds all ``-`` and ``=`` texts of the pattern, those whose new side
    holds all its ``+`` and ``=`` texts, and the unrounded ratio (0.0 if none is triggered).

    The distinct patterns are the stated query set: they are numbered, read in slices of ``slice_rows`` and broadcast; the hunks are read where
    they lie, once a slice. A hunk is searched for all texts of a slice in one pass; a pattern is looked at only if its rarest text was found,
    and each task gives one sum a pattern. Null patterns are left out; null sides and lines are empty.
    """
    spark = hunks.sparkSession
    unique = patterns.filter("pattern is not null").select("pattern").distinct()
    unique = unique.select("pattern", T.wanted_before(F.col("pattern")).alias("before"), T.wanted_after(F.col("pattern")).alias("after"))
    sides = hunks.select(T.joined(F.col(condition)).alias("before"), T.joined(F.col(consequent)).alias("after"))
    result, held = None, []

    def counted(part: list[tuple[list[str], list[str], list[str]]]) -> DataFrame:
        texts = {t: i for i, t in enumerate(dict.fromkeys(t for _, b, a in part for t in (*b, *a)))}
        coded = [([texts[t] for t in b], [texts[t] for t in a]) for _, b, a in part]
        shared = spark.sparkContext.broadcast((list(texts), coded, [p for p, _, _ in part]))

        def search(batches):
            import pyarrow as pa

            names, wanted, whole = shared.value
            finder = _Texts(names)
            use = [0] * len(names)
            for b, _ in wanted:
                for t in b:
                    use[t] += 1
            blank = next((i for i, t in enumerate(names) if not t), None)
            by_text: dict[int, list[int]] = {}
            for n, (b, _) in enumerate(wanted):
                if b:
                    by_text.setdefault(min(b, key=lambda t: (t == blank, use[t])), []).append(n)
            hit, did = [0] * len(wanted), [0] * len(wanted)
            for batch in batches:
                for before, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    left = finder.find(before) | ({blank} if blank is not None else set())
                    right = None
                    for t in left & by_text.keys():
                        for n in by_text[t]:
                            if left.issuperset(wanted[n][0]):
                                hit[n] += 1
                                if right is None:
                                    right = finder.find(after) | ({blank} if blank is not None else set())
                                did[n] += bool(wanted[n][1]) and right.issuperset(wanted[n][1])
            some = [n for n, k in enumerate(hit) if k]
            yield pa.RecordBatch.from_pydict(
                {"pattern": pa.array([whole[n] for n in some], pa.list_(pa.string())), "triggered": pa.array([hit[n] for n in some], pa.int64()), "changed": pa.array([did[n] for n in some], pa.int64())}
            )

        return sides.mapInArrow(search, "pattern array<string>, triggered bigint, changed bigint")

    for row in unique.toLocalIterator():
        held.append((list(row[0]), list(row[1]), list(row[2])))
        if len(held) == slice_rows:
            part, held = counted(held), []
            result = part if result is None else result.unionByName(part)
    if held:
        part = counted(held)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "pattern array<string>, triggered bigint, changed bigint, confidence double")
    sums = result.groupBy("pattern").agg(F.sum("triggered").alias("triggered"), F.sum("changed").alias("changed"))
    full = unique.select("pattern").join(sums, "pattern", "left").select("pattern", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("triggered", "changed")])
    return full.withColumn("confidence", F.coalesce(F.try_divide("changed", "triggered"), F.lit(0.0)))


def _literal(pattern: list[str]):
    return F.array(*[F.lit(t) for t in pattern]) if pattern else F.array().cast("array<string>")


def change_times(diffs: DataFrame, pattern: list[str], hunk: str = "diff_hunk") -> DataFrame:
    """(merged_at) of each row whose hunk has two sides that are not empty and to which the pattern applies and was applied."""
    p = _literal(pattern)
    before, after = T.joined(F.col(f"{hunk}.condition")), T.joined(F.col(f"{hunk}.consequent"))
    whole = (F.size(f"{hunk}.condition") > 0) & (F.size(f"{hunk}.consequent") > 0)
    return diffs.filter(whole & T.triggers(p, before) & T.applied(p, after)).select("merged_at")


def adoption(times: DataFrame, column: str = "merged_at") -> DataFrame:
    """(merged_at, adopted): for each time, how many changes there were up to and at it; null times are left out.

    Equal times are summed before the running sum, which goes by range partitions.
    """
    counts = times.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("merged_at")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, "n", "merged_at", name="adopted").select("merged_at", "adopted")


def yearly_occurrence(lines: DataFrame, pattern: list[str], year: str = "year", line: str = "line") -> DataFrame:
    """(year, old_lines, new_lines): lines that hold the old form of the pattern and lines that hold the new form, each on its own."""
    p = _literal(pattern)
    text = F.coalesce(line, F.lit(""))
    return lines.groupBy(F.col(year).alias("year")).agg(F.count_if(T.triggers(p, text)).alias("old_lines"), F.count_if(T.applied(p, text)).alias("new_lines"))
