"""The pipeline from diff rows to filtered patterns, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import files as P
from hunkmill.operators import diffing, mining, patterns
from hunkmill.plans.lineage import cut


def sequences_of(diffs: DataFrame, language: str = "Python", max_lines: int = 5) -> DataFrame:
    """(period, tokens): hunks routed, abstracted and turned to signed token sequences, with the yearly period of their merge."""
    hunks = diffing.routed_hunks(diffs.select("file_name", "merged_at", "diff_hunk"), language, max_lines)
    return diffing.token_sequences(hunks.select(P.period_of(F.col("merged_at")).alias("period"), "diff_hunk")).select("period", "tokens")


def mine(diffs: DataFrame, min_support: int = 10, cap: int = 15, max_len: int | None = None, scope: str = "period_then_global") -> dict[str, DataFrame]:
    """Sequences, patterns a period, and the stages of ``patterns.filter_patterns``."""
    sequences = cut(sequences_of(diffs))
    found = cut(mining.mine_periods(sequences, min_support=min_support, cap=cap, max_len=max_len))
    return {"sequences": sequences, "periods": found, **patterns.filter_patterns(found, scope)}
