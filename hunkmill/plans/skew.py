"""Joining rows to per-key results when one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least 1/HOT_SHARE of all rows: there are at most HOT_SHARE such keys, at any size.
HOT_SHARE = 200


def attach_by_key(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``keyed`` (one row a ``key``, with the number of rows it has in ``count``).

    Hot keys, at most ``HOT_SHARE`` by the pigeonhole principle, go by a broadcast; each other key holds less than 1/``HOT_SHARE``
    of the ``total`` rows and goes by a shuffle. Rows with a null key are dropped, as in any inner join.
    """
    limit = max(1, total // HOT_SHARE)
    cold = keyed.filter(F.col(count) <= limit).drop(count)
    if total <= HOT_SHARE:
        return rows.join(keyed.drop(count), key)
    hot = keyed.filter(F.col(count) > limit).drop(count)
    hot_keys = hot.select(key)
    by_broadcast = rows.join(F.broadcast(hot), key)
    by_shuffle = rows.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key)
    return by_broadcast.unionByName(by_shuffle)
