"""Join of a large table with one-row-per-key facts, where a few keys may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than
# HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 10_000


def join_counted(big: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``facts`` (one row per key) on ``keys``.

    ``facts[count]`` is the number of rows of ``big`` with that key. Facts of hot keys,
    fewer than ``HOT_SHARE`` by definition, are broadcast, so rows of hot keys stay where
    they are; all other rows take a shuffle join in which no key is large.
    """
    keys = list(keys)
    total = facts.agg(F.sum(count).alias("t")).scalar()
    is_hot = F.coalesce(F.col(count) * F.lit(HOT_SHARE) > total, F.lit(False))
    hot, cold = facts.where(is_hot), facts.where(~is_hot)
    on_hot = big.join(F.broadcast(hot), keys)
    on_cold = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return on_hot.unionByName(on_cold)
