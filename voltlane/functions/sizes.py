"""Broadcast hints behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to have at most ``max_rows`` rows.

    Beyond the bound the join is an ordinary shuffle join (:func:`shuffled`), which Spark
    may split for skew at run time.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint a join by shuffle, for tables that grow with the data.

    Without it Spark goes by its estimate, which follows compressed files and the types of
    columns: behind a text or a list it can be a hundredth of the rows' size, and the
    driver would collect them all for a broadcast.
    """
    return df.hint("merge")
