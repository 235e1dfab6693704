"""Joining small derived tables (statistics per group, vocabularies) back.

A derived table is shipped to every task only after its row count has been
checked against ``bound``; beyond the bound the join stays a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_BOUND = 20_000


def bounded_rows(df: DataFrame, bound: int = LOOKUP_BOUND):
    """The rows of ``df`` if there are at most ``bound``, else None."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def checked_broadcast(small: DataFrame, bound: int = LOOKUP_BOUND) -> DataFrame:
    """``small`` as a broadcast local table when its size is proven <= bound,
    else ``small`` unchanged (the caller's join then shuffles). A table that
    has been checked is returned as it is."""
    if getattr(small, "_checked", False):
        return small
    rows = bounded_rows(small, bound)
    if rows is None:
        out = small.select("*")
    else:
        out = F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))
    out._checked, out._is_small = True, rows is not None
    return out


def lookup_join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
                bound: int = LOOKUP_BOUND) -> DataFrame:
    """Equi lookup of ``small`` on ``keys`` (null keys never match)."""
    return df.join(checked_broadcast(small, bound), list(keys), how)
