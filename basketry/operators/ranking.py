"""Row positions and running sums inside groups, safe against huge groups.

``row_number() over (partition by g order by o)`` sends every row of a group to
one task; if one group holds a third of the table, so does one task. Here the
rows are range-partitioned by (group, order columns), which cuts a large group
wherever its rows lie, and written once; positions (or sums) are taken inside
(group, range) and shifted by the totals of the group's earlier ranges, of
which there are at most as many as partitions. Rows that agree in group and
order columns share a range, so the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import materialize

#: Rows of a group that one task may sort in a plain window.
LARGE_GROUP = 100_000


def _ranged(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [*[F.col(g) for g in group_cols], *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *keys).withColumn("_b", F.spark_partition_id()), "ranges")


def _earlier(totals: DataFrame, group_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Totals of the group's earlier ranges (``_o_<col>``); one row per (group, range)."""
    w = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*[F.col(g).alias("_g_" + g) for g in group_cols], F.col("_b").alias("_b2"),
                         *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias("_o_" + c) for c in cols])


def _shifted(df: DataFrame, offs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    on = F.col("_b") == F.col("_b2")
    for g in group_cols:
        on = on & F.col(g).eqNullSafe(F.col("_g_" + g))
    return df.join(offs, on).drop("_b", "_b2", *["_g_" + g for g in group_cols])


def row_number_in_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                        out: str) -> DataFrame:
    """1-based position of each row inside its group under a total order. Where
    no group has more than ``LARGE_GROUP`` rows, the plain window."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    large = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE_GROUP)
    if large.isEmpty():
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order_cols)))
    ranged = _ranged(df, group_cols, [F.col(c) for c in order_cols])
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy(*order_cols)))
    sizes = ranged.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_m"))
    return (_shifted(local, _earlier(sizes, group_cols, ["_m"]), group_cols)
            .withColumn(out, (F.col("_r") + F.col("_o__m")).cast("int")).drop("_r", "_o__m"))


def running_sums(df: DataFrame, group_cols: Sequence[str], order_col: str, cols: Sequence[str],
                 descending: bool = False, inclusive: bool = True, prefix: str = "cum_") -> DataFrame:
    """Running sums of ``cols`` inside each group in ``order_col`` order (one
    row per order value and group)."""
    group_cols, cols = list(group_cols), list(cols)
    order = F.desc(order_col) if descending else F.asc(order_col)
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    ranged = _ranged(df, group_cols, [order])
    w = Window.partitionBy(*group_cols, "_b").orderBy(order).rowsBetween(*frame)
    local = ranged.withColumns({"_l_" + c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in cols})
    totals = ranged.groupBy(*group_cols, "_b").agg(*[F.sum(c).alias(c) for c in cols])
    out = _shifted(local, _earlier(totals, group_cols, cols), group_cols)
    out = out.withColumns({prefix + c: F.col("_l_" + c) + F.col("_o_" + c) for c in cols})
    return out.drop(*["_l_" + c for c in cols], *["_o_" + c for c in cols])
