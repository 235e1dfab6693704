"""Exact stratified train/test split without a window over the table.

Rows are ordered inside their label by (md5(key || '-' || salt), key); the
first round(test_share * n_label) rows are the test set. Where the order is cut
is found in two steps, both on Spark tables: counts per label and md5 prefix (at
most 65 536 rows a label) name the prefix that holds the cut, and only that
prefix's rows are ranked. The split itself compares every row with its label's
cut: the same rows as ``row_number() over (partition by label order by ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.lookup import checked_broadcast

PREFIX = 4  # hex digits of the first step


def split_hash(key: str, salt: int | str = 42) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{salt}")))


def split_cutoffs(df: DataFrame, label: str, key: str = "ROW_ID", shares: Sequence[float] = (0.2,),
                  salt: int | str = 42) -> DataFrame:
    """(_lab, j, _need, _ch, _ck): hash and key of the last row of the first
    round(share * n) rows of each label, for the j-th share; shares that round
    to no rows have no row here. Fails on a key that several rows of a label
    carry around a cut, where no cut by key can be exact."""
    base = df.select(F.col(label).alias("_lab"), F.col(key).alias("_key"), split_hash(key, salt).alias("_h"))
    base = base.withColumn("_p", F.substring("_h", 1, PREFIX))
    hist = base.groupBy("_lab", "_p").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy("_lab").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.select("_lab", "_p", "_c", F.sum("_c").over(run).alias("_to"), F.sum("_c").over(Window.partitionBy("_lab")).alias("_n"))
    needs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.expr(f"CAST(round(CAST('{s}' AS DECIMAL(20, 10)) * _n) AS BIGINT)").alias("need"))
                                for j, s in enumerate(shares)])).alias("_s")
    at = (cum.select("*", needs).where("_s.need > _to - _c AND _s.need <= _to")
          .select(F.col("_lab").alias("_lab2"), F.col("_p").alias("_p2"), F.col("_s.j").alias("j"), F.col("_s.need").alias("_need"),
                  (F.col("_s.need") - (F.col("_to") - F.col("_c"))).alias("_rank")))
    near = base.join(checked_broadcast(at), F.col("_lab").eqNullSafe(F.col("_lab2")) & (F.col("_p") == F.col("_p2")))
    w = Window.partitionBy("_lab", "_p", "j").orderBy("_h", "_key")
    picked = near.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("_key").over(w))
    cut = picked.where("_r = _rank").select("_lab", "j", "_need", F.col("_h").alias("_ch"), F.col("_key").alias("_ck"), 
                                            F.expr("_next <=> _key").alias("_tie"))
    cut = checked_broadcast(cut)
    if not cut.where("_tie").isEmpty():
        raise ValueError(f"{key} repeats: rows of one key would fall on both sides of the split")
    return cut.drop("_tie")


def _with_cuts(df: DataFrame, cut: DataFrame, label: str, key: str, salt: int | str) -> DataFrame:
    """Adds ``_below``: the smallest j whose cut the row does not exceed."""
    per = cut.groupBy("_lab").agg(F.sort_array(F.collect_list(F.struct("j", "_ch", "_ck"))).alias("_cuts"))  # one entry per share
    out = df.withColumn("_h", split_hash(key, salt)).join(checked_broadcast(per), F.col(label).eqNullSafe(F.col("_lab")), "left")
    inside = F.filter("_cuts", lambda c: (F.col("_h") < c["_ch"]) | ((F.col("_h") == c["_ch"]) & (F.col(key) <= c["_ck"])))
    return out.withColumn("_below", F.array_min(F.transform(inside, lambda c: c["j"]))).drop("_h", "_lab", "_cuts")


def add_split_column(df: DataFrame, label: str = "SUBSCRIPTION_STATUS", key: str = "ROW_ID",
                     test_share: float = 0.2, salt: int | str = 42, out: str = "part") -> DataFrame:
    return add_part(df, split_cutoffs(df, label, key, [test_share], salt), label, key, salt, out)


def add_part(df: DataFrame, cut: DataFrame, label: str = "SUBSCRIPTION_STATUS", key: str = "ROW_ID",
             salt: int | str = 42, out: str = "part") -> DataFrame:
    """``out`` = test for rows up to their label's cut (``split_cutoffs`` of one
    share), else train."""
    return (_with_cuts(df, cut, label, key, salt)
            .withColumn(out, F.when(F.col("_below").isNotNull(), F.lit("test")).otherwise(F.lit("train"))).drop("_below"))


def stratified_split(df: DataFrame, label: str = "SUBSCRIPTION_STATUS", key: str = "ROW_ID",
                     test_share: float = 0.2, salt: int | str = 42):
    """(train, test) with exactly round(test_share * n) test rows per label."""
    parts = add_split_column(df, label, key, test_share, salt, "_part")
    return parts.where("_part = 'train'").drop("_part"), parts.where("_part = 'test'").drop("_part")


def fold_column(df: DataFrame, label: str, key: str = "ROW_ID", folds: int = 5,
                salt: int | str = 42, out: str = "fold") -> DataFrame:
    """Stratified fold id 0..folds-1: inside each label, rows in hash order are
    dealt to folds in contiguous runs ending at round(j/folds * n_label). All
    cuts come from one pass."""
    cut = split_cutoffs(df, label, key, [j / folds for j in range(1, folds)], salt)
    return (_with_cuts(df, cut, label, key, salt)
            .withColumn(out, F.coalesce(F.col("_below"), F.lit(folds - 1)).cast("int")).drop("_below"))
