"""Exact quantiles as a table, for any number of groups and distinct values.

One scan makes a KLL sketch per group, which brackets every wanted rank between
two values; a second scan counts what lies below each bracket and sorts only
what lies inside. Small groups are bracketed by their extremes. Where there are
too many groups for a lookup, or a sketch was off by more than its bound, rows
are counted per (group, value) and ranked by running counts over range
partitions instead, so no group ever meets in one task. ``approx=True`` gives the sketch's own values.

Interpolation is the linear rule shared by pandas, Spark ``percentile`` and
DuckDB ``quantile_cont``: h = (n-1)p, v = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.lookup import bounded_rows, checked_broadcast
from basketry.operators.ranking import running_sums

#: Sketch size, and what a value's rank may be off by (a share of the rows, at
#: 99 % confidence: the library's bound for that size, 2.296 / k^0.9021).
SKETCH_K = 800
RANK_ERROR = 2.296 / SKETCH_K ** 0.9021
#: Groups of fewer rows are searched whole.
SMALL_GROUP = 10_000
#: Brackets marked in one long.
BITS = 60


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """(by..., q0, q1, ...): the quantile of the non-null values of ``col`` for
    each probability, one row per group that has values. With ``approx`` the
    values are those of a sketch, and ``rank_error`` says by what share of the
    group's rows their ranks may be off."""
    wanted, by = list(by), list(by) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    sketched = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.kll_sketch_agg_double("_x", F.lit(SKETCH_K)).alias("_sk"))

    def at(p):
        inner = F.kll_sketch_get_quantile_double("_sk", F.lit(float(min(1.0, max(0.0, p)))))
        return F.col("_min") if p <= 0 else F.col("_max") if p >= 1 else inner

    if approx:
        return sketched.select(*wanted, *[at(p).alias(f"q{i}") for i, p in enumerate(probs)], F.lit(RANK_ERROR).alias("rank_error"))
    small = F.col("_n") < SMALL_GROUP
    ends = [F.struct(F.when(small, F.col("_min")).otherwise(at(p - 2 * RANK_ERROR)).alias("a"), F.when(small, F.col("_max")).otherwise(at(p + 2 * RANK_ERROR)).alias("b")) for p in probs]
    brackets = bounded_rows(sketched.select(*by, "_n", F.array(*ends).alias("_e")))
    found = None if brackets is None else _inside(rows, brackets, probs, by)
    if found is None:
        return _by_counts(rows, probs, by).select(*wanted, *[f"q{i}" for i in range(len(probs))])
    schema = rows.select(*by).schema
    for i in range(len(probs)):
        schema = schema.add(f"q{i}", "double")
    return df.sparkSession.createDataFrame(found, schema).select(*wanted, *[f"q{i}" for i in range(len(probs))])


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * float(p)
    lo = math.floor(h)
    return lo, min(lo + 1, n - 1), h - lo


def _inside(rows: DataFrame, brackets: list, probs: Sequence[float], by: list[str]) -> list | None:
    """The quantiles of every group from the values inside its brackets; None if
    a rank lies outside its bracket or too much lies inside for a short list."""
    spark = rows.sparkSession
    small = spark.createDataFrame([(k, *r) for k, r in enumerate(brackets)], "_k int, " + rows.select(*by).schema.simpleString()[7:-1] + ", _n long, _e array<struct<a: double, b: double>>") if brackets else None
    if small is None:
        return []
    table = checked_broadcast(small.select("_k", *[F.col(g).alias("_g_" + g) for g in by], "_e"))
    on = F.lit(True)
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col("_g_" + g))
    x = F.col("_x")
    # below a bracket only the number matters, above it nothing: a row says by
    # bits what brackets it is below and inside of
    masks = []
    for lo in range(0, len(probs), BITS):
        ends = [(1 << k, F.col("_e")[lo + k]) for k in range(min(BITS, len(probs) - lo))]
        for name, hit in (("_below", lambda e: (x < e["a"]) & (x <= e["b"])), ("_in", lambda e: (x >= e["a"]) & (x <= e["b"]))):
            bits = [F.when(hit(e), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, e in ends]
            masks.append(functools.reduce(lambda a, b: a.bitwiseOR(b), bits).alias(f"{name}{lo}"))
    names = [f"{name}{lo}" for lo in range(0, len(probs), BITS) for name in ("_below", "_in")]
    inside = functools.reduce(lambda a, b: a | b, [F.col(c) != 0 for c in names[1::2]], F.lit(False))
    marked = rows.join(table, on).select("_k", "_x", *masks).select("_k", *names, F.when(inside, x).alias("v"))
    touched = functools.reduce(lambda a, b: a | b, [F.col(c) != 0 for c in names], F.lit(False))
    got = bounded_rows(marked.where(touched).groupBy("_k", *names, "v").agg(F.count(F.lit(1)).alias("c")), 50_000)
    if got is None:
        return None
    below, values = defaultdict(int), defaultdict(list)
    for r in got:
        for i in range(len(probs)):
            lo, bit = i - i % BITS, 1 << i % BITS
            if r[f"_below{lo}"] & bit:
                below[r["_k"], i] += r["c"]
            elif r[f"_in{lo}"] & bit:
                values[r["_k"], i].append((r["v"], r["c"]))
    out = []
    for k, b in enumerate(brackets):
        line = []
        for i, p in enumerate(probs):
            lo, hi, part = _ranks(b["_n"], p)
            at, found = below[k, i], {}
            if lo < at:
                return None
            for v, c in sorted(values[k, i]):  # a value comes once: its bits depend on it
                for rank in (lo, hi):
                    if at <= rank < at + c:
                        found[rank] = v
                at += c
            if hi >= at:
                return None
            a, z = found[lo], found[hi]
            line.append(a if a == z else a + part * (z - a))
        out.append((*[b[g] for g in by], *line))
    return out


def _by_counts(rows: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """The same from counts per (group, value), as tables throughout."""
    counts = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(counts, by, "_x", ["_c"], prefix="_to")
    size = cum.groupBy(*by).agg(F.sum("_c").alias("_n"))
    keyed = size.select(*[F.col(g).alias("_g_" + g) for g in by], "_n")
    on = F.lit(True)
    for g in by:
        on = on & F.col(g).eqNullSafe(F.col("_g_" + g))
    both = cum.join(keyed, on)
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("_n") - 1)
        for name, k in ((f"_lo{i}", lo), (f"_hi{i}", hi)):
            picks.append(F.max(F.when((F.col("_to_c") > k) & (F.col("_to_c") - F.col("_c") <= k), F.col("_x"))).alias(name))
    got = both.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        a, b = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(a == b, a).otherwise(a + (h - F.floor(h)) * (b - a)).alias(f"q{i}"))
    return got.select(*by, *out)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], approx: bool = False) -> dict:
    """{column: [quantile per probability] or None without values}, all columns
    folded into (column, value) rows and searched together."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select("s.*")
    rows = {r["c"]: [float(r[f"q{i}"]) for i in range(len(probs))] for r in quantiles(long, "x", probs, ["c"], approx).collect()}  # one row per column
    return {c: rows.get(c) for c in cols}
