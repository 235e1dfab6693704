"""Exploratory statistics as aggregations (partial + final, no UDF).

Multi-column statistics are one pass: columns are folded into (column, value)
pairs with ``explode(array(struct ...))`` and aggregated together, instead of
one job per column. Per-group inputs to later steps (marginals, bandwidths,
quantiles) are small by construction and checked before being shipped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from basketry.operators.lookup import bounded_rows, checked_broadcast
from basketry.operators.quantiles import column_quantiles, quantiles

SQRT_2PI = math.sqrt(2.0 * math.pi)


def _pairs(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long (keep..., feature, value) rows for non-null values of ``cols``."""
    return (df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("_p")).select(*keep, "_p.feature", "_p.value").where(F.col("value").isNotNull()))


# --------------------------------------------------------------------------- summaries
def kpi_summary(df: DataFrame, flavor: str = "a") -> DataFrame:
    yes = F.coalesce(F.col("SUBSCRIPTION_STATUS") == "Yes", F.lit(False)).cast("double")
    aggs = [F.count(F.lit(1)).alias("n_customers"), F.avg("AGE").alias("mean_age"),
            (F.avg(yes) * 100).alias("subscribed_pct")]
    if flavor == "a":
        aggs += [F.avg("TOTAL_SPEND_WEIGHTED_NEW").alias("mean_weighted_spend"),
                 F.avg("PREVIOUS_PURCHASES").alias("mean_previous_purchases"),
                 F.avg("REVIEW_RATING").alias("mean_rating")]
    else:
        aggs += [F.avg("PURCHASE_AMOUNT_USD").alias("mean_amount"),
                 F.sum("PURCHASE_AMOUNT_USD").alias("total_amount")]
    return df.agg(*aggs)


def value_distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n, pct) with pct of the column's non-null rows."""
    counts = _pairs(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_tot"))
    return (counts.join(F.broadcast(totals), "feature")  # one row per column: bounded
            .select("feature", "value", "n", (F.col("n") * 100.0 / F.col("_tot")).alias("pct")))


def rate_by_group(df: DataFrame, group: str = "CATEGORY", label: str = "SUBSCRIPTION_STATUS",
                  positive: str = "Yes", out: str = "rate_pct") -> DataFrame:
    """% of rows with label == positive per group (null label counts as not
    positive; null groups dropped), ascending."""
    hit = F.coalesce(F.col(label) == F.lit(positive), F.lit(False)).cast("double")
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg((F.avg(hit) * 100).alias(out)).orderBy(out, group))


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency counts over rows where both keys are present."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


#: Most columns a wide table may get from one column's values.
WIDE_BOUND = 10_000


def _values(df: DataFrame, col: str) -> list:
    """The values that become columns of a wide table (its schema); more than
    ``WIDE_BOUND`` are an error: that is what the long form is for."""
    rows = bounded_rows(df.where(F.col(col).isNotNull()).select(col).distinct(), WIDE_BOUND)
    if rows is None:
        raise ValueError(f"{col} has more than {WIDE_BOUND} values: use crosstab_counts")
    return sorted(r[col] for r in rows)


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Wide contingency table: one column per value of ``b``; absent pairs 0."""
    values = list(values) if values is not None else _values(df, b)
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a).pivot(b, values).count().na.fill(0, [str(v) for v in values]))


def crosstab_row_pct(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    """Row-normalised wide table x 100."""
    values = list(values) if values is not None else _values(df, b)
    wide = crosstab_wide(df, a, b, values)
    tot = sum((F.col(str(v)) for v in values[1:]), F.col(str(values[0])))
    return wide.select(a, *[(F.col(str(v)) * 100.0 / tot).alias(str(v)) for v in values])


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True, guard: bool = True) -> DataFrame:
    """One row (v, chi2, n, r, k): sqrt(chi2 / (n (min(r,k) - 1))), chi2 with
    the Yates continuity correction for 2x2 tables; 0.0 when r < 2 or k < 2."""
    ct = crosstab_counts(df, a, b).select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col("n").cast("double").alias("o"))
    rows = ct.groupBy("_a").agg(F.sum("o").alias("rn"))
    cols = ct.groupBy("_b").agg(F.sum("o").alias("cn"))
    # chi2 = n (sum o^2 / (row * column) - 1) needs the observed cells only
    cells = ct.join(rows, "_a").join(cols, "_b")
    stats = cells.agg(F.sum(F.col("o") * F.col("o") / (F.col("rn") * F.col("cn"))).alias("q"), F.sum("o").alias("n"),
                      F.count_distinct("_a").alias("r"), F.count_distinct("_b").alias("k"),
                      F.min_by("o", F.struct("_a", "_b")).alias("o11"), F.min_by("rn", F.struct("_a", "_b")).alias("r1"), F.min_by("cn", F.struct("_a", "_b")).alias("c1"))
    n = F.col("n")
    plain = n * (F.col("q") - 1)
    # 2x2: every cell is off its expectation by the same |d|
    d = F.abs(F.col("o11") - F.col("r1") * F.col("c1") / n)
    expect = [x * y / n for x in (F.col("r1"), n - F.col("r1")) for y in (F.col("c1"), n - F.col("c1"))]
    off = F.pow(d - F.least(F.lit(0.5), d), 2)
    corrected = off / expect[0] + off / expect[1] + off / expect[2] + off / expect[3]
    two = (F.col("r") == 2) & (F.col("k") == 2)
    chi2 = F.when(two & F.lit(yates), corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    v = F.sqrt(chi2 / (n * (F.least("r", "k") - 1)))
    if guard:
        v = F.when((F.col("r") < 2) | (F.col("k") < 2), F.lit(0.0)).otherwise(v)
    return stats.select(v.alias("v"), chi2.alias("chi2"), n.cast("long").alias("n"), "r", "k")


def cramers_v_value(df: DataFrame, a: str, b: str, yates: bool = True):
    row = cramers_v(df, a, b, yates).first()
    return None if row is None else row["v"]


def drop_if_associated(df: DataFrame, a: str = "DISCOUNT_APPLIED", b: str = "PROMO_CODE_USED",
                       drop: str = "DISCOUNT_APPLIED", limit: float = 0.8):
    """(frame without ``drop`` when V(a, b) > limit, V)."""
    v = cramers_v_value(df, a, b)
    return (df.drop(drop) if v is not None and v > limit else df), v


# --------------------------------------------------------------------------- correlation
def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (col_a, col_b, corr) for all ordered pairs: Pearson over rows where
    both are present; null when either side is constant there.

    One aggregate of the mean-shifted rows: every row gives, for each pair of
    columns that are both present, the five products of the coefficient, and
    MLlib's Gramian adds them up as one matrix a partition, without generated
    code for each pair. With z = [x * present, present, x^2 * present], n, the
    sums, the squares and the cross products of a pair are entries of z' z."""
    cols = list(cols)
    k = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    shift = [F.coalesce(v - F.lit(float(means[f"m{i}"] or 0.0)), F.lit(0.0)) for i, v in enumerate(x)]
    z = F.array(*shift, *[v.isNotNull().cast("double") for v in x], *[v * v for v in shift])
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(z).alias("z")), "z")).computeGramianMatrix().toArray()
    rows = []
    for i in range(k):
        for j in range(k):
            n, sx, sy = gram[k + i, k + j], gram[i, k + j], gram[j, k + i]
            vx = gram[2 * k + i, k + j] - sx * sx / n if n else 0.0
            vy = gram[2 * k + j, k + i] - sy * sy / n if n else 0.0
            cov = gram[i, j] - sx * sy / n if n else 0.0
            rows.append((cols[i], cols[j], float(cov / math.sqrt(vx * vy)) if vx > 0 and vy > 0 else None))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# --------------------------------------------------------------------------- distributions
def _group_params(df: DataFrame, value: str, group: str, points: int, cut: float) -> DataFrame:
    """Per group: n, bandwidth h = sd(ddof 1) * n^(-1/5) (Scott), grid start, step."""
    st = (df.where(F.col(value).isNotNull())
          .groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                              F.stddev_samp(F.col(value).cast("double")).alias("sd"),
                              F.min(F.col(value).cast("double")).alias("mn"),
                              F.max(F.col(value).cast("double")).alias("mx")))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    lo = F.col("mn") - F.lit(cut) * h
    hi = F.col("mx") + F.lit(cut) * h
    params = st.select(group, "n", h.alias("h"), lo.alias("lo"),
                       ((hi - lo) / F.lit(points - 1)).alias("step"))
    return checked_broadcast(params.where(F.col("h") > 0))


def kde(df: DataFrame, value: str, group: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE per group on a ``points`` grid spanning [min - cut h, max + cut h].

    Every row adds its bumps at all grid points as one vector; tasks add the
    vectors up, so one per task and group is shuffled, and no row is ever
    exploded. Columns of a whole-number type are first counted by value."""
    params = _group_params(df, value, group, points, cut)
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    if isinstance(df.schema[value].dataType, IntegralType):
        rows = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    else:
        rows = rows.withColumn("_c", F.lit(1))
    j = rows.join(params, F.col("_g").eqNullSafe(F.col(group)))
    bumps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_c") * F.exp(-0.5 * F.pow((F.col("lo") + i * F.col("step") - F.col("_v")) / F.col("h"), 2)))
    sums = j.select("_g", array_to_vector(bumps).alias("_b")).groupBy("_g").agg(Summarizer.sum(F.col("_b")).alias("_b"))
    contrib = sums.select("_g", F.posexplode(vector_to_array("_b")).alias("i", "_s"))
    return (contrib.join(params, F.col("_g").eqNullSafe(F.col(group)))
            .select(group, "i", (F.col("lo") + F.col("i") * F.col("step")).alias("x"),
                    (F.col("_s") / (F.col("n") * F.col("h") * F.lit(SQRT_2PI))).alias("density"), "step"))


def box_stats(df: DataFrame, value: str, group: str, whisker: float = 1.5) -> DataFrame:
    """Per group: q1, median, q3 (linear), whiskers at the most extreme values
    within whisker * IQR of the box, number of points beyond."""
    q = checked_broadcast(quantiles(df, value, [0.25, 0.5, 0.75], by=[group]).toDF(group, "q1", "median", "q3"))
    x = F.col(value).cast("double")
    iqr = F.col("q3") - F.col("q1")
    lo = F.col("q1") - F.lit(whisker) * iqr
    hi = F.col("q3") + F.lit(whisker) * iqr
    j = df.where(F.col(value).isNotNull()).join(q, group)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo, x)).alias("whisker_low"),
        F.max(F.when(x <= hi, x)).alias("whisker_high"),
        F.count_if((x < lo) | (x > hi)).alias("n_outliers"))


def violin(df: DataFrame, value: str, group: str, points: int = 100, cut: float = 2.0) -> DataFrame:
    """The density of ``kde`` with its group's quartiles (q1, median, q3)."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], by=[group]).toDF(group, "q1", "median", "q3")
    q = checked_broadcast(q.withColumnRenamed(group, "_q"))
    return kde(df, value, group, points, cut).join(q, F.col(group).eqNullSafe(F.col("_q"))).drop("_q")


def quantile_table(df: DataFrame, col: str, probs: Sequence[float], approx: bool = False) -> DataFrame:
    """One row: q_<pct> per probability (null without values); ``approx`` takes
    a sketch's values (their rank error: ``quantiles.RANK_ERROR``)."""
    vals = column_quantiles(df, [col], probs, approx)[col] or [None] * len(probs)
    names = [f"q{int(round(p * 100))}" for p in probs]
    return df.sparkSession.createDataFrame([tuple(vals)], ", ".join(f"{n} double" for n in names))


# --------------------------------------------------------------------------- modes, distinct
def group_mode(df: DataFrame, group: Sequence[str] | str, cols: Sequence[str],
               default: str = "Unknown") -> DataFrame:
    """Most frequent non-null value per group and column, smallest on ties;
    ``default`` when a group has none. Two partial aggregates — (group, column,
    value) counts, then a min over (-count, value) — so no group's values are
    ever gathered in one buffer."""
    group = [group] if isinstance(group, str) else list(group)
    counts = _pairs(df, cols, group).groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*group, "feature").agg(F.min(F.struct((-F.col("n")).alias("nn"), "value")).alias("b"))
    wide = best.groupBy(*group).pivot("feature", list(cols)).agg(F.first("b.value"))
    keys = df.select(*group).distinct()
    out = keys.join(wide, group, "left") if group else wide
    return out.select(*group, *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in cols])


def distinct_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_distinct) over non-null values; one pass for all columns."""
    return _pairs(df, cols).groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))


def top_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(k))


def group_sizes(df: DataFrame, group: str = "Cluster") -> DataFrame:
    """Rows per group and % of all rows (2 decimals), by group."""
    c = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())  # over the per-group frame, not rows
    return c.select(group, "n", F.round(F.col("n") * 100.0 / tot, 2).alias("pct")).orderBy(group)
