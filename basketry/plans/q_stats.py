"""Registered queries: exploratory statistics (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import stats as S
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register
from basketry.plans.views import shop as shop_frame


def r6(c):
    return F.round(c, 6)


@register("rate_by_group", with_views("""
SELECT CATEGORY, round(avg(CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS rate_pct
FROM shop WHERE CATEGORY IS NOT NULL GROUP BY CATEGORY ORDER BY rate_pct, CATEGORY"""))
def q_rate_by_group(spark, sf_dir):
    res = S.rate_by_group(shop_frame(spark, sf_dir))
    return res.select("CATEGORY", r6(F.col("rate_pct")).alias("rate_pct"))


from basketry.plans import views  # noqa: E402
from basketry.plans.sql_features import feat_ctes, segf_cte  # noqa: E402

FEAT = feat_ctes()
SEGF = [*FEAT, segf_cte()]


def rr(df, cols, nd=6):
    """Round the named double columns to ``nd`` decimals, keep the others."""
    return df.select(*[F.round(F.col(c), nd).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("kpi_summary", with_views("""
SELECT count(*) AS n_customers, round(avg(AGE), 6) AS mean_age,
  round(avg(CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS subscribed_pct,
  round(avg(TOTAL_SPEND_WEIGHTED_NEW), 6) AS mean_weighted_spend,
  round(avg(PREVIOUS_PURCHASES), 6) AS mean_previous_purchases, round(avg(REVIEW_RATING), 6) AS mean_rating
FROM feat""", *FEAT))
def q_kpi_summary(spark, sf_dir):
    res = S.kpi_summary(views.feat(spark, sf_dir), "a")
    return rr(res, ["mean_age", "subscribed_pct", "mean_weighted_spend", "mean_previous_purchases", "mean_rating"])


@register("kpi_summary_b", with_views("""
SELECT count(*) AS n_customers, round(avg(AGE), 6) AS mean_age,
  round(avg(CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS subscribed_pct,
  round(avg(PURCHASE_AMOUNT_USD), 6) AS mean_amount, round(sum(PURCHASE_AMOUNT_USD), 4) AS total_amount
FROM shop"""))
def q_kpi_summary_b(spark, sf_dir):
    res = S.kpi_summary(shop_frame(spark, sf_dir), "b")
    res = rr(res, ["mean_age", "subscribed_pct", "mean_amount"])
    return res.withColumn("total_amount", F.round("total_amount", 4))


DIST_COLS = ["GENDER", "SUBSCRIPTION_STATUS", "SIZE", "CATEGORY"]


def _dist_sql():
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM shop "
             f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in DIST_COLS]
    return with_views(f"""SELECT feature, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY feature), 6) AS pct
      FROM ({' UNION ALL '.join(parts)})""")


@register("value_distribution", _dist_sql())
def q_value_distribution(spark, sf_dir):
    return rr(S.value_distribution(shop_frame(spark, sf_dir), DIST_COLS), ["pct"])


@register("crosstab_counts", with_views("""
SELECT SEASON, count(*) FILTER (WHERE SIZE = 'L') AS L, count(*) FILTER (WHERE SIZE = 'M') AS M,
  count(*) FILTER (WHERE SIZE = 'S') AS S, count(*) FILTER (WHERE SIZE = 'XL') AS XL
FROM shop WHERE SEASON IS NOT NULL AND SIZE IS NOT NULL GROUP BY SEASON"""))
def q_crosstab_counts(spark, sf_dir):
    return S.crosstab_wide(shop_frame(spark, sf_dir), "SEASON", "SIZE")


@register("crosstab_long", with_views("""
SELECT CATEGORY, SEASON, count(*) AS n FROM shop
WHERE CATEGORY IS NOT NULL AND SEASON IS NOT NULL GROUP BY CATEGORY, SEASON"""))
def q_crosstab_long(spark, sf_dir):
    return S.crosstab_counts(shop_frame(spark, sf_dir), "CATEGORY", "SEASON")


def _rowpct_sql(a, b, vals):
    cols = ", ".join(f"round(count(*) FILTER (WHERE {b} = '{v}') * 100.0 / count(*), 6) AS \"{v}\"" for v in vals)
    return with_views(f"SELECT {a}, {cols} FROM shop WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}")


@register("crosstab_row_pct", _rowpct_sql("DISCOUNT_APPLIED", "PROMO_CODE_USED", ["No", "Yes"]))
def q_crosstab_row_pct(spark, sf_dir):
    return rr(S.crosstab_row_pct(shop_frame(spark, sf_dir), "DISCOUNT_APPLIED", "PROMO_CODE_USED"), ["No", "Yes"])


@register("crosstab_row_pct_gender", _rowpct_sql("GENDER", "SUBSCRIPTION_STATUS", ["No", "Yes"]))
def q_crosstab_row_pct_gender(spark, sf_dir):
    return rr(S.crosstab_row_pct(shop_frame(spark, sf_dir), "GENDER", "SUBSCRIPTION_STATUS"), ["No", "Yes"])


@register("crosstab_row_pct_promo", _rowpct_sql("PROMO_CODE_USED", "SUBSCRIPTION_STATUS", ["No", "Yes"]))
def q_crosstab_row_pct_promo(spark, sf_dir):
    return rr(S.crosstab_row_pct(shop_frame(spark, sf_dir), "PROMO_CODE_USED", "SUBSCRIPTION_STATUS"), ["No", "Yes"])


def _cramers_sql(a, b, src="shop"):
    return with_views(f"""
SELECT round(CASE WHEN r < 2 OR k < 2 THEN 0.0 ELSE sqrt(chi2 / (n * (least(r, k) - 1))) END, 6) AS v,
       round(chi2, 6) AS chi2, n, r, k
FROM (SELECT count(DISTINCT e.a) AS r, count(DISTINCT e.b) AS k, max(e.tot) AS n,
        CASE WHEN count(DISTINCT e.a) = 2 AND count(DISTINCT e.b) = 2
             THEN sum(power(abs(o - x) - least(0.5, abs(o - x)), 2) / x)
             ELSE sum(power(abs(o - x), 2) / x) END AS chi2
      FROM (SELECT m.a, m.b, CAST(coalesce(ct.o, 0) AS DOUBLE) AS o, CAST(m.rn AS DOUBLE) * m.cn / m.tot AS x, m.tot
            FROM (SELECT r.a, c.b, r.n AS rn, c.n AS cn, t.n AS tot
                  FROM (SELECT {a} AS a, count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) r
                  CROSS JOIN (SELECT {b} AS b, count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) c
                  CROSS JOIN (SELECT count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t) m
            LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {src} GROUP BY 1, 2) ct
              ON ct.a = m.a AND ct.b = m.b) e)""")


@register("cramers_v", _cramers_sql("DISCOUNT_APPLIED", "PROMO_CODE_USED"))
def q_cramers_v(spark, sf_dir):
    return rr(S.cramers_v(shop_frame(spark, sf_dir), "DISCOUNT_APPLIED", "PROMO_CODE_USED"), ["v", "chi2"])


@register("cramers_v_rk", _cramers_sql("CATEGORY", "SEASON"))
def q_cramers_v_rk(spark, sf_dir):
    return rr(S.cramers_v(shop_frame(spark, sf_dir), "CATEGORY", "SEASON"), ["v", "chi2"])


@register("drop_if_associated", with_views("""
SELECT v, CASE WHEN v > 0.8 THEN 1 ELSE 0 END AS dropped
FROM (SELECT sqrt(sum(power(abs(o - x) - least(0.5, abs(o - x)), 2) / x) / max(n)) AS v
      FROM (SELECT coalesce(ct.o, 0) AS o, CAST(m.rn AS DOUBLE) * m.cn / m.n AS x, m.n
            FROM (SELECT r.a, c.b, r.n AS rn, c.n AS cn, t.n AS n
                  FROM (SELECT DISCOUNT_APPLIED AS a, count(*) AS n FROM shop GROUP BY 1) r
                  CROSS JOIN (SELECT PROMO_CODE_USED AS b, count(*) AS n FROM shop GROUP BY 1) c
                  CROSS JOIN (SELECT count(*) AS n FROM shop) t) m
            LEFT JOIN (SELECT DISCOUNT_APPLIED AS a, PROMO_CODE_USED AS b, count(*) AS o FROM shop GROUP BY 1, 2) ct
              ON ct.a = m.a AND ct.b = m.b))""".replace("SELECT v, CASE", "SELECT round(v, 6) AS v, CASE")))
def q_drop_if_associated(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    out, v = S.drop_if_associated(s)
    dropped = 0 if "DISCOUNT_APPLIED" in out.columns else 1
    return S.cramers_v(s, "DISCOUNT_APPLIED", "PROMO_CODE_USED").select(
        F.round("v", 6).alias("v"), F.lit(dropped).alias("dropped"))


CORR_COLS = ["AGE", "PURCHASE_AMOUNT_USD", "REVIEW_RATING", "PREVIOUS_PURCHASES",
             "TOTAL_SPEND_WEIGHTED_NEW", "SPEND_PER_PURCHASE_NEW", "FREQUENCY_VALUE_NEW",
             "SPEND_RATING_NEW", "LOYALTY_SCORE_NEW", "PROMO_X_LOYALTY", "PROMO_X_FREQ",
             "HIGH_REVIEW_RATING_NEW", "PROMO_USED_VAL"]


def _corr_sql():
    parts = []
    for x in CORR_COLS:
        for y in CORR_COLS:
            xs = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END"
            ys = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, round(covar_pop({xs}, {ys}) / "
                         f"nullif(stddev_pop({xs}) * stddev_pop({ys}), 0), 6) AS corr FROM feat")
    return with_views(" UNION ALL ".join(parts), *FEAT)


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf_dir):
    return rr(S.correlation_matrix(views.feat(spark, sf_dir), CORR_COLS), ["corr"])


def _kde_sql(value, group, points, cut, src="shop"):
    return with_views(f"""
SELECT p.{group}, g.i, round(p.lo + g.i * p.step, 6) AS x,
  round(sum(c.cnt * exp(-0.5 * power((p.lo + g.i * p.step - c.v) / p.h, 2))) / (p.n * p.h * sqrt(2 * pi())), 12) AS density,
  round(sum(c.cnt * exp(-0.5 * power((p.lo + g.i * p.step - c.v) / p.h, 2))) / (p.n * p.h * sqrt(2 * pi())) * p.step, 9) AS mass
FROM (SELECT {group}, n, h, mn - {cut} * h AS lo, ((mx + {cut} * h) - (mn - {cut} * h)) / {points - 1} AS step
      FROM (SELECT {group}, count(*) AS n, stddev_samp(CAST({value} AS DOUBLE)) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
              min(CAST({value} AS DOUBLE)) AS mn, max(CAST({value} AS DOUBLE)) AS mx
            FROM {src} WHERE {value} IS NOT NULL GROUP BY {group})) p
CROSS JOIN range(0, {points}) g(i)
JOIN (SELECT {group}, CAST({value} AS DOUBLE) AS v, count(*) AS cnt FROM {src} WHERE {value} IS NOT NULL GROUP BY 1, 2) c
  ON c.{group} IS NOT DISTINCT FROM p.{group}
GROUP BY p.{group}, g.i, p.lo, p.step, p.n, p.h""")


def _kde_out(res, group, *quartiles):
    return res.select(group, F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"),
                      F.round("density", 12).alias("density"),
                      F.round(F.col("density") * F.col("step"), 9).alias("mass"), *[F.round(q, 6).alias(q) for q in quartiles])


@register("kde_by_group", _kde_sql("PURCHASE_AMOUNT_USD", "SUBSCRIPTION_STATUS", 200, 3))
def q_kde_by_group(spark, sf_dir):
    res = S.kde(shop_frame(spark, sf_dir), "PURCHASE_AMOUNT_USD", "SUBSCRIPTION_STATUS", 200, 3.0)
    return _kde_out(res, "SUBSCRIPTION_STATUS")


def _violin_sql(value, group):
    dens = _kde_sql(value, group, 100, 2)
    head, body = dens.split("SELECT p.", 1)
    return f"""{head}SELECT d.*, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3 FROM (SELECT p.{body}) d
JOIN (SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3
      FROM shop WHERE {value} IS NOT NULL GROUP BY {group}) q ON q.{group} IS NOT DISTINCT FROM d.{group}"""


@register("violin_stats", _violin_sql("AGE", "SUBSCRIPTION_STATUS"))
def q_violin_stats(spark, sf_dir):
    res = S.violin(shop_frame(spark, sf_dir), "AGE", "SUBSCRIPTION_STATUS")
    return _kde_out(res, "SUBSCRIPTION_STATUS", "q1", "median", "q3")


def _box_sql(value, group):
    return with_views(f"""
SELECT q.{group}, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
  round(min(CASE WHEN s.{value} >= q.q1 - 1.5 * (q.q3 - q.q1) THEN CAST(s.{value} AS DOUBLE) END), 6) AS whisker_low,
  round(max(CASE WHEN s.{value} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN CAST(s.{value} AS DOUBLE) END), 6) AS whisker_high,
  count(*) FILTER (WHERE s.{value} < q.q1 - 1.5 * (q.q3 - q.q1) OR s.{value} > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers
FROM shop s JOIN (SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
                         quantile_cont({value}, 0.75) AS q3 FROM shop WHERE {value} IS NOT NULL GROUP BY {group}) q
  ON q.{group} = s.{group}
WHERE s.{value} IS NOT NULL GROUP BY q.{group}, q.q1, q.median, q.q3""")


@register("box_stats", _box_sql("PREVIOUS_PURCHASES", "SUBSCRIPTION_STATUS"))
def q_box_stats(spark, sf_dir):
    res = S.box_stats(shop_frame(spark, sf_dir), "PREVIOUS_PURCHASES", "SUBSCRIPTION_STATUS")
    return rr(res, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@register("box_stats_age", _box_sql("AGE", "SUBSCRIPTION_STATUS"))
def q_box_stats_age(spark, sf_dir):
    res = S.box_stats(shop_frame(spark, sf_dir), "AGE", "SUBSCRIPTION_STATUS")
    return rr(res, ["q1", "median", "q3", "whisker_low", "whisker_high"])


@register("quantile_cutoffs", with_views("""
SELECT round(quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.25), 6) AS q25,
       round(quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.5), 6) AS q50,
       round(quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.75), 6) AS q75 FROM feat""", *FEAT))
def q_quantile_cutoffs(spark, sf_dir):
    return rr(S.quantile_table(views.feat(spark, sf_dir), "TOTAL_SPEND_WEIGHTED_NEW", [0.25, 0.5, 0.75]),
              ["q25", "q50", "q75"])


MODE_COLS = ["CATEGORY", "PAYMENT_METHOD", "SHIPPING_TYPE", "CLIMATE_GROUP_NEW"]


def _mode_sql():
    sel, joins = [], []
    for i, c in enumerate(MODE_COLS):
        joins.append(f"""LEFT JOIN (SELECT Cluster, v FROM (SELECT Cluster, {c} AS v,
            row_number() OVER (PARTITION BY Cluster ORDER BY count(*) DESC, {c}) AS rn
            FROM segf WHERE {c} IS NOT NULL GROUP BY Cluster, {c}) WHERE rn = 1) m{i} ON m{i}.Cluster = k.Cluster""")
        sel.append(f"coalesce(m{i}.v, 'Unknown') AS {c}")
    return with_views(f"SELECT k.Cluster, {', '.join(sel)} FROM (SELECT DISTINCT Cluster FROM segf) k "
                      + " ".join(joins), *SEGF)


@register("group_mode", _mode_sql())
def q_group_mode(spark, sf_dir):
    return S.group_mode(views.seg(spark, sf_dir), "Cluster", MODE_COLS)


DISTINCT_COLS = ["GENDER", "ITEM_PURCHASED", "CATEGORY", "LOCATION", "SIZE", "COLOR", "SEASON",
                 "SHIPPING_TYPE", "PAYMENT_METHOD", "FREQUENCY_OF_PURCHASES"]


@register("distinct_count", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM shop" for c in DISTINCT_COLS)))
def q_distinct_count(spark, sf_dir):
    return S.distinct_count(shop_frame(spark, sf_dir), DISTINCT_COLS)


@register("distinct_values", with_views(" UNION ".join(
    f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM shop WHERE {c} IS NOT NULL"
    for c in DISTINCT_COLS)))
def q_distinct_values(spark, sf_dir):
    return S._pairs(shop_frame(spark, sf_dir), DISTINCT_COLS).distinct()


@register("cluster_sizes", with_views("""
SELECT Cluster, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM segf GROUP BY Cluster ORDER BY Cluster""", *SEGF))
def q_cluster_sizes(spark, sf_dir):
    return S.group_sizes(views.seg(spark, sf_dir), "Cluster")


@register("topk_values", with_views("""
SELECT LOCATION, count(*) AS n FROM shop WHERE LOCATION IS NOT NULL GROUP BY LOCATION
ORDER BY n DESC, LOCATION LIMIT 10"""))
def q_topk_values(spark, sf_dir):
    return S.top_counts(shop_frame(spark, sf_dir), "LOCATION", 10)


@register("sort_rows", with_views("""
SELECT ROW_ID, PURCHASE_AMOUNT_USD FROM shop ORDER BY PURCHASE_AMOUNT_USD DESC, ROW_ID"""))
def q_sort_rows(spark, sf_dir):
    return (shop_frame(spark, sf_dir).select("ROW_ID", "PURCHASE_AMOUNT_USD")
            .orderBy(F.desc("PURCHASE_AMOUNT_USD"), "ROW_ID"))


@register("append_rows", with_views("""
SELECT ROW_ID, CUSTOMER_ID, CATEGORY, PURCHASE_AMOUNT_USD, PREVIOUS_PURCHASES FROM shop
UNION ALL
SELECT top + row_number() OVER (ORDER BY CUSTOMER_ID), CUSTOMER_ID, 'New', 0.0, n FROM
  (SELECT CUSTOMER_ID, CAST(2 * count(*) AS INT) AS n, (SELECT max(ROW_ID) FROM shop) AS top FROM shop GROUP BY CUSTOMER_ID)"""))
def q_append_rows(spark, sf_dir):
    """One new row per customer appended to the table, numbered on from it."""
    from basketry.operators.ranking import row_number_in_group
    s = shop_frame(spark, sf_dir).select("ROW_ID", "CUSTOMER_ID", "CATEGORY", "PURCHASE_AMOUNT_USD", "PREVIOUS_PURCHASES")
    top = s.agg(F.max("ROW_ID")).first()[0] or 0
    new = s.groupBy("CUSTOMER_ID").agg((F.count(F.lit(1)) * 2).cast("int").alias("n"))
    new = row_number_in_group(new, [], ["CUSTOMER_ID"], "rn")
    return s.unionByName(new.select((F.lit(top) + F.col("rn")).cast("long").alias("ROW_ID"), "CUSTOMER_ID", F.lit("New").alias("CATEGORY"),
                                    F.lit(0.0).alias("PURCHASE_AMOUNT_USD"), F.col("n").alias("PREVIOUS_PURCHASES")))
