"""Registered queries: segment profiles, names, CRM rules (G6, G8, G9, F2, J3,
M2, M6-M11) on the ``seg`` view (features + a fixed segment id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.operators import crm as C
from basketry.operators.lookup import checked_broadcast
from basketry.operators.stats import quantile_table
from basketry.plans import views
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register
from basketry.plans.sql_features import _q, feat_ctes, segf_cte

SEGF = [*feat_ctes(), segf_cte()]
PROFILE_NUM = ["Yas", "Harcama_USD", "Sub_Pct", "PrevPur", "Rating", "Freq", "Promo_Pct", "FitScore",
               "RelSpend", "TotWght"]


def r6(df, cols, nd=6):
    return df.select(*[F.round(F.col(c), nd).alias(c) if c in cols else F.col(c) for c in df.columns])


def _names_case(col):
    names = " ".join(f"WHEN {i} THEN {_q(n)}" for i, n in enumerate(K.SEGMENT_NAMES_BY_RANK, 1))
    acts = " ".join(f"WHEN {i} THEN {_q(n)}" for i, n in enumerate(K.SEGMENT_ACTIONS_BY_RANK, 1))
    return (f"CASE {col} {names} ELSE {_q(K.SEGMENT_NAME_DEFAULT)} END AS segment_name, "
            f"CASE {col} {acts} ELSE {_q(K.SEGMENT_ACTION_DEFAULT)} END AS action")


def _mode_join(c, alias, i):
    return f"""LEFT JOIN (SELECT Cluster, v FROM (SELECT Cluster, {c} AS v,
        row_number() OVER (PARTITION BY Cluster ORDER BY count(*) DESC, {c}) AS rn
        FROM segf WHERE {c} IS NOT NULL GROUP BY Cluster, {c}) WHERE rn = 1) m{i} ON m{i}.Cluster = nums.Cluster"""


PROFILE_CTE = f"""prof AS (SELECT nums.*, coalesce(m0.v, 'Unknown') AS Kategori, coalesce(m1.v, 'Unknown') AS Odeme,
    coalesce(m2.v, 'Unknown') AS Kargo, coalesce(m3.v, 'Unknown') AS Iklim,
    CAST(row_number() OVER (ORDER BY TotWght DESC, nums.Cluster) AS INT) AS spend_rank
  FROM (SELECT Cluster, count(CUSTOMER_ID) AS N, avg(AGE) AS Yas, avg(PURCHASE_AMOUNT_USD) AS Harcama_USD,
          avg(SUBSCRIPTION) * 100 AS Sub_Pct, avg(PREVIOUS_PURCHASES) AS PrevPur, avg(REVIEW_RATING) AS Rating,
          avg(FREQUENCY_VALUE_NEW) AS Freq, avg(PROMO_USED_VAL) * 100 AS Promo_Pct, avg(SUBSCRIPTION) AS FitScore,
          avg(SPEND_PER_PURCHASE_NEW) AS RelSpend, avg(TOTAL_SPEND_WEIGHTED_NEW) AS TotWght
        FROM segf GROUP BY Cluster) nums
  {_mode_join('CATEGORY', 'Kategori', 0)} {_mode_join('PAYMENT_METHOD', 'Odeme', 1)}
  {_mode_join('SHIPPING_TYPE', 'Kargo', 2)} {_mode_join('CLIMATE_GROUP_NEW', 'Iklim', 3)})"""
PROFILE_SEL = ("Cluster, N, " + ", ".join(f"round({c}, 6) AS {c}" for c in PROFILE_NUM)
               + ", Kategori, Odeme, Kargo, Iklim, spend_rank, " + _names_case("spend_rank"))


def seg(spark, sf_dir):
    return views.seg(spark, sf_dir)


def profile(spark, sf_dir):
    return C.segment_profile(seg(spark, sf_dir))


@register("segment_profile", with_views(f"SELECT {PROFILE_SEL} FROM prof", *SEGF, PROFILE_CTE))
def q_segment_profile(spark, sf_dir):
    return r6(profile(spark, sf_dir), PROFILE_NUM)


@register("segment_names_fixed", with_views(
    "SELECT Cluster, round(TotWght, 6) AS TotWght, spend_rank, " + _names_case("spend_rank") + " FROM prof",
    *SEGF, PROFILE_CTE))
def q_segment_names_fixed(spark, sf_dir):
    p = profile(spark, sf_dir)
    return r6(p.select("Cluster", "TotWght", "spend_rank", "segment_name", "action"), ["TotWght"])


def _playbook_values():
    rows = []
    for a, steps in K.PLAYBOOK.items():
        for i, s in enumerate(steps, 1):
            rows.append(f"({_q(a)}, {i}, {_q(s)})")
    return "pb(action, step_no, step) AS (VALUES " + ", ".join(rows) + ")"


@register("segment_playbook", with_views(
    "SELECT n.Cluster, n.segment_name, n.action, CAST(pb.step_no AS INT) AS step_no, pb.step "
    "FROM (SELECT Cluster, " + _names_case("spend_rank") + " FROM prof) n JOIN pb ON pb.action = n.action",
    *SEGF, PROFILE_CTE, _playbook_values()))
def q_segment_playbook(spark, sf_dir):
    return C.segment_playbook(profile(spark, sf_dir))


@register("segment_lookup", with_views(
    "SELECT s.ROW_ID, s.Cluster, n.segment_name FROM segf s JOIN (SELECT Cluster, "
    + _names_case("spend_rank") + " FROM prof) n ON n.Cluster = s.Cluster", *SEGF, PROFILE_CTE))
def q_segment_lookup(spark, sf_dir):
    names = profile(spark, sf_dir).select("Cluster", "segment_name")
    from basketry.operators.lookup import lookup_join
    return lookup_join(seg(spark, sf_dir).select("ROW_ID", "Cluster"), names, ["Cluster"], "inner")


RISK_CTE = """risk AS (SELECT Cluster,
    round(avg(CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1.0 WHEN SUBSCRIPTION_STATUS = 'No' THEN 0.0 END), 3) * 100 AS sub_rate_pct,
    count(CUSTOMER_ID) AS n_customers, round(avg(TOTAL_SPEND_WEIGHTED_NEW), 3) AS avg_spend,
    round(avg(PREVIOUS_PURCHASES), 3) AS avg_prev_purchases, round(avg(REVIEW_RATING), 3) AS avg_rating
  FROM segf GROUP BY Cluster)"""
RISK_SEL = ("Cluster, round(sub_rate_pct, 6) AS sub_rate_pct, n_customers, round(avg_spend, 6) AS avg_spend, "
            "round(avg_prev_purchases, 6) AS avg_prev_purchases, round(avg_rating, 6) AS avg_rating")
RISK_NUM = ["sub_rate_pct", "avg_spend", "avg_prev_purchases", "avg_rating"]


@register("segment_risk", with_views(f"SELECT {RISK_SEL} FROM risk ORDER BY Cluster", *SEGF, RISK_CTE))
def q_segment_risk(spark, sf_dir):
    return r6(C.segment_risk(seg(spark, sf_dir)), RISK_NUM)


@register("filter_below_mean", with_views(
    f"SELECT {RISK_SEL} FROM risk WHERE sub_rate_pct < (SELECT avg(sub_rate_pct) FROM risk)", *SEGF, RISK_CTE))
def q_filter_below_mean(spark, sf_dir):
    return r6(C.filter_below_mean(C.segment_risk(seg(spark, sf_dir))), RISK_NUM)


@register("risk_actions", with_views(f"""
SELECT Cluster, CAST(row_number() OVER (PARTITION BY Cluster ORDER BY k) AS INT) AS action_no, action FROM (
  SELECT Cluster, 1 AS k, CASE WHEN sub_rate_pct < 30 THEN {_q(K.RISK_ACTION_AGGRESSIVE)}
                                WHEN sub_rate_pct < 50 THEN {_q(K.RISK_ACTION_MODERATE)} END AS action FROM low
  UNION ALL SELECT Cluster, 2, CASE WHEN avg_spend > (SELECT avg(avg_spend) FROM risk) THEN {_q(K.RISK_ACTION_VIP)} END FROM low
  UNION ALL SELECT Cluster, 3, CASE WHEN avg_rating < 3.5 THEN {_q(K.RISK_ACTION_SURVEY)} END FROM low
  UNION ALL SELECT Cluster, 4, CASE WHEN avg_prev_purchases < 20 THEN {_q(K.RISK_ACTION_LOYALTY)}
                                    ELSE {_q(K.RISK_ACTION_REWARD)} END FROM low) WHERE action IS NOT NULL""",
    *SEGF, RISK_CTE, "low AS (SELECT * FROM risk WHERE sub_rate_pct < (SELECT avg(sub_rate_pct) FROM risk))"))
def q_risk_actions(spark, sf_dir):
    return C.risk_actions(C.segment_risk(seg(spark, sf_dir)))


CRM_CTE = """crm AS (SELECT *, (SELECT median(avg_spend) FROM per) AS spend_median,
    (SELECT avg(crm_target_rate) FROM per) AS target_mean FROM per)"""
PER_CTE = """per AS (SELECT Cluster, count(CUSTOMER_ID) AS n_customers,
    round(avg(CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1.0 ELSE 0.0 END), 3) AS crm_target_rate,
    round(avg(TOTAL_SPEND_WEIGHTED_NEW), 3) AS avg_spend, round(avg(PREVIOUS_PURCHASES), 3) AS avg_prev_purchases,
    round(avg(FREQUENCY_VALUE_NEW), 3) AS avg_freq, round(avg(PROMO_USED_VAL), 3) AS promo_rate
  FROM segf GROUP BY Cluster)"""
CRM_NUM = ["crm_target_rate", "avg_spend", "avg_prev_purchases", "avg_freq", "promo_rate", "spend_median",
           "target_mean"]
CRM_SEL = "Cluster, n_customers, " + ", ".join(f"round({c}, 6) AS {c}" for c in CRM_NUM)


@register("crm_summary", with_views(f"SELECT {CRM_SEL} FROM crm", *SEGF, PER_CTE, CRM_CTE))
def q_crm_summary(spark, sf_dir):
    return r6(C.crm_summary(seg(spark, sf_dir)), CRM_NUM)


CRM_ACTION_SQL = f"""
SELECT c.Cluster, n.segment_name, c.n_customers, round(c.crm_target_rate * 100, 1) AS rate_pct,
  round(c.avg_spend, 6) AS avg_spend, round(c.avg_prev_purchases, 6) AS avg_prev_purchases,
  round(c.avg_freq, 6) AS avg_freq, round(c.promo_rate * 100, 1) AS promo_pct,
  CASE WHEN c.crm_target_rate >= c.target_mean AND c.avg_spend >= c.spend_median THEN {_q(K.CRM_UPSELL)}
       WHEN c.crm_target_rate >= c.target_mean THEN {_q(K.CRM_QUICK_WIN)}
       WHEN c.crm_target_rate < c.target_mean AND c.avg_spend >= c.spend_median THEN {_q(K.CRM_RETENTION)}
       ELSE {_q(K.CRM_WINBACK)} END AS crm_action
FROM crm c JOIN (SELECT Cluster, {_names_case('spend_rank')} FROM prof) n ON n.Cluster = c.Cluster
ORDER BY rate_pct DESC, c.Cluster"""


@register("crm_action", with_views(CRM_ACTION_SQL, *SEGF, PER_CTE, CRM_CTE, PROFILE_CTE))
def q_crm_action(spark, sf_dir):
    """Flagship: features -> segment aggregates -> cross-segment thresholds ->
    action rule, named by segment rank."""
    s = seg(spark, sf_dir)
    acts = C.crm_display(C.crm_action(C.crm_summary(s)))
    names = C.segment_names_fixed(
        s.groupBy("Cluster").agg(F.avg("TOTAL_SPEND_WEIGHTED_NEW").alias("TotWght"))).select("Cluster", "segment_name")
    res = acts.join(checked_broadcast(names), "Cluster")
    return r6(res.select("Cluster", "segment_name", "n_customers", "rate_pct", "avg_spend", "avg_prev_purchases",
                         "avg_freq", "promo_pct", "crm_action").orderBy(F.desc("rate_pct"), "Cluster"),
              ["avg_spend", "avg_prev_purchases", "avg_freq"])


def _rule_sql():
    lv = K.SPEND_LEVELS
    return f"""
SELECT Cluster, round(mean_age, 6) AS mean_age, round(mean_spend, 6) AS mean_spend, round(promo_pct, 6) AS promo_pct,
  concat_ws(' ',
    CASE WHEN mean_spend > q.q75 THEN {_q(lv[0])} WHEN mean_spend > q.q50 THEN {_q(lv[1])}
         WHEN mean_spend > q.q25 THEN {_q(lv[2])} ELSE {_q(lv[3])} END,
    CASE WHEN mean_age < {K.AGE_GROUPS[0][0]} THEN {_q(K.AGE_GROUPS[0][1])}
         WHEN mean_age < {K.AGE_GROUPS[1][0]} THEN {_q(K.AGE_GROUPS[1][1])} ELSE {_q(K.AGE_GROUP_ELSE)} END,
    CASE WHEN promo_pct > {K.PROMO_TYPES[0][0]} THEN {_q(K.PROMO_TYPES[0][1])}
         WHEN promo_pct > {K.PROMO_TYPES[1][0]} THEN {_q(K.PROMO_TYPES[1][1])} ELSE {_q(K.PROMO_TYPE_ELSE)} END)
    AS segment_name
FROM (SELECT Cluster, avg(AGE) AS mean_age, avg(TOTAL_SPEND_WEIGHTED_NEW) AS mean_spend,
        avg(PROMO_USED_VAL) * 100 AS promo_pct FROM segf GROUP BY Cluster)
CROSS JOIN (SELECT quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.25) AS q25, quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.5) AS q50,
                   quantile_cont(TOTAL_SPEND_WEIGHTED_NEW, 0.75) AS q75 FROM segf) q"""


@register("segment_names_rule", with_views(_rule_sql(), *SEGF))
def q_segment_names_rule(spark, sf_dir):
    s = seg(spark, sf_dir)
    q = quantile_table(s, "TOTAL_SPEND_WEIGHTED_NEW", [0.25, 0.5, 0.75]).first()
    return r6(C.segment_names_rule(s, [q["q25"], q["q50"], q["q75"]]), ["mean_age", "mean_spend", "promo_pct"])


@register("segment_recommendation", with_views(f"""
SELECT s.ROW_ID, sc.model, s.Cluster, sc.p, round(r.sub_rate_pct, 6) AS sub_rate_pct,
  CASE WHEN r.sub_rate_pct < 40 THEN {_q(K.REC_LOW)} WHEN r.sub_rate_pct < 60 THEN {_q(K.REC_MID)}
       WHEN r.sub_rate_pct IS NOT NULL THEN {_q(K.REC_HIGH)} END AS advice,
  CASE WHEN sc.p >= 0.5 AND r.sub_rate_pct >= 50 THEN {_q(K.REC_BOTH_HIGH)}
       WHEN sc.p < 0.5 AND r.sub_rate_pct < 40 THEN {_q(K.REC_BOTH_LOW)} END AS joint
FROM segf s JOIN scored sc ON sc.ROW_ID = s.ROW_ID
LEFT JOIN risk r ON r.Cluster = s.Cluster""", *SEGF, RISK_CTE))
def q_segment_recommendation(spark, sf_dir):
    s = seg(spark, sf_dir).select("ROW_ID", "Cluster")
    sc = views.scored(spark, sf_dir).select("ROW_ID", "model", "p")
    rows = s.join(sc, "ROW_ID")
    res = C.segment_recommendation(rows, C.segment_risk(seg(spark, sf_dir)), 0.5)
    return r6(res.select("ROW_ID", "model", "Cluster", "p", "sub_rate_pct", "advice", "joint"), ["sub_rate_pct"])
