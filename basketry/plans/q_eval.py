"""Registered queries: classifier evaluation on the ``scored`` view (M12-M17,
M23, M24, F3, W2, W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import metrics as M
from basketry.plans import views
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register

SWEEP_CTES = [
    "g AS (SELECT CAST(round(i * 0.05, 2) AS DOUBLE) AS t FROM range(1, 20) r(i))",
    """sw AS (SELECT s.model, g.t AS threshold,
        CAST(sum(CASE WHEN s.p >= g.t AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN s.p >= g.t AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(s.y) AS BIGINT) AS pos, CAST(sum(1 - s.y) AS BIGINT) AS neg
      FROM scored s CROSS JOIN g GROUP BY s.model, g.t)""",
    """swm AS (SELECT *, pos - tp AS fn, neg - fp AS tn,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN pos > 0 THEN tp / pos ELSE 0.0 END AS recall,
        CASE WHEN pos + neg > 0 THEN (tp + neg - fp) / (pos + neg) ELSE 0.0 END AS accuracy FROM sw)""",
    """swf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
        ELSE 0.0 END AS f1 FROM swm)""",
]


def chosen_ctes(target: float, default: float = 0.5):
    return [
        f"""pick AS (SELECT model, threshold FROM (SELECT model, threshold, row_number() OVER
            (PARTITION BY model ORDER BY precision DESC, threshold) AS rn FROM swf
            WHERE recall >= CAST({target} AS DOUBLE)) WHERE rn = 1)""",
        f"""ch AS (SELECT m.model, coalesce(pick.threshold, CAST({default} AS DOUBLE)) AS threshold,
            CASE WHEN pick.threshold IS NULL THEN 0 ELSE 1 END AS met
            FROM (SELECT DISTINCT model FROM swf) m LEFT JOIN pick ON pick.model = m.model)""",
    ]


METRICS = ["precision", "recall", "f1", "accuracy"]
SWEEP_COLS = "swf.model, swf.threshold, tp, fp, fn, tn, pos, neg, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in METRICS)


def r6(df, cols):
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def scored(spark, sf_dir):
    return views.scored(spark, sf_dir)


@register("threshold_sweep", with_views(f"SELECT {SWEEP_COLS} FROM swf", *SWEEP_CTES))
def q_threshold_sweep(spark, sf_dir):
    res = M.threshold_sweep(scored(spark, sf_dir))
    return r6(res.select("model", "threshold", "tp", "fp", "fn", "tn", "pos", "neg", *METRICS), METRICS)


@register("filter_min_recall", with_views(
    "SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM swf "
    "WHERE recall >= CAST(0.85 AS DOUBLE)", *SWEEP_CTES))
def q_filter_min_recall(spark, sf_dir):
    res = M.threshold_sweep(scored(spark, sf_dir)).where(F.col("recall") >= F.lit(0.85))
    return r6(res.select("model", "threshold", "precision", "recall"), ["precision", "recall"])


@register("best_threshold", with_views(
    f"SELECT {SWEEP_COLS}, met FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold",
    *SWEEP_CTES, *chosen_ctes(0.80)))
def q_best_threshold(spark, sf_dir):
    res = M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)), 0.80)
    return r6(res.select("model", "threshold", "tp", "fp", "fn", "tn", "pos", "neg", *METRICS, "met"), METRICS)


@register("best_threshold_v2", with_views(
    f"SELECT {SWEEP_COLS}, met FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold",
    *SWEEP_CTES, *chosen_ctes(0.85)))
def q_best_threshold_v2(spark, sf_dir):
    res = M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)), 0.85)
    return r6(res.select("model", "threshold", "tp", "fp", "fn", "tn", "pos", "neg", *METRICS, "met"), METRICS)


@register("best_threshold_unmet", with_views(
    f"SELECT {SWEEP_COLS}, met FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold",
    *SWEEP_CTES, *chosen_ctes(1.01)))
def q_best_threshold_unmet(spark, sf_dir):
    """Target recall above 1: no threshold qualifies, each model falls back to 0.50."""
    res = M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)), 1.01)
    return r6(res.select("model", "threshold", "tp", "fp", "fn", "tn", "pos", "neg", *METRICS, "met"), METRICS)


CM_SQL = with_views("""
SELECT m.model, a.actual, b.predicted, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT model FROM scored) m CROSS JOIN (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) b(predicted)
LEFT JOIN (SELECT s.model, CAST(s.y AS INT) AS actual, CAST(s.p >= ch.threshold AS INT) AS predicted, count(*) AS n
           FROM scored s JOIN ch ON ch.model = s.model GROUP BY 1, 2, 3) c
  ON c.model = m.model AND c.actual = a.actual AND c.predicted = b.predicted""", *SWEEP_CTES, *chosen_ctes(0.85))


def tuned(spark, sf_dir, target=0.85):
    return M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)), target).select("model", "threshold")


@register("confusion_matrix", CM_SQL)
def q_confusion_matrix(spark, sf_dir):
    s = scored(spark, sf_dir)
    return M.confusion_matrix(s, tuned(spark, sf_dir))


SC_CTE = "sc AS (SELECT model, p AS score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM scored GROUP BY model, p)"


@register("roc_curve", with_views("""
SELECT model, score, round(CASE WHEN N > 0 THEN fp / N ELSE 0.0 END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN tp / P ELSE 0.0 END, 6) AS tpr
FROM (SELECT model, score,
        sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
        sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
        sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM sc)
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM scored""", SC_CTE))
def q_roc_curve(spark, sf_dir):
    return r6(M.roc_curve(scored(spark, sf_dir)), ["fpr", "tpr"])


AUC_SQL = """au AS (SELECT model, sum(neg * (coalesce(above, 0) + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc
FROM (SELECT model, pos, neg, sum(pos) OVER (PARTITION BY model ORDER BY score DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM sc) GROUP BY model)"""


@register("auc", with_views("SELECT model, round(auc, 6) AS auc FROM au", SC_CTE, AUC_SQL))
def q_auc(spark, sf_dir):
    return r6(M.auc(scored(spark, sf_dir)), ["auc"])


@register("classification_report", with_views("""
SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT model, '0' AS label, p0 AS precision, r0 AS recall,
         CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f1, c00 + c01 AS support FROM k
  UNION ALL
  SELECT model, '1', p1, r1, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END, c11 + c10 FROM k
  UNION ALL
  SELECT model, 'accuracy', NULL, NULL, (c00 + c11) / (c00 + c01 + c10 + c11), c00 + c01 + c10 + c11 FROM k
  UNION ALL
  SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2,
         ((CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END)
          + (CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END)) / 2, c00 + c01 + c10 + c11 FROM k
  UNION ALL
  SELECT model, 'weighted avg', (p0 * (c00 + c01) + p1 * (c11 + c10)) / (c00 + c01 + c10 + c11),
         (r0 * (c00 + c01) + r1 * (c11 + c10)) / (c00 + c01 + c10 + c11),
         ((CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END) * (c00 + c01)
          + (CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END) * (c11 + c10)) / (c00 + c01 + c10 + c11),
         c00 + c01 + c10 + c11 FROM k)""",
    *SWEEP_CTES, *chosen_ctes(0.85),
    """cm AS (SELECT s.model, CAST(s.y AS INT) AS actual, CAST(s.p >= ch.threshold AS INT) AS predicted, count(*) AS n
           FROM scored s JOIN ch ON ch.model = s.model GROUP BY 1, 2, 3)""",
    """k AS (SELECT *, CASE WHEN c00 + c10 > 0 THEN c00 / (c00 + c10) ELSE 0.0 END AS p0,
                CASE WHEN c00 + c01 > 0 THEN c00 / (c00 + c01) ELSE 0.0 END AS r0,
                CASE WHEN c11 + c01 > 0 THEN c11 / (c11 + c01) ELSE 0.0 END AS p1,
                CASE WHEN c11 + c10 > 0 THEN c11 / (c11 + c10) ELSE 0.0 END AS r1
         FROM (SELECT model, CAST(coalesce(sum(n) FILTER (WHERE actual = 0 AND predicted = 0), 0) AS BIGINT) AS c00,
                 CAST(coalesce(sum(n) FILTER (WHERE actual = 0 AND predicted = 1), 0) AS BIGINT) AS c01,
                 CAST(coalesce(sum(n) FILTER (WHERE actual = 1 AND predicted = 0), 0) AS BIGINT) AS c10,
                 CAST(coalesce(sum(n) FILTER (WHERE actual = 1 AND predicted = 1), 0) AS BIGINT) AS c11
               FROM cm GROUP BY model))"""))
def q_classification_report(spark, sf_dir):
    return r6(M.tuned_report(scored(spark, sf_dir)), ["precision", "recall", "f1"])


COMPARE_SQL = with_views("""
SELECT swf.model, swf.threshold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(au.auc, 6) AS auc,
  CAST(row_number() OVER (ORDER BY f1 DESC, swf.model) = 1 AS INT) AS best_by_f1,
  CAST(row_number() OVER (ORDER BY au.auc DESC, swf.model) = 1 AS INT) AS best_by_auc
FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold JOIN au ON au.model = swf.model""",
    *SWEEP_CTES, *chosen_ctes(0.80), SC_CTE, AUC_SQL)


@register("compare_models", COMPARE_SQL)
def q_compare_models(spark, sf_dir):
    return r6(M.compare_models(scored(spark, sf_dir), 0.80), ["accuracy", "precision", "recall", "f1", "auc"])


@register("argmax_row", with_views("""
SELECT model, round(f1, 6) AS f1 FROM (SELECT swf.model, f1, row_number() OVER (ORDER BY f1 DESC, swf.model) AS rn
  FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold) WHERE rn = 1""",
    *SWEEP_CTES, *chosen_ctes(0.80)))
def q_argmax_row(spark, sf_dir):
    res = M.compare_models(scored(spark, sf_dir), 0.80).where(F.col("best_by_f1") == 1)
    return r6(res.select("model", "f1"), ["f1"])


@register("default_vs_tuned", with_views("""
SELECT swf.model, 'default' AS setting, swf.threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, tp, fp, fn FROM swf WHERE swf.threshold = CAST(0.5 AS DOUBLE)
UNION ALL
SELECT swf.model, 'tuned', swf.threshold, round(precision, 6), round(recall, 6), round(f1, 6), round(accuracy, 6),
  tp, fp, fn FROM swf JOIN ch ON ch.model = swf.model AND ch.threshold = swf.threshold""",
    *SWEEP_CTES, *chosen_ctes(0.85)))
def q_default_vs_tuned(spark, sf_dir):
    return r6(M.default_vs_tuned(scored(spark, sf_dir), 0.85), ["precision", "recall", "f1", "accuracy"])
