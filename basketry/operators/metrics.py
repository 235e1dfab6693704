"""Classifier evaluation on a scored frame (model, y, p) as aggregations.

Every metric is computed from per-(model, score bucket, label) counts: the
rows are read once, partially aggregated, and everything after runs on at most
(#models x #buckets) rows. No threshold x row product is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.operators.lookup import checked_broadcast
from basketry.operators.ranking import running_sums


def threshold_grid(steps: int = K.THRESHOLD_STEPS, step: float = K.THRESHOLD_STEP) -> list[float]:
    """0.05, 0.10, ..., 0.95 (each rounded to 2 decimals)."""
    return [round(step * i, 2) for i in range(1, steps + 1)]


def bucket_index(p: Column, grid: Sequence[float]) -> Column:
    """Number of grid thresholds t with p >= t (0..len(grid))."""
    expr = F.lit(0)
    for i, t in enumerate(grid, start=1):
        expr = F.when(p >= F.lit(float(t)), F.lit(i)).otherwise(expr)
    return expr


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def _with_metrics(df: DataFrame) -> DataFrame:
    """Add precision / recall / f1 / accuracy from tp, fp, pos, neg."""
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    prec = _safe(tp, tp + fp)
    rec = _safe(tp, pos)
    df = df.withColumns({"fn": pos - tp, "tn": neg - fp, "precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return df.withColumns({"f1": f1, "accuracy": _safe(tp + F.col("tn"), pos + neg)})


def bucket_counts(scored: DataFrame, grid: Sequence[float], model: str = "model",
                  y: str = "y", p: str = "p") -> DataFrame:
    """(model, b, pos, neg) per score bucket (partial aggregation)."""
    yy = F.col(y).cast("long")
    return (scored.select(model, bucket_index(F.col(p), grid).alias("b"), yy.alias("_y"))
            .groupBy(model, "b").agg(F.sum("_y").alias("pos"),
                                     F.sum(1 - F.col("_y")).alias("neg")))


def threshold_sweep(scored: DataFrame, grid: Sequence[float] | None = None, model: str = "model",
                    y: str = "y", p: str = "p") -> DataFrame:
    """(model, threshold, tp, fp, pos, neg, fn, tn, precision, recall, f1,
    accuracy) for each grid threshold; predicted positive when p >= t.

    One scan: rows -> (model, bucket) counts (partial aggregation) -> one array
    of at most len(grid)+1 bucket counts per model -> every threshold's suffix
    sums from that array. No join back, no window, no rows x thresholds."""
    grid = list(grid) if grid is not None else threshold_grid()
    counts = bucket_counts(scored, grid, model, y, p)
    per_model = counts.groupBy(model).agg(F.collect_list(F.struct("b", "pos", "neg")).alias("_c"))
    tarr = F.array(*[F.lit(float(t)) for t in grid])
    i = F.col("i")

    def suffix(field: str):
        return F.aggregate(F.filter("_c", lambda x: x["b"] >= i), F.lit(0).cast("long"),
                           lambda acc, x: acc + x[field])

    out = (per_model.select(model, "_c", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("i"))
           .select(model, F.element_at(tarr, i).alias("threshold"), suffix("pos").alias("tp"),
                   suffix("neg").alias("fp"),
                   F.aggregate("_c", F.lit(0).cast("long"), lambda acc, x: acc + x["pos"]).alias("pos"),
                   F.aggregate("_c", F.lit(0).cast("long"), lambda acc, x: acc + x["neg"]).alias("neg")))
    return _with_metrics(out)


def best_threshold(sweep: DataFrame, min_recall: float = K.TARGET_RECALL_V2,
                   default: float = K.DEFAULT_THRESHOLD, model: str = "model") -> DataFrame:
    """Per model: among thresholds with recall >= min_recall the one with the
    highest precision (lowest threshold on ties); none -> ``default``. Returns
    the sweep row of the chosen threshold plus ``met`` (1 if the target held)."""
    rest = [c for c in sweep.columns if c not in (model, "threshold")]
    line = F.struct("threshold", *rest)
    met = F.col("recall") >= F.lit(min_recall)
    # one aggregate: the best row that meets the target, else the default's row
    pick = sweep.groupBy(model).agg(
        F.min_by(F.when(met, line), F.when(met, F.struct((-F.col("precision")).alias("np"), F.col("threshold").alias("t")))).alias("_b"),
        F.max(F.when(F.col("threshold") == F.lit(float(default)), line)).alias("_d"))
    return (pick.select(model, F.coalesce("_b", "_d").alias("_r"), F.col("_b").isNotNull().cast("int").alias("met"))
            .where("_r is not null").select(model, "_r.*", "met"))


def confusion_matrix(scored: DataFrame, thresholds: DataFrame | float, model: str = "model",
                     y: str = "y", p: str = "p") -> DataFrame:
    """(model, actual, predicted, n) — all four cells, zeros included.
    ``thresholds`` is one float or a (model, threshold) frame."""
    if isinstance(thresholds, (int, float)):
        t = F.lit(float(thresholds))
        src = scored
    else:
        src = scored.join(checked_broadcast(thresholds.select(model, "threshold")), model)
        t = F.col("threshold")
    pred = (F.col(p) >= t).cast("int")
    cells = src.groupBy(model, F.col(y).cast("int").alias("actual"), pred.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = (scored.select(model).distinct()
            .select(model, F.explode(F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"))
                                               for a in (0, 1) for b in (0, 1)])).alias("c"))
            .select(model, "c.actual", "c.predicted"))
    return (grid.join(cells, [model, "actual", "predicted"], "left")
            .select(model, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def score_counts(scored: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """(model, score, pos, neg) per distinct score."""
    yy = F.col(y).cast("long")
    return (scored.select(model, F.col(p).alias("score"), yy.alias("_y")).groupBy(model, "score")
            .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")))


def roc_curve(scored: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """(model, score, fpr, tpr) at every distinct score (descending), plus the
    (0, 0) start point with a null score."""
    c = score_counts(scored, model, y, p)
    cum = running_sums(c, [model], "score", ["pos", "neg"], descending=True)
    tot = c.groupBy(model).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.join(checked_broadcast(tot), model).select(
        model, "score", _safe(F.col("cum_neg"), F.col("N")).alias("fpr"),
        _safe(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = tot.select(model, F.lit(None).cast("double").alias("score"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def auc(scored: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """(model, auc): trapezoid area under the ROC curve, i.e. the Mann-Whitney
    probability with ties counted one half."""
    c = score_counts(scored, model, y, p)
    above = running_sums(c, [model], "score", ["pos"], descending=True, inclusive=False, prefix="above_")
    part = above.select(model, "pos", "neg", (F.col("neg") * (F.col("above_pos") + F.col("pos") / 2.0)).alias("_u"))
    return part.groupBy(model).agg(
        (F.sum("_u") / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def classification_report(scored: DataFrame, thresholds: DataFrame | float, model: str = "model",
                          y: str = "y", p: str = "p") -> DataFrame:
    """(model, label, precision, recall, f1, support) for classes 0 and 1,
    'accuracy' (f1 column holds the accuracy), 'macro avg', 'weighted avg'.
    ``thresholds`` is one float or a (model, threshold) frame."""
    if isinstance(thresholds, (int, float)):
        src, t = scored, F.lit(float(thresholds))
    else:
        src, t = scored.join(checked_broadcast(thresholds.select(model, "threshold")), model), F.col("threshold")
    yes, hit = F.col(y) == 1, F.col(p) >= t
    cells = src.groupBy(model).agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
                                   F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    return report_rows(cells, model)


def tuned_report(scored: DataFrame, min_recall: float = K.TARGET_RECALL_V2, default: float = K.DEFAULT_THRESHOLD,
                 model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """``classification_report`` at each model's own best threshold, from one
    scan: the sweep's counts at the chosen threshold are the report's cells."""
    best = best_threshold(threshold_sweep(scored, None, model, y, p), min_recall, default, model)
    return report_rows(best.select(model, "tp", "fp", "fn", "tn"), model)


def report_rows(cells: DataFrame, model: str = "model") -> DataFrame:
    """Five report rows of every (model, tp, fp, fn, tn)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def rates(hit, false, missed):
        pr, rc = _safe(hit, hit + false), _safe(hit, hit + missed)
        return pr, rc, F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    def row(label, pr, rc, f1, support):
        return F.struct(F.lit(label).alias("label"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), support.alias("support"))

    neg, pos = rates(tn, fn, fp), rates(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    none = F.lit(None).cast("double")
    rows = [row("0", *neg, n0), row("1", *pos, n1), row("accuracy", none, none, (tp + tn) / (n0 + n1), n0 + n1),
            row("macro avg", *[(a + b) / 2 for a, b in zip(neg, pos)], n0 + n1),
            row("weighted avg", *[(a * n0 + b * n1) / (n0 + n1) for a, b in zip(neg, pos)], n0 + n1)]
    return cells.select(model, F.explode(F.array(*rows)).alias("r")).select(model, "r.*")


def compare_models(scored: DataFrame, min_recall: float = K.TARGET_RECALL_V1, model: str = "model",
                   y: str = "y", p: str = "p") -> DataFrame:
    """Per model at its own best threshold: threshold, accuracy, precision,
    recall, f1, auc, and flags for the best model by F1 and by AUC (first model
    name wins ties)."""
    best = best_threshold(threshold_sweep(scored, None, model, y, p), min_recall, model=model)
    res = best.join(auc(scored, model, y, p), model).select(
        model, "threshold", "accuracy", "precision", "recall", "f1", "auc")
    return (res.withColumn("best_by_f1", argmax_flag("f1", model))
               .withColumn("best_by_auc", argmax_flag("auc", model)))


def argmax_flag(metric: str, order_key: str) -> Column:
    """1 on the first row (by ``order_key``) holding the maximum of ``metric``.
    Applied to per-model frames (a handful of rows), never to raw rows."""
    w = Window.orderBy(F.desc(metric), F.asc(order_key))
    return (F.row_number().over(w) == 1).cast("int")


def default_vs_tuned(scored: DataFrame, min_recall: float = K.TARGET_RECALL_V2,
                     default: float = K.DEFAULT_THRESHOLD, model: str = "model") -> DataFrame:
    """Metrics at the default threshold beside metrics at the tuned one."""
    sweep = threshold_sweep(scored, None, model)
    tuned = best_threshold(sweep, min_recall, default, model).withColumn("setting", F.lit("tuned"))
    base = sweep.where(F.col("threshold") == F.lit(float(default))).withColumn("setting", F.lit("default"))
    cols = [model, "setting", "threshold", "precision", "recall", "f1", "accuracy", "tp", "fp", "fn"]
    return base.select(*cols).unionByName(tuned.select(*cols))
