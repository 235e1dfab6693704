"""Registered queries: segmentation and classifier fits (M1-M5, M18-M28, E7,
F4, T3) — rows-only checks, plus the steps that SQL can express (M2, the chord
of M3) with an oracle.

Feature selection, the compared models, folds, restarts and every grid have
the workload's own sizes. Each training query computes the stages it needs and
no more; stages stay in the shared folder for every later query and process.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import metrics as M
from basketry.operators import models as MD
from basketry.operators import segments as SG
from basketry.operators.fits import FitStore
from basketry.plans import views
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register
from basketry.plans.sql_features import feat_ctes, segf_cte
from basketry.session import scratch_path

B_SEGMENT_FEATURES = ["FREQUENCY_VALUE_NEW", "SPEND_PER_PURCHASE_NEW", "LOYALTY_SCORE_NEW"]


_memo = views.remembered


def training(spark, sf_dir) -> MD.Training:
    """The workload's training sequence; each query asks for the stages it needs."""
    return _training(spark, sf_dir, "training", MD.TrainConfig())


def training_earlier(spark, sf_dir) -> MD.Training:
    """The earlier variant: its forest, tuned by precision; its own four models."""
    return _training(spark, sf_dir, "training-earlier", MD.earlier_config(), models=["RandomForest"], metric="precision", candidates=MD.earlier_models)


def _training(spark, sf_dir, name, cfg, **kw) -> MD.Training:
    def build():
        store = FitStore(spark, views.data_stamp(spark, sf_dir), sf_dir.rstrip("/"), name, repr(cfg))
        return MD.Training(views.feat_split(spark, sf_dir), cfg, store=store, **kw)
    return _memo(spark, sf_dir, name, build)


def segmented(spark, sf_dir):
    return _memo(spark, sf_dir, "kmeans", lambda: SG.kmeans_segments(views.feat(spark, sf_dir), k=5, restarts=10))


@register("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    return segmented(spark, sf_dir)[1]


@register("elbow_k")
def q_elbow_k(spark, sf_dir):
    curve = SG.elbow_inertias(views.feat(spark, sf_dir), B_SEGMENT_FEATURES, range(2, 11))
    return SG.elbow_k(spark.createDataFrame(curve, "k int, inertia double"))


@register("elbow_segments")
def q_elbow_segments(spark, sf_dir):
    """The earlier variant: k chosen by the elbow, then segmented with it."""
    k, _, out, _ = SG.elbow_segments(views.feat(spark, sf_dir), B_SEGMENT_FEATURES)
    return out.withColumn("k", F.lit(k))


# the curve the chord step is checked on: rows per year of age as its inertias
@register("elbow_chord", with_views("""
SELECT k, inertia, round(d, 6) AS chord_distance, CAST(row_number() OVER (ORDER BY d DESC, k) = 1 AS INT) AS is_elbow FROM (
  SELECT k, inertia, abs((x2 - x1) * (y1 - inertia) - (x1 - k) * (y2 - y1)) / sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS d
  FROM c CROSS JOIN (SELECT min(k) AS x1, max(k) AS x2, arg_min(inertia, k) AS y1, arg_max(inertia, k) AS y2 FROM c))""",
    "c AS (SELECT CAST(PREVIOUS_PURCHASES AS INT) AS k, CAST(count(*) AS DOUBLE) AS inertia FROM shop GROUP BY 1)"))
def q_elbow_chord(spark, sf_dir):
    curve = views.shop(spark, sf_dir).groupBy(F.col("PREVIOUS_PURCHASES").cast("int").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("inertia"))
    return SG.elbow_k(curve).withColumn("chord_distance", F.round("chord_distance", 6))


@register("silhouette")
def q_silhouette(spark, sf_dir):
    model, clusters, scaler = segmented(spark, sf_dir)
    vec, _ = SG.segmentation_matrix(views.feat(spark, sf_dir), scaler=scaler)
    value = SG.silhouette(model.transform(vec))
    return spark.createDataFrame([(value, "squaredEuclidean")], "silhouette double, distance string")


@register("pca_project")
def q_pca_project(spark, sf_dir):
    _, _, scaler = segmented(spark, sf_dir)
    vec, _ = SG.segmentation_matrix(views.feat(spark, sf_dir), scaler=scaler)
    proj, _ = SG.pca_project(vec, 2)
    return proj


@register("pca_project_3")
def q_pca_project_3(spark, sf_dir):
    """Three components beside each row's segment."""
    _, clusters, scaler = segmented(spark, sf_dir)
    model = segmented(spark, sf_dir)[0]
    f = SG.add_segment(views.feat(spark, sf_dir), SG.centroids_table(model), SG.SEGMENT_FEATURES, scaler, "Cluster")
    vec, _ = SG.segmentation_matrix(f, scaler=scaler, keep=("ROW_ID", "Cluster"))
    return SG.pca_project(vec, 3, keep=("ROW_ID", "Cluster"))[0]


@register("pca_explained_variance")
def q_pca_explained_variance(spark, sf_dir):
    _, _, scaler = segmented(spark, sf_dir)
    vec, _ = SG.segmentation_matrix(views.feat(spark, sf_dir), scaler=scaler)
    _, ev = SG.pca_project(vec, 3)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ev)], "component int, ratio double")


FEATS = SG.SEGMENT_FEATURES


def _z_ctes():
    """The fixed segments' rows with z-scored behaviour features."""
    z = ", ".join(f"(coalesce(CAST({c} AS DOUBLE), 0) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS z_{c}"
                  for c in FEATS)
    mom = ", ".join(f"avg(coalesce(CAST({c} AS DOUBLE), 0)) AS m_{c}, stddev_pop(coalesce(CAST({c} AS DOUBLE), 0)) AS s_{c}"
                    for c in FEATS)
    return [*feat_ctes(), segf_cte(), f"mo AS (SELECT {mom} FROM segf)", f"zz AS (SELECT ROW_ID, Cluster, {z} FROM segf CROSS JOIN mo)"]


def _nearest_sql():
    cen = ", ".join(f"avg(z_{c}) AS c_{c}" for c in FEATS)
    dist = " + ".join(f"power(z.z_{c} - c.c_{c}, 2)" for c in FEATS)
    return with_views(f"""
SELECT ROW_ID, CAST(Cluster AS INT) AS nearest FROM (
  SELECT z.ROW_ID, c.Cluster, row_number() OVER (PARTITION BY z.ROW_ID ORDER BY {dist}, c.Cluster) AS rn
  FROM zz z CROSS JOIN cen c) WHERE rn = 1""", *_z_ctes(), f"cen AS (SELECT Cluster, {cen} FROM zz GROUP BY Cluster)")


def _silhouette_sql():
    dist = " + ".join(f"power(x.z_{c} - q.z_{c}, 2)" for c in FEATS)
    return with_views("""
SELECT ROW_ID, CAST(own AS INT) AS Cluster, round(CASE WHEN n = 1 OR b IS NULL THEN 0 ELSE coalesce((b - s / (n - 1)) / nullif(greatest(s / (n - 1), b), 0), 0) END, 6) AS silhouette FROM (
  SELECT ROW_ID, own, max(CASE WHEN c = own THEN s END) AS s, max(CASE WHEN c = own THEN n END) AS n, min(CASE WHEN c <> own THEN s / n END) AS b FROM d GROUP BY ROW_ID, own)""",
        *_z_ctes(), f"d AS (SELECT q.ROW_ID, q.Cluster AS own, x.Cluster AS c, sum(sqrt({dist})) AS s, CAST(count(*) AS DOUBLE) AS n FROM zz q CROSS JOIN zz x WHERE q.ROW_ID % 20 = 0 GROUP BY ALL)")


@register("silhouette_points", _silhouette_sql())
def q_silhouette_points(spark, sf_dir):
    """Euclidean silhouette in the fixed segments of every row whose id is
    divisible by 20, against all rows."""
    vec, _ = SG.segmentation_matrix(views.seg(spark, sf_dir), FEATS, keep=("ROW_ID", "Cluster"))
    out = SG.silhouette_euclidean(vec, FEATS)
    return out.select("ROW_ID", F.col("Cluster").cast("int").alias("Cluster"), F.round("silhouette", 6).alias("silhouette"))


@register("silhouette_euclidean")
def q_silhouette_euclidean(spark, sf_dir):
    """The mean Euclidean silhouette of the k-means segments, over the rows
    whose id is divisible by 20."""
    model, _, scaler = segmented(spark, sf_dir)
    vec, _ = SG.segmentation_matrix(views.feat(spark, sf_dir), scaler=scaler)
    out = SG.silhouette_euclidean(model.transform(vec), FEATS)
    return out.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n_points")).withColumn("distance", F.lit("euclidean"))


@register("assign_nearest", _nearest_sql())
def q_assign_nearest(spark, sf_dir):
    """Rows assigned to the nearest of the fixed segments' centroids (in the
    z-scored behaviour space)."""
    seg = views.seg(spark, sf_dir)
    vec, scaler = SG.segmentation_matrix(seg, FEATS, keep=("ROW_ID", "Cluster"))
    cents = vec.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in FEATS]).orderBy("Cluster").collect()
    ids = [r["Cluster"] for r in cents]
    out = SG.assign_nearest(vec, [[r[c] for c in FEATS] for r in cents], FEATS, "_idx")
    idmap = F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("_idx") + 1)
    return out.select("ROW_ID", idmap.cast("int").alias("nearest"))


def _one(spark, sf_dir, model):
    return training(spark, sf_dir).fitted_scores([model]).select("ROW_ID", "y", "p")


@register("logistic_model")
def q_logistic_model(spark, sf_dir):
    """On the selected, scaled features, like the other two."""
    return _one(spark, sf_dir, "LogisticRegression")


@register("random_forest_model")
def q_random_forest_model(spark, sf_dir):
    return _one(spark, sf_dir, "RandomForest")


@register("gbt_model")
def q_gbt_model(spark, sf_dir):
    return _one(spark, sf_dir, "GBT")


@register("compare_fitted_models")
def q_compare_fitted_models(spark, sf_dir):
    """The four compared models, each fitted on the train part and scored on
    the test part, at its own best threshold."""
    t = training(spark, sf_dir)
    return M.compare_models(t.fitted_scores(), t.cfg.min_recall)


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    return training(spark, sf_dir).cv


@register("grid_search")
def q_grid_search(spark, sf_dir):
    return training(spark, sf_dir).grid


@register("select_features")
def q_select_features(spark, sf_dir):
    t = training(spark, sf_dir)
    return t.importances.where(F.col("feature").isin([name for name, *_ in t.selected])).select("feature", "importance")


@register("keep_important")
def q_keep_important(spark, sf_dir):
    return training(spark, sf_dir).importances.where(F.col("importance") >= 0.01).select("feature", "importance")


@register("topk_features")
def q_topk_features(spark, sf_dir):
    return training(spark, sf_dir).importances.orderBy(F.desc("importance"), "feature").limit(20).select("feature", "importance")


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Of the compared forest, over the selected features."""
    t = training(spark, sf_dir)
    return MD.feature_importance(t.fitted("RandomForest"), [name for name, *_ in t.selected], None, spark)


@register("coefficients")
def q_coefficients(spark, sf_dir):
    """Of the compared logistic model, on scaled features: sizes compare."""
    t = training(spark, sf_dir)
    return MD.coefficients(t.fitted("LogisticRegression"), [name for name, *_ in t.selected], 20, spark)


@register("train_pipeline")
def q_train_pipeline(spark, sf_dir):
    """The tuned winner on the test part, at the threshold of its out-of-fold scores."""
    return training(spark, sf_dir).report()


@register("grid_search_precision")
def q_grid_search_precision(spark, sf_dir):
    """Earlier variant: balanced random forest grid, 3 folds, scored by the
    positive class's precision (on its own selected, scaled train features)."""
    return training_earlier(spark, sf_dir).grid


@register("compare_earlier_models")
def q_compare_earlier_models(spark, sf_dir):
    """Earlier variant: its four fixed models on its own selection, each at its
    best threshold of recall 0.80."""
    t = training_earlier(spark, sf_dir)
    return M.compare_models(t.fitted_scores(), t.cfg.min_recall)


def saved_scorer(spark, sf_dir) -> str:
    """The fitted pipeline in the shared folder, written once."""
    return training(spark, sf_dir).saved_scorer()


def _with_segment(spark, sf_dir, rows):
    model, _, scaler = segmented(spark, sf_dir)
    return SG.add_segment(rows, SG.centroids_table(model), SG.SEGMENT_FEATURES, scaler, "segment")


@register("score_customers")
def q_score_customers(spark, sf_dir):
    """Every customer through the pipeline as saved and loaded, with the
    nearest segment: projections and small lookups of one row each."""
    scorer = MD.load_scorer(spark, saved_scorer(spark, sf_dir))
    rows = _with_segment(spark, sf_dir, views.feat(spark, sf_dir))
    return MD.score_customers(scorer, rows, keep=("ROW_ID", "segment"))


@register("score_stream")
def q_score_stream(spark, sf_dir):
    """Customers arrive as parquet files; a Structured Streaming job loads the
    saved pipeline and scores them into a parquet sink."""
    from basketry.streaming.scoring import run_score_stream
    cands = views.feat(spark, sf_dir)
    src = scratch_path(spark, "candidates")
    cands.write.parquet(src)
    return spark.read.parquet(run_score_stream(spark, saved_scorer(spark, sf_dir), src, cands.schema))


@register("score_candidates")
def q_score_candidates(spark, sf_dir):
    """Candidate form as a table: all shoppers' raw rows through the simplified
    candidate features, the trained model and the k-means segments (named by
    their rank in mean weighted spend)."""
    from basketry.operators import crm as C
    scorer = MD.load_scorer(spark, saved_scorer(spark, sf_dir))
    model, _, scaler = segmented(spark, sf_dir)
    prof = C.segment_profile(_with_segment(spark, sf_dir, views.feat(spark, sf_dir)).withColumnRenamed("segment", "Cluster"))
    names = prof.select(F.col("Cluster").alias("segment"), "segment_name")
    return MD.score_candidates(scorer, views.shop(spark, sf_dir), model, scaler, names)
