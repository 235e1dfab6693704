"""Subscription classifiers with MLlib under a leakage-free train/test split.

Everything that is fitted (conditional probabilities, group means, one-hot
vocabulary, feature selection, scaler, model, threshold) is fitted on the
train part only and then applied to test rows or new customers; the threshold
is chosen on out-of-fold scores of the train part. (``fit_on="all"`` and
``threshold_on="test"`` give the analysed workload's own, leaking choices.)

``Training`` is the whole sequence as stages of a ``FitStore``: each is computed
when something asks for it, written to the shared folder, and found there by
any later process.
"""

from __future__ import annotations

import importlib
import itertools
import json
import math
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.operators import encode as E
from basketry.operators import features as FE
from basketry.operators import metrics as M
from basketry.operators.boosting import boosted, grouped
from basketry.operators.fits import MOST_FITS, FitStore, by_size, side_by_side
from basketry.operators.lookup import checked_broadcast, lookup_join
from basketry.operators.split import fold_column

LABEL = "label"
WEIGHT = "weight"

#: Bytes of rows' nodes that forests side by side may note, for each core.
NOTED_BYTES = 512 << 20


@dataclass
class TrainConfig:
    """Model sizes, FIXED VALUES of the analysed workload: feature selection by
    200 trees, four candidates, 5 folds, and a grid per winner."""
    select_trees: int = 200
    select_depth: int = 12
    rf_trees: int = 100
    rf_depth: int = 12
    gbt_iter: int = 100
    folds: int = 5
    lr_max_iter: int = 1000
    min_importance: float = 0.01
    fallback_top: int = 20
    min_recall: float = K.TARGET_RECALL_V2
    seed: int = 42
    fit_on: str = "train"         # or "all": lookups and selection see every row
    threshold_on: str = "folds"   # or "test": the threshold is chosen on the labels it is reported on
    grids: dict = field(default_factory=lambda: {
        "RandomForest": {"numTrees": [200, 400], "maxDepth": [8, 12, 16], "minInstancesPerNode": [1, 2]},
        "GBT": {"stepSize": [0.01, 0.05, 0.1], "maxIter": [200, 400], "maxDepth": [3, 5, 7]},
        "GBT_deep": {"stepSize": [0.01, 0.05, 0.1], "maxIter": [200, 400], "maxDepth": [4, 6, 8]},
        "LogisticRegression": {"C": [0.1, 1.0, 10.0]},
    })


def earlier_config() -> TrainConfig:
    """FIXED VALUES of the earlier variant: 100-tree selection, a
    24-point forest grid (12 here: MLlib has no minimum split size) scored by
    precision over 3 folds, recall target 0.80; lookups and selection fitted on
    all rows, thresholds on the test labels."""
    return TrainConfig(select_trees=100, folds=3, fit_on="all", threshold_on="test", min_recall=K.TARGET_RECALL_V1,
                       grids={"RandomForest": {"numTrees": [100, 200], "maxDepth": [8, 12, 16], "minInstancesPerNode": [1, 2]}})


# --------------------------------------------------------------------------- estimators
def logistic_model(n_rows: int, C: float = 1.0, max_iter: int = 1000, balanced: bool = False):
    """L2 logistic regression with sklearn's C: regParam = 1 / (C n)."""
    kw = {"weightCol": WEIGHT} if balanced else {}
    return LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=max_iter,
                              regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0,
                              standardization=False, **kw)


def random_forest_model(num_trees: int = 100, max_depth: int = 12, seed: int = 42, balanced: bool = True,
                        min_instances: int = 1):
    if max_depth > 30:
        raise ValueError("MLlib trees are at most 30 deep")
    kw = {"weightCol": WEIGHT} if balanced else {}
    return RandomForestClassifier(featuresCol="features", labelCol=LABEL, numTrees=num_trees,
                                  maxDepth=max_depth, seed=seed, minInstancesPerNode=min_instances,
                                  **kw)


def noting_nodes(estimator):
    """``estimator``, a forest among them noting the node each row is in, tree
    by tree, so no level walks the trees from the root again: the same trees in
    less time, for a fit that runs alone (a note is four bytes a row and tree,
    kept in memory and on local disks, never in the shared folder)."""
    if isinstance(estimator, RandomForestClassifier):
        return estimator.setCacheNodeIds(True).setCheckpointInterval(-1)
    return estimator


def fit_alone(estimator, rows: DataFrame):
    """One fit over ``rows``: a boosted one from grouped rows where they are few
    enough, others by MLlib's own jobs."""
    groups = grouped(rows.drop("fold"), LABEL) if boosted(estimator) else None
    if groups is None:
        return estimator.fit(rows)
    try:
        return groups.fit(estimator)
    finally:
        groups.release()


def gbt_model(max_iter: int = 100, max_depth: int = 6, step: float = 0.1, seed: int = 42):
    return GBTClassifier(featuresCol="features", labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step, seed=seed, checkpointInterval=10)  # each task carries the trees since the last one


def candidate_models(n_rows: int, cfg: TrainConfig) -> dict:
    """The four compared models (the two boosted variants are GBT configs)."""
    return {
        "LogisticRegression": logistic_model(n_rows, 1.0, cfg.lr_max_iter),
        "RandomForest": random_forest_model(cfg.rf_trees, cfg.rf_depth, cfg.seed),
        "GBT": gbt_model(cfg.gbt_iter, 6, 0.1, cfg.seed),
        "GBT_deep": gbt_model(cfg.gbt_iter, 8, 0.1, cfg.seed),
    }


def earlier_models(n_rows: int, cfg: TrainConfig) -> dict:
    """The four fixed models the earlier variant compares."""
    return {
        "LogisticRegression": logistic_model(n_rows, 1.0, cfg.lr_max_iter, balanced=True),
        "RandomForest": random_forest_model(200, 12, cfg.seed),
        "GBT": gbt_model(200, 6, 0.1, cfg.seed),
        "GBT_deep": gbt_model(200, 8, 0.1, cfg.seed),
    }


def probability(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


# --------------------------------------------------------------------------- data prep
def model_frame(df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str] = ("ROW_ID",)) -> DataFrame:
    """keep + label + weight + assembled ``features`` (nulls -> 0)."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feature_cols]
    base = df.select(*keep, F.col(LABEL).cast("double").alias(LABEL), F.col(WEIGHT), *cols)
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(base)


def add_label_weight(df: DataFrame, label_col: str = "SUBSCRIPTION_STATUS") -> DataFrame:
    out = df.withColumn(LABEL, F.coalesce(F.col(label_col) == "Yes", F.lit(False)).cast("int"))
    return E.with_class_weight(out, LABEL, WEIGHT)


# --------------------------------------------------------------------------- evaluation helpers
def auc_of(pred: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction",
                                         metricName="areaUnderROC").evaluate(pred)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The boosted model after ``rounds`` of its rounds. Boosting adds trees one
    by one, so this is the model a fit of so many rounds (and the same seed,
    depth and step) gives."""
    if rounds >= model.getNumTrees:
        return model
    sc = SparkContext.getOrCreate()
    java, jvm = model._java_obj, sc._jvm
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(jvm.double, rounds)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    short = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights))
    for p in ("featuresCol", "labelCol"):
        short._java_obj.set(short._java_obj.getParam(p), model.getOrDefault(p))
    return short


@dataclass
class Fit:
    """One estimator and the points its fit scores: (label, rounds), rounds
    being None for the model as it is."""
    estimator: object
    points: list


def grid_fits(name: str, cfg: TrainConfig, n_rows: int) -> tuple[list[tuple[str, dict]], list[Fit]]:
    """(every point of the winner's grid in order: (label, parameters); the fits
    that score them). Boosted points that differ only in their rounds share the
    longest fit; a forest's trees depend on how many there are, so each forest
    point is a fit."""
    grid = cfg.grids[name]
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    named = [(", ".join(f"{k}={v}" for k, v in sorted(p.items())), p) for p in points]
    if not name.startswith("GBT"):
        return named, [Fit(grid_model(name, p, cfg, n_rows), [(label, None)]) for label, p in named]
    shared: dict = {}
    for label, p in named:
        shared.setdefault((p["stepSize"], p["maxDepth"]), []).append((label, p["maxIter"]))
    fits = []
    for (step, depth), same in shared.items():
        longest = max(rounds for _, rounds in same)
        fits.append(Fit(gbt_model(longest, depth, step, cfg.seed), [(label, rounds if rounds < longest else None) for label, rounds in same]))
    return named, fits


def grid_model(name: str, point: dict, cfg: TrainConfig, n_rows: int):
    if name == "LogisticRegression":
        return logistic_model(n_rows, point["C"], cfg.lr_max_iter)
    if name == "RandomForest":
        return random_forest_model(point["numTrees"], point["maxDepth"], cfg.seed, min_instances=point["minInstancesPerNode"])
    return gbt_model(point["maxIter"], point["maxDepth"], point["stepSize"], cfg.seed)


def out_of_fold(data: DataFrame, fits: Sequence[Fit], folds: int, store: FitStore, name: str, at_once: int | None = None) -> DataFrame:
    """(point, fold, ROW_ID, y, p, predicted): every row of ``data`` (which has a
    ``fold`` column) scored by each point's model of the other folds. All fits
    run side by side (boosted ones from rows grouped once, where these are few
    enough; forests note their rows' nodes where there is room for all in
    flight); the scores of each are a stage of the store, so a run that was
    broken off goes on where it was."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    forests = folds * sum(isinstance(f.estimator, RandomForestClassifier) for f in fits)
    noted_trees = NOTED_BYTES * cores // (4 * max(data.count(), 1) * min(forests, MOST_FITS, at_once or 2 * cores)) if forests else 0

    found, lock = [], threading.Lock()

    def groups():
        with lock:  # made by the first boosted fit that is not stored yet
            if not found:
                found.append(grouped(data, LABEL))
        return found[0]

    def one(task):
        k, (fit, i) = task

        def write(path):
            estimator = fit.estimator
            if isinstance(estimator, RandomForestClassifier) and estimator.getNumTrees() <= noted_trees:
                estimator = noting_nodes(estimator.copy())
            few = groups() if boosted(estimator) else None
            model = few.fit(estimator, i) if few else estimator.fit(data.where(F.col("fold") != i))
            held, out = data.where(F.col("fold") == i), None
            for label, rounds in fit.points:
                scored = (model if rounds is None else first_rounds(model, rounds)).transform(held)
                scored = probability(scored).select(F.lit(label).alias("point"), "fold", "ROW_ID", F.col(LABEL).cast("int").alias("y"), "p", F.col("prediction").cast("int").alias("predicted"))
                out = scored if out is None else out.unionByName(scored)
            out.write.parquet(path)

        return store.stage(f"{name}-{k}", write)

    try:
        folders = side_by_side(data.sparkSession, enumerate([(fit, i) for fit in fits for i in range(folds)]), one, at_once)
    finally:
        for few in filter(None, found):
            few.release()
    return data.sparkSession.read.parquet(*folders)


def fold_metrics(oof: DataFrame, metric: str) -> dict:
    """{point: [metric of each fold]} from out-of-fold scores, in one job."""
    if metric == "areaUnderROC":
        rows = M.auc(oof.select(F.concat_ws("#", F.col("fold").cast("string"), "point").alias("model"), "y", "p")).collect()
        values = [(*r["model"].split("#", 1), r["auc"]) for r in rows]
    elif metric == "precision":  # of the positive class at the model's own cut
        hit = F.col("predicted") == 1
        rows = oof.groupBy("fold", "point").agg(F.coalesce(F.try_divide(F.count_if(hit & (F.col("y") == 1)), F.count_if(hit)), F.lit(0.0)).alias("v")).collect()
        values = [(r["fold"], r["point"], r["v"]) for r in rows]
    else:
        raise ValueError(f"unknown metric {metric}")
    out: dict = {}
    for fold, point, v in sorted(values, key=lambda x: int(x[0])):
        out.setdefault(point, []).append(v)
    return out


def _folded(data: DataFrame, folds: int, seed: int) -> DataFrame:
    """``data`` with its stratified folds (kept if it has them already)."""
    return data if "fold" in data.columns else fold_column(data, LABEL, "ROW_ID", folds, seed)


def cv_table(spark: SparkSession, metrics: dict, names: Sequence[str]) -> DataFrame:
    """(model, cv_auc_mean, cv_auc_std, folds, winner): the population std; the
    winner is the strictly greatest mean, the first model on ties."""
    rows = []
    for name in names:
        v = metrics[name]
        mean = sum(v) / len(v)
        rows.append((name, mean, math.sqrt(sum((s - mean) ** 2 for s in v) / len(v)), len(v)))
    best = max(rows, key=lambda r: r[1])
    return spark.createDataFrame([(*r, int(r is best)) for r in rows], "model string, cv_auc_mean double, cv_auc_std double, folds int, winner int")


def cross_validate(data: DataFrame, estimators: dict, folds: int = 5, seed: int = 42, parallelism: int | None = None) -> DataFrame:
    """``cv_table`` of the estimators: stratified folds (hash order within label;
    data that carry a ``fold`` column keep it), ROC-AUC per held-out fold."""
    spark = data.sparkSession
    rows = by_size(_folded(data, folds, seed), data.count(), len(data.first()["features"]), "ROW_ID")
    try:
        oof = out_of_fold(rows, [Fit(e, [(name, None)]) for name, e in estimators.items()], folds, FitStore(spark, uuid.uuid4().hex), "cv", parallelism)
        return cv_table(spark, fold_metrics(oof, "areaUnderROC"), list(estimators))
    finally:
        rows.unpersist()


def best_point(metrics: dict, named: Sequence[tuple[str, dict]]) -> tuple[list[tuple[str, float]], str, dict]:
    """((label, mean) of every point, label and parameters of the best, the
    first one on ties)."""
    means = [(label, sum(metrics[label]) / len(metrics[label])) for label, _ in named]
    label = max(means, key=lambda r: r[1])[0]
    return means, label, dict(named)[label]


def grid_search(data: DataFrame, name: str, cfg: TrainConfig, metric: str = "areaUnderROC", folds: int | None = None):
    """(best model, frame of (params, mean metric)) by k-fold CV over the
    configured grid of ``name``; folds are stratified hash folds."""
    spark, n, nf = data.sparkSession, data.count(), folds or cfg.folds
    rows = by_size(_folded(data, nf, cfg.seed), n, len(data.first()["features"]), "ROW_ID")
    try:
        named, fits = grid_fits(name, cfg, n)
        oof = out_of_fold(rows, fits, nf, FitStore(spark, uuid.uuid4().hex), "grid")
        means, _, point = best_point(fold_metrics(oof, metric), named)
        return fit_alone(grid_model(name, point, cfg, n), rows), spark.createDataFrame(means, "params string, cv_metric double")
    finally:
        rows.unpersist()


def feature_importance(model, names: Sequence[str], top: int | None = 20, spark=None) -> DataFrame:
    imp = model.featureImportances.toArray()
    rows = sorted(zip(names, map(float, imp)), key=lambda r: (-r[1], r[0]))
    if top:
        rows = rows[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(model, names: Sequence[str], top: int | None = 20, spark=None) -> DataFrame:
    co = model.coefficients.toArray()
    rows = sorted(((n, float(c), abs(float(c))) for n, c in zip(names, co)), key=lambda r: (-r[2], r[0]))
    if top:
        rows = rows[:top]
    out = spark.createDataFrame(rows, "feature string, coef double, abs_coef double")
    return out.select("feature", "coef", F.exp("coef").alias("odds_ratio"), "abs_coef")  # a large coefficient gives infinity


def select_features(data: DataFrame, names: Sequence[str], cfg: TrainConfig, fallback: bool = True):
    """Forest importances >= min_importance (balanced forest); when nothing
    passes, the top ``fallback_top``. Returns (kept names, importance frame)."""
    rf = noting_nodes(random_forest_model(cfg.select_trees, cfg.select_depth, cfg.seed)).fit(data)
    imp = feature_importance(rf, names, None, data.sparkSession)
    keep = [r["feature"] for r in imp.where(F.col("importance") >= cfg.min_importance).collect()]
    if not keep and fallback:
        keep = [r["feature"] for r in imp.limit(cfg.fallback_top).collect()]
    return keep, imp


# --------------------------------------------------------------------------- pipeline
RATIO_SPECS = K.RATIO_SPECS
PROB_CATS = ["CATEGORY", "SIZE", "SEASON"]
NOT_FEATURES = ["SUBSCRIPTION", "PROMO_USED_VAL"]
CLIMATE = "CLIMATE_GROUP_NEW"


@dataclass
class Lookups:
    """The fitted conditional probabilities and group means."""
    probs: object
    means: FE.GroupMeans

    def attach(self, df: DataFrame) -> DataFrame:
        """With every missing value filled from the training means."""
        return self.means.attach(FE.attach_probs(df, self.probs, F.lit(True)), F.lit(True))

    @staticmethod
    def fit(rows: DataFrame) -> "Lookups":
        return Lookups(FE.fit_group_probs(rows, CLIMATE, PROB_CATS), FE.fit_group_mean_tables(rows, RATIO_SPECS))

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.means.tables.values())).sparkSession

    def save(self, path: str):
        spark = self.spark
        meta = {"group": self.probs.group, "cats": self.probs.cats, "means": self.probs.means, "specs": self.means.specs, "overall": self.means.overall, "pairs": isinstance(self.probs, FE.PairProbs)}
        if meta["pairs"]:
            for c, fit in self.probs.fits.items():
                for part in ("pairs", "groups", "cats"):
                    getattr(fit, part).write.parquet(f"{path}/pairs/{c}/{part}")
        else:
            self.probs.table.write.parquet(f"{path}/probs")
        for g, table in self.means.tables.items():
            table.write.parquet(f"{path}/means/{g}")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Lookups":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])

        def table(p):
            return checked_broadcast(spark.read.parquet(f"{path}/{p}"))

        if meta["pairs"]:
            fits = {c: FE.ConditionalProbs(*[table(f"pairs/{c}/{part}") for part in ("pairs", "groups", "cats")]) for c in meta["cats"]}
            probs = FE.PairProbs(meta["group"], meta["cats"], fits, meta["means"])
        else:
            probs = FE.GroupProbs(meta["group"], meta["cats"], table("probs"), meta["means"])
        specs = [tuple(x) for x in meta["specs"]]
        return Lookups(probs, FE.GroupMeans(specs, {g: table(f"means/{g}") for g in dict.fromkeys(g for g, _, _ in specs)}, meta["overall"]))


@dataclass
class Scorer:
    """Everything scoring needs: lookups, chosen features, scaler, model and
    threshold. ``selected`` holds (name, position in the encoded vector, column,
    value or None for a numeric one). ``save`` writes it to a shared folder;
    ``load_scorer`` reads it back, so a scoring job or stream starts without
    training."""
    lookups: Lookups
    selected: list
    scaler: dict
    model: object = None
    model_name: str = ""
    threshold: float = K.DEFAULT_THRESHOLD

    @property
    def names(self) -> list:
        return [name for name, *_ in self.selected]

    def features(self, df: DataFrame) -> DataFrame:
        """Attach the fitted conditional probabilities and group-mean ratios."""
        return self.lookups.attach(df)

    def matrix(self, df: DataFrame, keep: Sequence[str] = ("ROW_ID",), only: Sequence[str] | None = None) -> DataFrame:
        """keep + scaled ``features``: the chosen numeric columns (missing or
        absent: 0) and indicators (of the columns in ``only``, others 0)."""
        have, cols = set(df.columns), []
        for name, _, col, value in self.selected:
            mean, scale = self.scaler[name]
            if value is None:
                x = F.coalesce(F.col(col).cast("double"), F.lit(0.0)) if col in have else F.lit(0.0)
            else:
                known = col in have and (only is None or col in only)
                x = F.coalesce(F.col(col).cast("string") == F.lit(value), F.lit(False)).cast("double") if known else F.lit(0.0)
            cols.append((x - F.lit(mean)) / F.lit(scale))
        return df.select(*keep, array_to_vector(F.array(*cols)).alias("features"))

    def score(self, df: DataFrame, keep: Sequence[str] = ("ROW_ID",), fitted: bool = False, only: Sequence[str] | None = None) -> DataFrame:
        """keep + p + decision, one row per row of ``df`` (no join on an id)."""
        rows = self.matrix(df if fitted else self.features(df), keep, only)
        return probability(self.model.transform(rows)).select(*keep, "p", (F.col("p") >= F.lit(self.threshold)).cast("int").alias("decision"))

    def save(self, path: str) -> str:
        self.lookups.save(f"{path}/lookups")
        self.model.write().save(f"{path}/model")
        meta = {"selected": self.selected, "scaler": self.scaler, "model_name": self.model_name,
                "model_class": f"{type(self.model).__module__}.{type(self.model).__name__}", "threshold": self.threshold}
        self.lookups.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("error").parquet(f"{path}/meta")
        return path


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    module, name = meta["model_class"].rsplit(".", 1)
    model = getattr(importlib.import_module(module), name).load(f"{path}/model")
    return Scorer(Lookups.load(spark, f"{path}/lookups"), [tuple(x) for x in meta["selected"]], {c: tuple(v) for c, v in meta["scaler"].items()}, model, meta["model_name"], meta["threshold"])


MODEL_KINDS = {"LogisticRegression": "LogisticRegressionModel", "RandomForest": "RandomForestClassificationModel", "GBT": "GBTClassificationModel", "GBT_deep": "GBTClassificationModel"}


def model_kind(name: str):
    return getattr(importlib.import_module("pyspark.ml.classification"), MODEL_KINDS[name])


class Training:
    """The training sequence over ``data`` (feature rows with a ``part`` column):
    lookups -> encoded rows -> selection -> scaled matrix with folds -> CV of the
    candidates -> grid of the winner -> threshold, and single fits. Every step
    is a stage of the store, made when asked for.

    ``models`` restricts the compared candidates, ``metric`` scores the grid."""

    def __init__(self, data: DataFrame, cfg: TrainConfig | None = None, models: Sequence[str] | None = None, part: str = "part",
                 metric: str = "areaUnderROC", store: FitStore | None = None, candidates=candidate_models):
        self.spark, self.data, self.cfg, self.models, self.part, self.metric = data.sparkSession, data, cfg or TrainConfig(), models, part, metric
        self.store = store or FitStore(self.spark, uuid.uuid4().hex)
        self._candidates = candidates
        self._kept: dict = {}

    def _once(self, name, build):
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    # -- lookups, encoded rows
    def _fit_rows(self) -> DataFrame:
        rows = self.data if self.cfg.fit_on == "all" else self.data.where(F.col(self.part) == "train")
        return rows.drop(self.part)

    @property
    def lookups(self) -> Lookups:
        return self._once("lookups", lambda: Lookups.load(self.spark, self.store.stage("lookups", lambda path: Lookups.fit(self._fit_rows()).save(path))))

    @property
    def encoding(self) -> dict:
        """numeric: columns of the vector's head; size: indicators behind them."""
        self.encoded
        return self._kept["encoding"]

    @property
    def vocabulary(self) -> DataFrame:
        self.encoded
        return self.spark.read.parquet(self._kept["encoded-path"] + "/vocabulary")

    @property
    def encoded(self) -> DataFrame:
        """ROW_ID, part, label, weight and the sparse vector of every feature of
        all rows: both parts in one scan."""
        def write(path):
            label = F.coalesce(F.col("SUBSCRIPTION_STATUS") == "Yes", F.lit(False)).cast("double")
            rows = self.lookups.attach(self.data).withColumn(LABEL, label)
            rows = FE.drop_leakage(E.drop_for_model(rows, K.MODEL_DROP_COLUMNS)).drop(*NOT_FEATURES)
            cats = E.categorical_columns(rows, exclude=["ROW_ID", self.part])
            numeric = E.numeric_columns(rows, exclude=["ROW_ID", LABEL])
            vocab = E.fit_vocabulary_table(rows if self.cfg.fit_on == "all" else rows.where(F.col(self.part) == "train"), cats)
            size = vocab.count()
            weights = {r[LABEL]: r["weight"] for r in E.class_weights(rows.where(F.col(self.part) == "train"), LABEL).collect()}  # a row per class
            weight = F.when(F.col(LABEL) == 1, F.lit(weights.get(1.0, 1.0))).otherwise(F.lit(weights.get(0.0, 1.0)))
            rows = rows.withColumn(WEIGHT, weight)
            E.sparse_vectors(E.indexed(rows, vocab, cats, "ROW_ID"), numeric, size, ["ROW_ID", self.part, LABEL, WEIGHT], f"{path}/rows")
            vocab.write.parquet(f"{path}/vocabulary")
            self.spark.createDataFrame([(json.dumps({"numeric": numeric, "size": size}),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")

        def load():
            path = self.store.stage("encoded", write)
            self._kept["encoded-path"] = path
            self._kept["encoding"] = json.loads(self.spark.read.parquet(f"{path}/meta").first()["meta"])
            return E.read_sparse(self.spark, f"{path}/rows")

        return self._once("encoded", load)

    # -- selection
    @property
    def importances(self) -> DataFrame:
        """(feature, importance, pos, col, value) of every encoded feature."""
        def build():
            rows = self.encoded if self.cfg.fit_on == "all" else self.encoded.where(F.col(self.part) == "train")
            enc = self.encoding
            data = by_size(rows, rows.count(), 64, "ROW_ID", alone=True)
            try:
                forest = noting_nodes(random_forest_model(self.cfg.select_trees, self.cfg.select_depth, self.cfg.seed)).fit(data)
            finally:
                data.unpersist()
            m = len(enc["numeric"])
            imp = self.spark.createDataFrame([(i, float(v)) for i, v in enumerate(forest.featureImportances.toArray())], "pos int, importance double")
            names = self.spark.createDataFrame([(i, c, c, None) for i, c in enumerate(enc["numeric"])], "pos int, feature string, col string, value string")
            hot = self.vocabulary.select((F.col("idx") + m).alias("pos"), F.concat("c", F.lit("_"), "v").alias("feature"), F.col("c").alias("col"), F.col("v").alias("value"))
            return names.unionByName(hot).join(imp, "pos").select("feature", "importance", "pos", "col", "value")
        return self.store.table("importances", build)

    @property
    def selected(self) -> list:
        """(name, position, column, value) of the features at or above the least
        importance, or of the first few where none is."""
        def build():
            imp = self.importances.orderBy(F.desc("importance"), "feature")
            kept = imp.where(F.col("importance") >= self.cfg.min_importance).collect() or imp.limit(self.cfg.fallback_top).collect()  # at most 1 / min_importance
            return [(r["feature"], r["pos"], r["col"], r["value"]) for r in kept]
        return self._once("selected", build)

    # -- matrix
    @property
    def scaler(self) -> dict:
        def build():
            a = vector_to_array("features")
            cols = [a[pos].alias(f"x{i}") for i, (_, pos, _, _) in enumerate(self.selected)]
            fit = E.fit_standardizer(self.encoded.where(F.col(self.part) == "train").select(*cols), [f"x{i}" for i in range(len(cols))])
            return {name: fit[f"x{i}"] for i, (name, *_) in enumerate(self.selected)}
        return self._once("scaler", lambda: {k: tuple(v) for k, v in self.store.value("scaler", build).items()})

    @property
    def matrix(self) -> DataFrame:
        """ROW_ID, part, label, weight, fold (train rows) and the scaled vector
        of the selected features, dense."""
        def build():
            a, scaler = F.col("_a"), self.scaler
            vec = F.array(*[(a[pos] - F.lit(scaler[name][0])) / F.lit(scaler[name][1]) for name, pos, _, _ in self.selected])
            rows = self.encoded.select("ROW_ID", self.part, LABEL, WEIGHT, vector_to_array("features").alias("_a")).select("ROW_ID", self.part, LABEL, WEIGHT, vec.alias("x"))
            train = fold_column(rows.where(F.col(self.part) == "train"), LABEL, "ROW_ID", self.cfg.folds, self.cfg.seed)
            test = rows.where(F.col(self.part) != "train").withColumn("fold", F.lit(None).cast("int")).withColumn(WEIGHT, F.lit(1.0))  # test rows are never weighted
            return train.unionByName(test)
        return self._once("matrix", lambda: self.store.table("matrix", build).withColumn("features", array_to_vector("x")).drop("x"))

    def _train_rows(self) -> tuple[DataFrame, int]:
        """The train part of the matrix, persisted for all fits of this object."""
        def build():
            rows = self.matrix.where(F.col(self.part) == "train").drop(self.part)
            n = rows.count()
            return by_size(rows, n, len(self.selected), "ROW_ID"), n
        return self._once("train", build)

    def release(self):
        """Give the persisted train rows back; stages stay."""
        if "train" in self._kept:
            self._kept.pop("train")[0].unpersist()

    # -- comparison, grid
    def estimators(self) -> dict:
        _, n = self._train_rows()
        every = self._candidates(n, self.cfg)
        return {k: v for k, v in every.items() if not self.models or k in self.models}

    def cv_scores(self) -> DataFrame:
        """Out-of-fold scores of every candidate (point: its name)."""
        rows, _ = self._train_rows()
        return out_of_fold(rows, [Fit(e, [(name, None)]) for name, e in self.estimators().items()], self.cfg.folds, self.store, "cv-fit")

    @property
    def cv(self) -> DataFrame:
        names = list(self._candidates(1, self.cfg)) if not self.models else list(self.models)
        return self.store.table("cv-table", lambda: cv_table(self.spark, fold_metrics(self.cv_scores(), "areaUnderROC"), names))

    @property
    def winner(self) -> str:
        """The best candidate; a single one needs no comparison."""
        if self.models and len(self.models) == 1:
            return self.models[0]
        return self._once("winner", lambda: self.cv.where(F.col("winner") == 1).first()["model"])

    def grid_scores(self) -> DataFrame:
        """Out-of-fold scores of every point of the winner's grid."""
        rows, n = self._train_rows()
        return out_of_fold(rows, grid_fits(self.winner, self.cfg, n)[1], self.cfg.folds, self.store, f"grid-{self.winner}-fit")

    def _best(self) -> dict:
        def build():
            means, label, point = best_point(fold_metrics(self.grid_scores(), self.metric), grid_fits(self.winner, self.cfg, 1)[0])
            return {"means": means, "label": label, "point": point}
        return self._once("best", lambda: self.store.value(f"best-{self.winner}-{self.metric}", build))

    @property
    def grid(self) -> DataFrame:
        """(params, cv_metric) of every point of the winner's grid."""
        return self.spark.createDataFrame([tuple(x) for x in self._best()["means"]], "params string, cv_metric double")

    @property
    def best_model(self):
        def build():
            rows, n = self._train_rows()
            return fit_alone(grid_model(self.winner, self._best()["point"], self.cfg, n), rows)
        return self._once("best-model", lambda: self.store.model(f"best-model-{self.winner}-{self.metric}", model_kind(self.winner), build))

    def _test_rows(self) -> DataFrame:
        return self.matrix.where(F.col(self.part) != "train")

    @property
    def scored_test(self) -> DataFrame:
        return self.store.table(f"scored-test-{self.winner}-{self.metric}", lambda: scored_frame(self.best_model, self.winner, self._test_rows()))

    @property
    def oof(self) -> DataFrame:
        """(ROW_ID, model, y, p): the best point's scores of the train rows, each
        by the model that did not see its fold."""
        def build():
            return self.grid_scores().where(F.col("point") == self._best()["label"]).select("ROW_ID", F.lit(self.winner).alias("model"), "y", "p")
        return self.store.table(f"oof-{self.winner}-{self.metric}", build)

    @property
    def threshold(self) -> float:
        """Chosen on out-of-fold scores; with ``threshold_on="test"`` on the test
        labels it is then reported on."""
        def build():
            rows = self.scored_test if self.cfg.threshold_on == "test" else self.oof
            best = M.best_threshold(M.threshold_sweep(rows), self.cfg.min_recall).first()
            return float(best["threshold"]) if best else K.DEFAULT_THRESHOLD
        return self._once("threshold", lambda: self.store.value(f"threshold-{self.winner}-{self.metric}-{self.cfg.threshold_on}", build))

    @property
    def scorer(self) -> Scorer:
        return self._once("scorer", lambda: Scorer(self.lookups, self.selected, self.scaler, self.best_model, self.winner, self.threshold))

    def saved_scorer(self) -> str:
        return self.store.stage(f"scorer-{self.metric}-{self.cfg.threshold_on}", lambda path: self.scorer.save(path))

    # -- single fits
    def fitted(self, name: str):
        """One candidate fitted on the whole train part."""
        def build():
            rows, n = self._train_rows()
            return fit_alone(noting_nodes(self._candidates(n, self.cfg)[name]), rows)
        return self._once(f"fit-{name}", lambda: self.store.model(f"fit-{name}", model_kind(name), build))

    def fitted_scores(self, names: Sequence[str] | None = None) -> DataFrame:
        """(ROW_ID, model, y, p) of the test part by each candidate fitted on the
        whole train part: what ``compare_models`` compares."""
        names = list(names or self._candidates(1, self.cfg))
        self._train_rows()  # persisted once, before the fits go side by side
        tables = side_by_side(self.spark, names, lambda name: self.store.table(f"scores-{name}", lambda: scored_frame(self.fitted(name), name, self._test_rows())))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def report(self) -> DataFrame:
        """The test part at the chosen threshold: model, threshold, accuracy,
        precision, recall, f1, auc, n_features."""
        at = M.threshold_sweep(self.scored_test, [self.threshold])
        return at.join(M.auc(self.scored_test), "model").select("model", "threshold", "accuracy", "precision", "recall", "f1", "auc", F.lit(len(self.selected)).alias("n_features"))


def scored_frame(model, name: str, rows: DataFrame) -> DataFrame:
    return probability(model.transform(rows)).select("ROW_ID", F.lit(name).alias("model"), F.col(LABEL).cast("int").alias("y"), "p")


def train_pipeline(feat_split: DataFrame, cfg: TrainConfig | None = None, models: Sequence[str] | None = None,
                   part: str = "part", metric: str = "areaUnderROC", store: FitStore | None = None) -> Training:
    """The whole sequence fitted on the train part and the test part scored; the
    winner's grid is scored by ``metric``."""
    t = Training(feat_split, cfg, models, part, metric, store)
    t.scorer, t.scored_test  # every stage up to the threshold
    t.release()
    return t


def fitted_scores(trained: Training, names: Sequence[str] | None = None) -> DataFrame:
    return trained.fitted_scores(names)


def score_customers(scorer: Scorer, candidates: DataFrame, keep: Sequence[str] = ("ROW_ID",)) -> DataFrame:
    """(keep..., p, decision) for new customers given as feature rows (the
    output of ``derive_features``): same fitted transforms as the test part."""
    return scorer.score(candidates, keep)


# FIXED VALUES — the candidate form's simplified features: frequency of an
# unknown text, and the loyalty score cut (strict <)
CANDIDATE_FREQ_DEFAULT = 12
CANDIDATE_LOYALTY_CUTS = [(13, 1), (25, 2), (38, 3)]
CANDIDATE_LOYALTY_ELSE = 4


def candidate_features(cands: DataFrame) -> DataFrame:
    """Simplified features of raw candidate rows (shop-shaped): spend
    features, frequency (unknown -> 12), own loyalty cut, rating flags,
    promo interactions, and the raw GENDER / CATEGORY for one-hot."""
    from basketry.functions.exprs import lookup, yes_flag
    amt, prev = F.col("PURCHASE_AMOUNT_USD").cast("double"), F.col("PREVIOUS_PURCHASES").cast("double")
    freq = F.coalesce(lookup("FREQUENCY_OF_PURCHASES", K.FREQUENCY_PER_YEAR), F.lit(CANDIDATE_FREQ_DEFAULT))
    loyal = F.lit(CANDIDATE_LOYALTY_ELSE)
    for cut, score in reversed(CANDIDATE_LOYALTY_CUTS):
        loyal = F.when(prev < cut, F.lit(score)).otherwise(loyal)
    promo = yes_flag("PROMO_CODE_USED")
    rating = F.col("REVIEW_RATING").cast("double")
    return cands.select(
        "ROW_ID", "GENDER", "CATEGORY", "PURCHASE_AMOUNT_USD", "PREVIOUS_PURCHASES",
        (prev * amt).alias("TOTAL_SPEND_WEIGHTED_NEW"), F.try_divide(amt, prev + 1).alias("SPEND_PER_PURCHASE_NEW"),
        freq.alias("FREQUENCY_VALUE_NEW"), loyal.alias("LOYALTY_SCORE_NEW"),
        F.coalesce(rating >= 4, F.lit(False)).cast("int").alias("HIGH_REVIEW_RATING_NEW"),
        (amt * rating).alias("SPEND_RATING_NEW"), (promo * loyal).alias("PROMO_X_LOYALTY"),
        (promo * freq).alias("PROMO_X_FREQ"))


def score_candidates(scorer: Scorer, cands: DataFrame, seg_model=None, seg_scaler=None,
                     seg_names: DataFrame | None = None) -> DataFrame:
    """(ROW_ID, p, decision[, segment, segment_name]) for raw candidate rows:
    simplified features, one-hot of GENDER and CATEGORY, every other trained
    column 0, the trained scaler and model, then the nearest k-means segment
    (segmentation scaler) and its name. One projection of each row."""
    from basketry.operators import segments as SG
    f = candidate_features(cands)
    keep = ["ROW_ID"]
    if seg_model is not None:
        f = SG.add_segment(f, SG.centroids_table(seg_model), SG.SEGMENT_FEATURES, seg_scaler, "segment")
        keep.append("segment")
    out = scorer.score(f, keep, fitted=True, only=("GENDER", "CATEGORY"))
    return out if seg_names is None else lookup_join(out, seg_names, ["segment"])
