"""Invariants of the fitted parts (no numeric oracle for model fits)."""

import pytest
from pyspark.sql import functions as F

from sf_dirs import SF001

import __spark_entry__ as entry
from basketry.operators import metrics as M


@pytest.fixture(scope="module")
def q():
    return entry.queries()


def test_kmeans_labels(spark, q):
    df = q["kmeans_segments"](spark, SF001)
    labels = {r[0] for r in df.select("Cluster").distinct().collect()}
    assert labels == set(range(5))
    assert df.count() == q["shop_view"](spark, SF001).count()


def test_elbow_curve(spark, q):
    rows = q["elbow_k"](spark, SF001).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(2, 11))
    assert sum(r.is_elbow for r in rows) == 1
    assert all(a.inertia > b.inertia for a, b in zip(rows, rows[1:]))


def test_pipeline_outputs(spark, q):
    imp = q["select_features"](spark, SF001).collect()
    assert imp and all(r.importance >= 0.01 for r in imp)
    cv = q["cross_validate"](spark, SF001).collect()
    assert sum(r.winner for r in cv) == 1 and all(0 <= r.cv_auc_mean <= 1 for r in cv)
    rep = q["train_pipeline"](spark, SF001).first()
    assert 0.0 <= rep.recall <= 1.0 and rep.auc > 0.5


def test_scores_in_unit_interval(spark, q):
    sc = q["score_customers"](spark, SF001)
    stats = sc.agg(F.min("p"), F.max("p"), F.count(F.lit(1))).first()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0 and stats[2] > 0


def test_stream_equals_batch(spark, q):
    batch = {r.ROW_ID: r.p for r in q["score_customers"](spark, SF001).collect()}
    stream = {r.ROW_ID: r.p for r in q["score_stream"](spark, SF001).collect()}
    assert stream.keys() == batch.keys()
    assert all(abs(stream[k] - batch[k]) < 1e-12 for k in batch)


def test_importances_sum_to_one(spark, q):
    total = q["feature_importance"](spark, SF001).agg(F.sum("importance")).first()[0]
    assert total == pytest.approx(1.0)


def test_four_models_are_compared(spark, q):
    rows = q["compare_fitted_models"](spark, SF001).collect()
    assert {r.model for r in rows} == {"LogisticRegression", "RandomForest", "GBT", "GBT_deep"}
    assert sum(r.best_by_f1 for r in rows) == sum(r.best_by_auc for r in rows) == 1


def test_saved_pipeline_scores_alike(spark, q):
    from basketry.operators import models as MD
    from basketry.plans import q_models as QM, views
    t = QM.training(spark, SF001)
    mine = {r.ROW_ID: r.p for r in t.scorer.score(views.feat(spark, SF001)).collect()}
    loaded = {r.ROW_ID: r.p for r in q["score_customers"](spark, SF001).collect()}
    assert mine == loaded and len(mine) == views.shop(spark, SF001).count()
    test = {r.ROW_ID: r.p for r in t.scored_test.collect()}
    assert all(abs(mine[k] - v) < 1e-12 for k, v in test.items())
    assert isinstance(MD.load_scorer(spark, QM.saved_scorer(spark, SF001)), MD.Scorer)


def test_scoring_needs_no_join_on_the_id(spark, q):
    plan = q["score_customers"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_tree_depth_beyond_the_library_fails():
    from basketry.operators import models as MD
    with pytest.raises(ValueError):
        MD.random_forest_model(10, 31)


def test_candidate_scoring(spark, q):
    df = q["score_candidates"](spark, SF001)
    rows = df.collect()
    assert rows and all(0.0 <= r.p <= 1.0 and r.decision in (0, 1) for r in rows)
    assert {r.segment for r in rows} <= set(range(5)) and all(r.segment_name for r in rows)


def test_registered_queries_run_the_whole_workload(spark):
    from basketry.operators import models as MD
    from basketry.plans import q_models as QM
    t, e = QM.training(spark, SF001), QM.training_earlier(spark, SF001)
    assert t.cfg == MD.TrainConfig() and t.models is None and t.metric == "areaUnderROC"
    assert e.cfg == MD.earlier_config() and e.winner == "RandomForest" and e.metric == "precision" and e.cfg.min_recall == 0.80
    earlier = e._candidates(10, e.cfg)
    assert earlier["RandomForest"].getNumTrees() == 200 and earlier["GBT_deep"].getMaxDepth() == 8 and earlier["GBT"].getMaxIter() == 200
    for name, points, fits in (("GBT", 18, 9), ("GBT_deep", 18, 9), ("RandomForest", 12, 12), ("LogisticRegression", 3, 3)):
        named, todo = MD.grid_fits(name, t.cfg, 100)
        assert len(named) == points == len({label for label, _ in named}) and len(todo) == fits
        assert sorted(label for f in todo for label, _ in f.points) == sorted(label for label, _ in named)


@pytest.fixture(scope="module")
def small(spark):
    """900 rows with folds; y follows x."""
    from pyspark.ml.functions import array_to_vector
    rows = spark.range(900).select(F.col("id").alias("ROW_ID"), (F.xxhash64("id") % 1000 / 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000).alias("b"))
    y = (F.col("a") + F.col("b") * F.col("b") > 0.1).cast("double")
    return rows.select("ROW_ID", y.alias("label"), F.lit(1.0).alias("weight"), array_to_vector(F.array("a", "b")).alias("features"), (F.col("ROW_ID") % 3).cast("int").alias("fold")).coalesce(1).cache()


def test_one_boosted_fit_scores_every_smaller_number_of_rounds(spark, small):
    """All points of a boosted grid equal fits of their own."""
    from basketry.operators import models as MD
    from basketry.operators.fits import FitStore
    cfg = MD.TrainConfig(grids={"GBT": {"stepSize": [0.1, 0.3], "maxIter": [3, 6], "maxDepth": [2, 3]}})
    named, fits = MD.grid_fits("GBT", cfg, 900)
    assert len(named) == 8 and len(fits) == 4
    shared = MD.out_of_fold(small, fits, 3, FitStore(spark, "shared", id(small)), "g")
    alone = MD.out_of_fold(small, [MD.Fit(MD.grid_model("GBT", p, cfg, 900), [(label, None)]) for label, p in named], 3, FitStore(spark, "alone", id(small)), "g")
    a, b = ({(r.point, r.ROW_ID): (r.p, r.predicted) for r in x.collect()} for x in (shared, alone))
    assert len(a) == 8 * 900 and a == b
    assert MD.fold_metrics(shared, "areaUnderROC") == MD.fold_metrics(alone, "areaUnderROC")
    assert MD.fold_metrics(shared, "precision") == MD.fold_metrics(alone, "precision")


def test_forests_side_by_side_note_their_nodes_where_there_is_room(spark, small, monkeypatch):
    """With and without notes the scores are the same."""
    from pyspark.ml.classification import RandomForestClassifier
    from basketry.operators import models as MD
    from basketry.operators.fits import FitStore
    cores = spark.sparkContext.defaultParallelism
    fits = [MD.Fit(MD.random_forest_model(trees, 5), [(f"{trees}", None)]) for trees in (3, 6)]
    noted, plain = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: noted.append((self.getNumTrees(), self.getCacheNodeIds())) or plain(self, data))
    found = []
    for room in (0, 4 * 900 * 2 * 4 // cores + 1, MD.NOTED_BYTES):  # none, 4 trees for the two in flight, all
        monkeypatch.setattr(MD, "NOTED_BYTES", room)
        oof = MD.out_of_fold(small, fits, 3, FitStore(spark, "noted", room, id(small)), "g", at_once=2)
        found.append({(r.point, r.ROW_ID): r.p for r in oof.collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 1800
    assert [sorted(set(noted[k:k + 6])) for k in (0, 6, 12)] == [[(3, False), (6, False)], [(3, True), (6, False)], [(3, True), (6, True)]]


@pytest.mark.parametrize("levels, depth", [(7, 3), (60, 4)])
def test_boosting_by_groups_gives_the_librarys_trees(spark, levels, depth):
    """Repeated rows, few values and more values than bins, a fold left out (its
    rows may fall otherwise where splits are equally good); the stored form is the
    library's own."""
    from pyspark.ml.functions import array_to_vector
    from basketry.operators import boosting as B, models as MD
    cols = [(F.abs(F.xxhash64("id", F.lit(k))) % levels / 3).alias(c) for k, c in enumerate("abc")]
    rows = spark.range(1500).select("id", *cols, (F.col("id") % 3).cast("int").alias("fold"))
    y = (F.col("a") * F.col("b") + F.abs(F.xxhash64("id", F.lit(9))) % 7 / 2 > F.col("c")).cast("double")
    rows = rows.select(F.col("id").alias("ROW_ID"), y.alias("label"), array_to_vector(F.array("a", "b", "c")).alias("features"), "fold")
    rows = rows.unionByName(rows.where("ROW_ID % 5 = 0").withColumn("ROW_ID", F.col("ROW_ID") + 9000)).coalesce(1).cache()
    est = MD.gbt_model(12, depth, 0.3)
    assert B.boosted(est) and not B.boosted(est.copy().setSubsamplingRate(0.5)) and not B.boosted(est.copy().setMinInstancesPerNode(2))
    groups = B.grouped(rows, "label")
    for but, part in ((None, rows), (1, rows.where("fold <> 1"))):
        want, got = est.fit(part), groups.fit(est, but)
        a, b = ({r.ROW_ID: (r.p, r.prediction) for r in MD.probability(m.transform(rows)).collect()} for m in (want, got))
        other = [k for k, (p, pred) in a.items() if b[k] != (pytest.approx(p, abs=1e-9), pred)]
        assert len(a) == 1800 and len(other) <= (0 if but is None else 6) and all(k % 3 == but for k in other)
        assert got.getNumTrees == 12 and got.treeWeights == want.treeWeights and got.numFeatures == 3
        assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()), abs=1e-9 if but is None else 0.01)
        assert {p.name: v for p, v in got.extractParamMap().items()} == {p.name: v for p, v in want.extractParamMap().items()}


def test_boosted_fits_run_no_library_fit_where_groups_are_few(spark, small, monkeypatch):
    """A level of a round is no Spark job; beyond the bound the fit is the library's."""
    from pyspark.ml.classification import GBTClassifier
    from basketry.operators import boosting as B, models as MD
    from basketry.operators.fits import FitStore
    fitted, plain = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: fitted.append(1) or plain(self, data))
    scores = []
    for room in (B.GROUP_BYTES, 100):
        monkeypatch.setattr(B, "GROUP_BYTES", room)
        oof = MD.out_of_fold(small, [MD.Fit(MD.gbt_model(4, 3), [("x", None)])], 3, FitStore(spark, "groups", room, id(small)), "g")
        scores.append({r.ROW_ID: r.p for r in oof.collect()})
        MD.fit_alone(MD.gbt_model(2, 2), small)
        assert len(fitted) == (0 if room > 100 else 4)
    assert scores[0] == {k: pytest.approx(p, abs=1e-9) for k, p in scores[1].items()}


def test_boosting_tasks_import_nothing_of_the_library():
    import subprocess
    import sys
    from pyspark import cloudpickle
    from basketry.operators import boosting as B
    code = f"import sys, pickle; sys.path = [p for p in sys.path if p]; pickle.loads(bytes.fromhex('{cloudpickle.dumps(B._nodes(None, None, 2, 2, 0.1, 32)).hex()}')); assert 'basketry' not in sys.modules"
    subprocess.run([sys.executable, "-I", "-c", code], check=True, cwd="/")


def test_a_boosted_fit_carries_few_trees(spark):
    from basketry.operators import models as MD
    assert MD.gbt_model(400).getCheckpointInterval() <= 10


def test_finished_fits_are_found_again(spark, small):
    """A run that broke off goes on where it was; another store object finds all."""
    from basketry.operators import models as MD
    from basketry.operators.fits import FitStore
    fits = [MD.Fit(MD.logistic_model(900, c), [(f"C={c}", None)]) for c in (0.1, 1.0)]

    class Broken:
        def fit(self, data):
            raise RuntimeError("lost")
    with pytest.raises(RuntimeError, match="lost"):
        MD.out_of_fold(small, [*fits, MD.Fit(Broken(), [("x", None)])], 3, FitStore(spark, "again", id(small)), "g", at_once=1)
    done = [MD.Fit(Broken(), f.points) for f in fits]  # would fail if fitted
    oof = MD.out_of_fold(small, done, 3, FitStore(spark, "again", id(small)), "g")
    assert oof.count() == 2 * 900


def test_stages_are_whole_or_absent(spark):
    from basketry.operators.fits import FitStore
    store, calls = FitStore(spark, "stages", "test"), []

    def half(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("half")
    with pytest.raises(RuntimeError):
        store.stage("t", half)
    assert store.published("t") is None
    assert store.table("t", lambda: calls.append(1) or spark.range(5)).count() == 5
    assert FitStore(spark, "stages", "test").table("t", lambda: calls.append(1) or spark.range(9)).count() == 5 and calls == [1]
    assert FitStore(spark, "stages", "other").published("t") is None
    assert store.value("v", lambda: {"a": [1, None]}) == {"a": [1, None]}


def test_selection_fits_the_forest_and_nothing_else(spark):
    from basketry.operators import models as MD
    from basketry.plans import views
    t = MD.Training(views.feat_split(spark, SF001), MD.TrainConfig(select_trees=5, select_depth=4))
    assert t.selected
    stages = {f.getPath().getName() for f in t.store._fs.listStatus(t.store._path(""))}
    assert {s[:-5] for s in stages if s.endswith(".done")} == {"lookups", "encoded", "importances"}


def test_threshold_leaves_test_labels_alone(spark):
    from basketry.operators import models as MD
    from basketry.plans import views
    data = views.feat_split(spark, SF001)
    turned = data.withColumn("SUBSCRIPTION_STATUS", F.when(F.col("part") == "test", F.when(F.col("SUBSCRIPTION_STATUS") == "Yes", "No").otherwise("Yes")).otherwise(F.col("SUBSCRIPTION_STATUS")))
    cfg = MD.TrainConfig(select_trees=5, select_depth=4, grids={"LogisticRegression": {"C": [0.1, 1.0]}})
    one, two = (MD.Training(d, cfg, models=["LogisticRegression"]) for d in (data, turned))
    assert one.threshold == two.threshold and one.oof.count() == data.where("part = 'train'").count()
    best = M.best_threshold(M.threshold_sweep(one.oof), cfg.min_recall).first()
    assert one.threshold == best["threshold"]
    on_test = MD.Training(turned, MD.TrainConfig(select_trees=5, select_depth=4, threshold_on="test", grids=cfg.grids), models=["LogisticRegression"])
    assert on_test.threshold == M.best_threshold(M.threshold_sweep(on_test.scored_test), cfg.min_recall).first()["threshold"]


def test_lookups_may_be_fitted_on_all_rows(spark):
    from basketry.operators import models as MD
    from basketry.plans import views
    data = views.feat_split(spark, SF001)
    train, every = (MD.Training(data, MD.TrainConfig(fit_on=x)).lookups for x in ("train", "all"))
    want = data.agg(F.avg("PURCHASE_AMOUNT_USD")).first()[0]
    assert every.means.overall[0] == pytest.approx(want) and train.means.overall[0] != pytest.approx(want)


def _cloud(spark, n=1500):
    """Rows of two features in four heaps, as a matrix and as a frame."""
    import numpy as np
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 2)) + np.array([[0, 0], [4, 0], [0, 4], [5, 5]])[rng.integers(0, 4, n)]
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "ROW_ID long, a double, b double").repartition(3, "ROW_ID").sortWithinPartitions("ROW_ID")


def test_fits_moved_together_are_the_fits_alone(spark):
    """Common passes over the rows end where MLlib's own fits end."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from basketry.operators import segments as SG
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(_cloud(spark)[1]).cache()
    fits = SG.kmeans_fits(vec, [2, 4], restarts=2, features=["a", "b"])
    for k, (model, cost) in fits.items():
        alone = [KMeans(k=k, seed=42 + r, maxIter=300, featuresCol="features", predictionCol="Cluster").fit(vec) for r in range(2)]
        best = min(alone, key=lambda m: m.summary.trainingCost)
        assert cost == pytest.approx(best.summary.trainingCost)
        assert [list(c) for c in model.clusterCenters()] == [pytest.approx(list(c)) for c in best.clusterCenters()]
        assert model.transform(vec).select("ROW_ID", "Cluster").exceptAll(best.transform(vec).select("ROW_ID", "Cluster")).isEmpty()
    starts = {i: KMeans(k=3, seed=i, maxIter=0, featuresCol="features").fit(vec).clusterCenters() for i in range(2)}
    passes = []
    step = SG._lloyd_step
    SG._lloyd_step = lambda fits, d: passes.append(sorted(fits)) or step(fits, d)
    try:
        SG.lloyd(vec, ["a", "b"], starts)
    finally:
        SG._lloyd_step = step
    assert passes[0] == [0, 1] and len(passes) <= 300
    far = SG.lloyd(vec, ["a", "b"], {0: [[0.0, 0.0], [900.0, 900.0]]})[0][0]
    assert list(far[1]) == [900.0, 900.0]  # an empty cluster stays


def test_starts_are_the_librarys_without_its_fits(spark, monkeypatch):
    """Vectors are made once for all draws; fewer different rows than k included."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from basketry.operators import segments as SG
    cloud = _cloud(spark, 900)[1]
    for df in (cloud, cloud.where("ROW_ID < 3").unionAll(cloud.where("ROW_ID < 3"))):
        vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
        asked = [KMeans(k=k, seed=s, maxIter=0, solver="block", featuresCol="features", predictionCol="Cluster") for k in (2, 5) for s in (42, 43)]
        want = [[list(c) for c in e.fit(vec).clusterCenters()] for e in asked]
        with monkeypatch.context() as m:
            m.setattr(KMeans, "fit", lambda *a: pytest.fail("a fit was run"))
            assert [c.tolist() for c in SG._starts(vec, asked)] == want
            SG.kmeans_fits(vec, [2], restarts=2, features=["a", "b"])


@pytest.mark.parametrize("block, block_rows", [(10_000, 10_000), (7, 90)])
def test_silhouette_of_any_blocks_is_the_plain_one(spark, block, block_rows):
    """Equal rows, rows far from the origin and a cluster of one included."""
    import numpy as np
    from basketry.operators import segments as SG
    x, df = _cloud(spark, 400)
    x[40] = x[60] = x[80] + 1e-7
    x += 50
    label = np.where(np.arange(400) == 20, 9, (x[:, 0] > 52).astype(int))
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(label, x))], "ROW_ID long, Cluster int, a double, b double")
    got = {r.ROW_ID: (r.Cluster, r.silhouette) for r in SG.silhouette_euclidean(df, ["a", "b"], block=block, block_rows=block_rows).collect()}
    want = {}
    for i in range(0, 400, 20):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = label == label[i]
        near, other = far[own].sum() / max(own.sum() - 1, 1), min(far[label == c].mean() for c in set(label) - {label[i]})
        want[i] = (label[i], pytest.approx(0.0 if own.sum() == 1 else (other - near) / max(other, near), abs=1e-9))
    assert got == want


def test_tasks_import_nothing_of_the_library(spark):
    """What k-means and the silhouette send to tasks runs where the library is not installed."""
    import subprocess
    import sys
    from pyspark import cloudpickle
    from basketry.operators import segments as SG
    sent = [SG._lloyd_step({0: [[0.0]]}, 1)]
    frame, group = type(spark.range(1)), type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id")))
    rows, cogroup = frame.mapInArrow, group.applyInArrow
    group.applyInArrow = lambda self, f, schema: sent.append(f) or cogroup(self, f, schema)
    frame.mapInArrow = lambda self, f, *a, **kw: sent.append(f) or rows(self, f, *a, **kw)
    try:
        df = _cloud(spark, 100)[1]
        SG.lloyd(df, ["a", "b"], {0: [[0.0, 0.0], [4.0, 4.0]]}, 1)
        SG.silhouette_euclidean(df.selectExpr("*", "0 AS Cluster"), ["a", "b"])
    finally:
        group.applyInArrow, frame.mapInArrow = cogroup, rows
    assert len(sent) == 4
    for f in sent:
        code = f"import sys, pickle; sys.path = [p for p in sys.path if p]; pickle.loads(bytes.fromhex('{cloudpickle.dumps(f).hex()}')); assert 'basketry' not in sys.modules"
        subprocess.run([sys.executable, "-I", "-c", code], check=True, cwd="/")


def test_noted_nodes_give_the_same_forest(spark, monkeypatch):
    """The selection forest notes its rows' nodes and is, tree by tree, the plain one."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors
    from basketry.operators import models as MD
    rows = spark.createDataFrame([(float(i % 7 < 3 or i % 11 == 0), 1.0 + i % 2, Vectors.dense(i % 7, i % 11, (i * 37) % 101)) for i in range(600)], ["label", "weight", "features"]).repartition(3).cache()
    forest = MD.random_forest_model(8, 6)
    assert MD.noting_nodes(forest.copy()).fit(rows).toDebugString.split("\n")[1:] == forest.fit(rows).toDebugString.split("\n")[1:]
    noted, plain = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, data: noted.append((self.getCacheNodeIds(), self.getCheckpointInterval())) or plain(self, data))
    MD.select_features(rows, ["a", "b", "c"], MD.TrainConfig(select_trees=3, select_depth=3))
    assert noted == [(True, -1)]
    lr = MD.logistic_model(600)
    assert MD.noting_nodes(lr) is lr
