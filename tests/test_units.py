"""Edge cases on tiny hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.functions.exprs import concat_text, cut
from basketry.operators import encode as E
from basketry.operators import features as FE
from basketry.operators import metrics as M
from basketry.operators import segments as SG
from basketry.operators import stats as S
from basketry.operators.quantiles import column_quantiles, quantiles
from basketry.operators.split import add_split_column, fold_column
from basketry.sources.files import coerce_numeric, normalize_name


def test_age_bins_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in [0, 18, 30, 31, 45, 56, 57, 200, 201]], "AGE int")
    got = [r[0] for r in df.select(cut("AGE", K.AGE_EDGES, K.AGE_LABELS)).collect()]
    assert got == [None, "18-30", "18-30", "31-45", "31-45", "46-56", "57-70", "57-70", None]


def test_loyalty_bins_include_lowest(spark):
    df = spark.createDataFrame([(a,) for a in [0, 13, 14, 25, 38, 39]], "PREVIOUS_PURCHASES int")
    got = [r[0] for r in FE.bin_loyalty(df).select("LOYALTY_LEVEL_NEW").collect()]
    assert got == ["Low", "Low", "Mid", "Mid", "High", "Very High"]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("12",), (" x",), (None,)], "AGE string")
    assert [r[0] for r in coerce_numeric(df, ["AGE", "ABSENT"]).collect()] == [12.0, None, None]


def test_normalize_names():
    assert normalize_name("Purchase Amount (USD)") == "PURCHASE_AMOUNT_(USD)"
    assert normalize_name(" Age ") == "_AGE_"


def test_mode_ties_and_default(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, None)], "g int, v string")
    got = {r["g"]: r["v"] for r in S.group_mode(df, "g", ["v"]).collect()}
    assert got == {1: "a", 2: "Unknown"}


def test_cramers_v_degenerate_and_yates(spark):
    one = spark.createDataFrame([("x", "p"), ("x", "q"), ("x", "p")], "a string, b string")
    assert S.cramers_v_value(one, "a", "b") == 0.0
    df = spark.createDataFrame([("y", "y")] * 30 + [("y", "n")] * 5 + [("n", "y")] * 4 + [("n", "n")] * 25,
                               "a string, b string")
    o = np.array([[25, 4], [5, 30]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    chi2 = (((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2) / e).sum()
    assert S.cramers_v_value(df, "a", "b") == pytest.approx(math.sqrt(chi2 / o.sum()), rel=1e-12)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "x double, y double, c double")
    got = {(r.col_a, r.col_b): r.corr for r in S.correlation_matrix(df, ["x", "y", "c"]).collect()}
    assert got[("x", "c")] is None and got[("c", "c")] is None
    xs, ys = np.array([1.0, 2.0, 4.0]), np.array([2.0, 4.5, 8.0])
    assert got[("x", "y")] == pytest.approx(np.corrcoef(xs, ys)[0, 1], rel=1e-12)
    assert got[("y", "x")] == got[("x", "y")]


def test_unseen_category_all_zero(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "ROW_ID int, c string")
    test = spark.createDataFrame([(3, "z"), (4, None), (5, "b")], "ROW_ID int, c string")
    tr, te, vocab = E.encode_train_test(train, test, [], keep=["ROW_ID"])
    assert te.columns == tr.columns == ["ROW_ID", "c_a", "c_b"]
    assert [tuple(r) for r in te.orderBy("ROW_ID").collect()] == [(3, 0, 0), (4, 0, 0), (5, 0, 1)]


def test_group_ratio_unseen_uses_global_mean(spark):
    train = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 5.0)], "g string, v double")
    test = spark.createDataFrame([("a", 40.0), ("z", 15.0)], "g string, v double")
    _, te = FE.group_mean_ratio(train, test, "g", "v", "r")
    got = {r.g: r.r for r in te.collect()}
    assert got["a"] == pytest.approx(2.0) and got["z"] == pytest.approx(15.0 / 15.0)


def test_no_threshold_meets_recall_falls_back(spark):
    sc = spark.createDataFrame([("m", 1, 0.3), ("m", 0, 0.6), ("m", 1, 0.9)], "model string, y int, p double")
    best = M.best_threshold(M.threshold_sweep(sc), 1.01).first()
    assert best["threshold"] == 0.5 and best["met"] == 0


def test_threshold_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    p = np.round(rng.random(400), 3)
    y = (rng.random(400) < p).astype(int)
    sc = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, y int, p double")
    got = {r.threshold: (r.tp, r.fp) for r in M.threshold_sweep(sc).collect()}
    for t in M.threshold_grid():
        pred = p >= t
        assert got[t] == (int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()))
    # recall is non-increasing in the threshold
    rec = [r.recall for r in M.threshold_sweep(sc).orderBy("threshold").collect()]
    assert all(a >= b for a, b in zip(rec, rec[1:]))


def test_auc_equals_mann_whitney(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    sc = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.auc(sc).first()["auc"] == pytest.approx(mw, rel=1e-12)


def test_elbow_chord(spark):
    w = [100, 60, 40, 32, 28, 25, 23, 21, 20]
    curve = spark.createDataFrame(list(zip(range(2, 11), map(float, w))), "k int, inertia double")
    assert SG.elbow_k(curve).where("is_elbow = 1").first()["k"] == 4


def test_null_in_concat(spark):
    df = spark.createDataFrame([(None, "Shoes")], "SEASON string, CATEGORY string")
    assert df.select(concat_text("SEASON", "CATEGORY")).first()[0] == "nan_Shoes"


def test_quantiles_exact_per_group(spark):
    rng = np.random.default_rng(11)
    vals = np.round(rng.lognormal(3, 1.5, 3000), 2)
    rows = [("g", float(v)) for v in vals] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: list(r)[1:] for r in quantiles(df, "x", probs, ["g"]).collect()}
    assert got["g"] == pytest.approx(list(np.quantile(vals, probs)), rel=1e-12)
    assert got["one"] == [5.0] * 5 and got["two"] == [1.0, 1.25, 1.5, 1.75, 2.0] and got[None] == [7.0] * 5 and "none" not in got
    assert list(quantiles(df.where("g = 'g'"), "x", probs).first()) == got["g"]
    assert quantiles(df.where("g = 'none'"), "x", probs).collect() == []
    assert column_quantiles(df.withColumn("y", F.lit(None).cast("double")), ["x", "y"], [0.5])["y"] is None


def test_split_sizes_and_folds(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 3 == 0 else "No") for i in range(1, 1001)],
                               "ROW_ID long, SUBSCRIPTION_STATUS string")
    out = add_split_column(df)
    counts = {(r[0], r[1]): r[2] for r in out.groupBy("SUBSCRIPTION_STATUS", "part").count().collect()}
    n_yes, n_no = 333, 667
    assert counts[("Yes", "test")] == int(0.2 * n_yes + 0.5) and counts[("No", "test")] == int(0.2 * n_no + 0.5)
    # same rows as a window over (md5(id-42), id) inside each label
    from pyspark.sql import Window
    w = Window.partitionBy("SUBSCRIPTION_STATUS").orderBy(F.md5(F.concat(F.col("ROW_ID").cast("string"),
                                                                        F.lit("-42"))), "ROW_ID")
    ref = df.withColumn("rk", F.row_number().over(w))
    tot = {"Yes": n_yes, "No": n_no}
    want = {r.ROW_ID for r in ref.collect() if r.rk <= int(0.2 * tot[r.SUBSCRIPTION_STATUS] + 0.5)}
    assert {r.ROW_ID for r in out.where("part = 'test'").collect()} == want
    folds = fold_column(df, "SUBSCRIPTION_STATUS", folds=5)
    sizes = sorted(r[1] for r in folds.groupBy("fold").count().collect())
    assert sum(sizes) == 1000 and max(sizes) - min(sizes) <= 2


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(50, 10, 500), 1)
    df = spark.createDataFrame([("g", float(x)) for x in v], "grp string, x double")
    got = S.kde(df, "x", "grp", points=50, cut=3.0).orderBy("i").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 50)
    dens = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert [r.density for r in got] == pytest.approx(list(dens), rel=1e-9, abs=1e-15)


def test_rare_encode_denominator_includes_nulls(spark):
    rows = [("a",)] * 6 + [("b",)] * 1 + [(None,)] * 3
    df = spark.createDataFrame(rows, "c string")
    got = sorted((r[0] or "") for r in FE.rare_encode(df, 0.15).collect())
    assert got == [""] * 3 + ["Rare"] + ["a"] * 6


def test_assign_nearest_ties_lowest(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (5.0, 5.0)], "a double, b double")
    got = [r.Cluster for r in SG.assign_nearest(df, [[0.5, 0.0], [0.5, 0.0], [5.0, 4.0]], ["a", "b"]).collect()]
    assert got == [0, 0, 2]


def test_row_number_hot_group_equals_window(spark):
    import datetime as dt
    from pyspark.sql import Window
    from basketry.operators.ranking import row_number_in_group
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):  # one hot customer with many equal dates
        rows.append((1, dt.datetime(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 40))), i))
    for i in range(3000, 3400):
        rows.append((int(rng.integers(2, 50)), dt.datetime(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 400))), i))
    df = spark.createDataFrame(rows, "c long, d timestamp, k long")
    got = row_number_in_group(df, ["c"], ["d", "k"], "rn")
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("d", "k")))
    assert sorted(map(tuple, got.select("k", "rn").collect())) == sorted(map(tuple, ref.select("k", "rn").collect()))


def wide_hits(df, vocab, keep="ROW_ID"):
    """(row, name) of every 1 in the wide frame."""
    wide = E.one_hot_apply(df, vocab)
    return sorted((r[keep], c) for r in wide.collect() for c in wide.columns if c != keep and r[c] == 1)


def test_sparse_one_hot_equals_wide(spark):
    train = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "b", "y")], "ROW_ID int, c string, d string")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "z", "y"), (4, None, None)], "ROW_ID int, c string, d string")
    vocab = E.fit_vocabulary_table(train, ["c", "d"])
    assert sorted(map(tuple, vocab.collect())) == [("c", "a", 0), ("c", "b", 1), ("d", "x", 2), ("d", "y", 3)]
    want = wide_hits(df, E.fit_vocabulary(train, ["c", "d"]))
    assert want == [(1, "c_a"), (1, "d_x"), (2, "c_b"), (3, "d_y")]
    assert sorted(map(tuple, E.hot_names(E.indexed(df, vocab, ["c", "d"], "ROW_ID"), ["ROW_ID"]).collect())) == want


def test_sparse_vectors_hold_numbers_and_indicators(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b"), (3, 1.0, None)], "ROW_ID int, n double, c string")
    vocab = E.fit_vocabulary_table(df, ["c"])
    rows = E.sparse_vectors(E.indexed(df, vocab, ["c"], "ROW_ID"), ["n"], 2, ["ROW_ID"], str(tmp_path / "v")).orderBy("ROW_ID").collect()
    assert [r.features.toArray().tolist() for r in rows] == [[2.5, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]


def test_a_column_of_very_many_values(spark, monkeypatch):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("ROW_ID"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    vocab = E.fit_vocabulary_table(df, ["c", "d"])
    assert vocab.count() == n + 3 and vocab.agg(F.max("idx"), F.count_distinct("idx")).first()[:] == (n + 2, n + 3)
    hot = E.indexed(df, vocab, ["c", "d"], "ROW_ID")
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") == 0  # no list of values went through the driver
    got = hot.agg(F.count(F.lit(1)), F.sum(F.size("_hot"))).first()
    assert got[:] == (n, 2 * n)
    few = hot.where("ROW_ID in (0, 7)").orderBy("ROW_ID").collect()
    assert [[(x.c, x.v) for x in r._hot] for r in few] == [[("c", "v0"), ("d", "0")], [("c", "v7"), ("d", "1")]]
    with pytest.raises(ValueError, match="sparse"):
        E.fit_vocabulary(df, ["c"])


def test_group_probs_beyond_the_bound_are_the_same(spark):
    df = spark.createDataFrame([("g1", "a", "S"), ("g1", "b", "S"), ("g2", "a", None), ("g2", "a", "M"), (None, "b", "M"), ("g3", None, "L")], "g string, c1 string, c2 string")
    asked = spark.createDataFrame([(g, c, d) for g in ("g1", "g2", "g3", "g4", None) for c in ("a", "zz", None) for d in ("S", "L")], "g string, c1 string, c2 string")
    small, big = FE.fit_group_probs(df, "g", ["c1", "c2"]), FE.fit_group_probs(df, "g", ["c1", "c2"], bound=1)
    assert isinstance(small, FE.GroupProbs) and isinstance(big, FE.PairProbs) and small.means == pytest.approx(big.means)
    key = lambda r: tuple("∅" if x is None else round(x, 12) if isinstance(x, float) else x for x in r)
    a, b = (sorted(key(r) for r in f.attach(asked, ["p", "q"]).select("g", "c1", "c2", "p", "q").collect()) for f in (small, big))
    assert a == b
    train_mean = FE.attach_probs(df, small).agg(F.avg("P_c1_given_CLIMATE_NEW")).first()[0]
    assert small.means[0] == pytest.approx(train_mean)


def test_one_lookup_join_attaches_all_probabilities(spark):
    df = spark.createDataFrame([("g1", "a", "S"), ("g2", "b", "M")], "g string, c1 string, c2 string")
    plan = FE.fit_group_probs(df, "g", ["c1", "c2"]).attach(df, ["p", "q"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1


def test_auc_roc_match_direct_count(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.random(2000), 3)
    y = (rng.random(2000) < p).astype(int)
    sc = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "model string, y int, p double")
    got = M.auc(sc).first()["auc"]
    roc = {r.score: (r.fpr, r.tpr) for r in M.roc_curve(sc).collect() if r.score is not None}
    pos, neg = p[y == 1], p[y == 0]
    mw = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(mw, rel=1e-12)
    s0 = sorted(set(p))[len(set(p)) // 2]
    assert roc[s0] == pytest.approx(((neg >= s0).sum() / len(neg), (pos >= s0).sum() / len(pos)))


@pytest.mark.parametrize("descending,inclusive", [(True, True), (False, False)])
def test_running_sums_mixed_groups(spark, descending, inclusive):
    from pyspark.sql import Window
    from basketry.operators.ranking import running_sums
    rng = np.random.default_rng(4)
    rows = [("big", float(i), int(rng.integers(0, 5))) for i in range(600)]
    rows += [(f"s{g}", float(i), int(rng.integers(0, 5))) for g in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    got = running_sums(df, ["g"], "k", ["v"], descending=descending, inclusive=inclusive)
    order = F.desc("k") if descending else F.asc("k")
    w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                           Window.currentRow if inclusive else -1)
    ref = df.withColumn("cum_v", F.coalesce(F.sum("v").over(w), F.lit(0)))
    key = lambda r: (r.g, r.k, r.cum_v)
    assert sorted(map(key, got.collect())) == sorted(map(key, ref.collect()))


def test_group_mean_ratios_one_pass_equals_single(spark):
    train = spark.createDataFrame([("a", "x", 10.0, 1.0), ("a", "y", 30.0, None), ("b", None, 5.0, 2.0),
                                   (None, "x", 7.0, 4.0)], "g string, h string, v double, w double")
    test = spark.createDataFrame([("a", "y", 40.0, 3.0), ("z", "q", 15.0, 1.0), (None, None, 2.0, None)],
                                 "g string, h string, v double, w double")
    specs = [("g", "v", "r1"), ("h", "v", "r2"), ("g", "w", "r3")]
    tr_m, te_m = FE.group_mean_ratios(train, test, specs)
    tr_s, te_s = train, test
    for g, v, o in specs:
        tr_s, te_s = FE.group_mean_ratio(tr_s, te_s, g, v, o)
    key = lambda r: tuple("∅" if x is None else round(x, 12) if isinstance(x, float) else x for x in r)
    cols = ["g", "h", "v", "w", "r1", "r2", "r3"]
    assert sorted(map(key, tr_m.select(cols).collect())) == sorted(map(key, tr_s.select(cols).collect()))
    assert sorted(map(key, te_m.select(cols).collect())) == sorted(map(key, te_s.select(cols).collect()))


def test_conditional_probs_many_equals_single(spark):
    df = spark.createDataFrame([("g1", "a", "S"), ("g1", "b", "S"), ("g2", "a", None), ("g2", "a", "M"),
                                (None, "b", "M"), ("g3", None, "L")], "grp string, c1 string, c2 string")
    many = FE.fit_conditional_probs_many(df, "grp", ["c1", "c2"])
    asked = spark.createDataFrame([(g, c, c) for g in ("g1", "g2", "g3", "g4", None) for c in ("a", "b", "S", "M", "L", "zz", None)], "grp string, c1 string, c2 string")
    for c in ("c1", "c2"):
        table = FE.fit_conditional_probs(df, "grp", c)
        key = lambda r: tuple("∅" if x is None else round(x, 12) if isinstance(x, float) else x for x in r)
        a = sorted(key(r) for r in FE.map_conditional_probs(asked, many[c], "grp", c, "p").collect())
        b = sorted(key(r) for r in FE.map_conditional_probs(asked, table, "grp", c, "p").select("grp", "c1", "c2", "p").collect())
        assert a == b
    full = {(r[0], r[1]): r[2] for r in FE.fit_conditional_probs(df, "grp", "c1").collect()}
    assert full == pytest.approx({("g1", "a"): 2 / 4, ("g1", "b"): 2 / 4, ("g2", "a"): 3 / 4, ("g2", "b"): 1 / 4})


def test_split_fails_on_a_key_that_repeats_at_the_cut(spark):
    df = spark.createDataFrame([(1 if i < 900 else i, "Yes") for i in range(1000)], "ROW_ID long, SUBSCRIPTION_STATUS string")
    with pytest.raises(ValueError, match="repeats"):
        add_split_column(df)


def test_coerce_numeric_text(spark):
    text = ["1", " 2.5 ", "-3.", ".5", "1e3", "NaN", "12d", "1f", "", " ", "Infinity", "-inf", "0x10", "1_000", "abc", None]
    df = spark.createDataFrame([(t,) for t in text], "a string")
    want = [1.0, 2.5, -3.0, 0.5, 1000.0, None, None, None, None, None, math.inf, -math.inf, None, None, None, None]
    assert [r.a for r in coerce_numeric(df, ["a"]).collect()] == want
    assert coerce_numeric(spark.createDataFrame([(float("nan"),)], "a double"), ["a"]).first()[0] is None


def test_front_of_the_pipeline(spark, tmp_path):
    """The example in ``basketry.api``: a file's own headers to features."""
    from basketry import api as B
    from basketry.plans.views import shop
    from basketry.sources.files import raw_header_frame, write_csv
    path = write_csv(raw_header_frame(shop(spark, "/root/testdata/sf0.001")), str(tmp_path / "csv"))
    raw = spark.read.option("header", True).csv(path)
    feat = B.derive_features(B.clean_shoppers(B.canonical_columns(B.normalize_columns(raw))))
    assert feat.count() == shop(spark, "/root/testdata/sf0.001").count() and "CLIMATE_GROUP_NEW" in feat.columns


def test_lookups_stay_small_without_auto_broadcast(spark):
    df = spark.createDataFrame([("g1", "a"), ("g2", "b")] * 50, "grp string, c1 string")
    fit = FE.fit_conditional_probs_many(df, "grp", ["c1"])["c1"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = FE.map_conditional_probs(df, fit, "grp", "c1", "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_scan_csv_infers_types(spark, tmp_path):
    from basketry.sources.files import scan_csv, write_csv
    path = write_csv(spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "`Row ID` long, `Review Rating` double, `Size` string"), str(tmp_path / "c"))
    df = scan_csv(spark, path, infer=True)
    assert dict(df.dtypes) == {"ROW_ID": "int", "REVIEW_RATING": "double", "SIZE": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, "x"), (2, None, "y")]


def test_group_mean_ratio_mean_ratio_fallback(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "g string, v double")
    test = spark.createDataFrame([("a", 4.0), ("z", 9.0), (None, 2.0)], "g string, v double")
    _, out = FE.group_mean_ratio(train, test, "g", "v", "r", fallback="mean_ratio")
    # unseen and null groups take the mean of the train ratios 0.5, 1.5 and 1
    assert sorted((r.g or "", r.r) for r in out.collect()) == [("", 1.0), ("a", 2.0), ("z", 1.0)]


@pytest.fixture(scope="module")
def many_values(spark):
    rows = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 1000 == 1, None).otherwise("b").alias("g"), "id")
    return rows.select("g", F.when(F.col("id") % 7 == 0, F.lit(5.0)).when(F.col("id") % 501 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("x")).cache()


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_bracketed_quantiles_are_exact(spark, many_values, monkeypatch):
    from basketry.operators import quantiles as QU
    xs = {}
    for r in many_values.where("x is not null").collect():
        xs.setdefault(r.g, []).append(r.x)
    want = {g: np.quantile(v, PROBS) for g, v in xs.items()}
    asked = []
    real = QU._by_counts
    monkeypatch.setattr(QU, "_by_counts", lambda *a: asked.append(1) or real(*a))
    got = {r.g: list(r)[1:] for r in QU.quantiles(many_values, "x", PROBS, ["g"]).collect()}
    assert not asked and got.keys() == want.keys()  # two scans, no sort of all values
    assert all(got[g] == pytest.approx(list(want[g]), rel=1e-12) for g in want)
    monkeypatch.setattr(QU, "RANK_ERROR", -0.01)  # brackets that miss their ranks are noticed
    got = {r.g: list(r)[1:] for r in QU.quantiles(many_values, "x", PROBS, ["g"]).collect()}
    assert asked and all(got[g] == pytest.approx(list(want[g]), rel=1e-12) for g in want)


def test_approximate_quantiles_keep_their_bound(spark, many_values):
    from basketry.operators import quantiles as QU
    xs = {}
    for r in many_values.where("x is not null").collect():
        xs.setdefault(r.g, []).append(r.x)
    for r in QU.quantiles(many_values, "x", PROBS, ["g"], approx=True).collect():
        v = np.sort(xs[r.g])
        for i, p in enumerate(PROBS):
            lo, hi = np.searchsorted(v, r[f"q{i}"], "left") / len(v), np.searchsorted(v, r[f"q{i}"], "right") / len(v)
            assert lo - r.rank_error - 1 / len(v) <= p <= hi + r.rank_error + 1 / len(v)
    assert FE.qcut(many_values, "x", 2, ["low", "high"], "half", approx=True).where("half is not null").count() > 0


def test_positions_of_small_groups_need_no_ranges(spark, monkeypatch):
    from basketry.operators import ranking as R
    rows = [("hot" if i % 3 else f"g{i % 50}", i * 7919 % 1000, i) for i in range(2000)] + [(None, 5, 1), (None, 4, 2)]
    df = spark.createDataFrame(rows, "c string, d int, k int").repartition(5)
    want = sorted(map(tuple, df.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("d", "k"))).collect()), key=str)
    written = []
    whole = R.materialize
    monkeypatch.setattr(R, "materialize", lambda d, name: (written.append(name), whole(d, name))[1])
    assert sorted(map(tuple, R.row_number_in_group(df, ["c"], ["d", "k"], "rn").collect()), key=str) == want and written == []
    monkeypatch.setattr(R, "LARGE_GROUP", 100)
    assert sorted(map(tuple, R.row_number_in_group(df, ["c"], ["d", "k"], "rn").collect()), key=str) == want and written == ["ranges"]


def test_quantile_scan_neither_multiplies_rows_nor_runs_lambdas(spark, monkeypatch):
    from basketry.operators import quantiles as QU
    rng = np.random.default_rng(3)
    xs = {"a": rng.normal(size=30_000), "b": np.repeat([-1.0, 0.0, 2.5], 5000), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in xs.items() for v in vs] + [("a", None)], "g string, x double")
    plans = []
    bounded = QU.bounded_rows

    def seen(d, *size):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return bounded(d, *size)
    monkeypatch.setattr(QU, "bounded_rows", seen)
    probs = [i / 72 for i in range(73)]
    got = {r.g: list(r)[1:] for r in QU.quantiles(df, "x", probs, ["g"]).collect()}
    for g, vs in xs.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)
    assert len(plans) == 2 and "Generate" not in plans[1] and "lambda" not in plans[1].lower()
