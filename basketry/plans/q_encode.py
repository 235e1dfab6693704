"""Registered queries: encoders and weights (E1-E4, E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.operators import encode as E
from basketry.plans import views
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register
from basketry.plans.sql_features import feat_ctes, split_ctes

FEAT = feat_ctes()
SPLIT = split_ctes()
KEYS = ["ROW_ID", "part"]
ONEHOT_COLS = ["GENDER", "CATEGORY", "PAYMENT_TYPE_NEW", "AGE_NEW", "PURCHASE_AMOUNT_USD_NEW",
               "LOYALTY_LEVEL_NEW", "SUB_FREQ_NEW", "SHIP_SUB_NEW", "SEASON_CATEGORY_NEW", "SEASON_COLOR_NEW",
               "ITEM_CATEGORY_NEW", "LOCATION_GROUPED_NEW", "CLIMATE_GROUP_NEW"]


def _onehot_sql():
    parts = [f"SELECT ROW_ID, part, '{c}_' || {c} AS onehot FROM split WHERE {c} IN "
             f"(SELECT {c} FROM split WHERE part = 'train' AND {c} IS NOT NULL)" for c in ONEHOT_COLS]
    return with_views(" UNION ALL ".join(parts), *FEAT, *SPLIT)


@register("one_hot_aligned", _onehot_sql())
def q_one_hot_aligned(spark, sf_dir):
    """Both parts by the train part's vocabulary, in one scan."""
    f = E.drop_for_model(views.feat_split(spark, sf_dir), K.MODEL_DROP_COLUMNS)
    cats = E.categorical_columns(f, exclude=KEYS)
    vocab = E.fit_vocabulary_table(f.where(F.col("part") == "train"), cats)
    return E.hot_names(E.indexed(f, vocab, cats, "ROW_ID"), KEYS)


B_DROP = [c for c in K.MODEL_DROP_COLUMNS if c != "SUBSCRIPTION_STATUS"]
BINARY_COLS = ["GENDER", "SUBSCRIPTION_STATUS"]


@register("label_encode", with_views(
    "SELECT ROW_ID, " + ", ".join(
        f"CASE WHEN {c} = (SELECT min({c}) FROM shop) THEN 0 WHEN {c} IS NOT NULL THEN 1 END AS {c}"
        for c in ["GENDER", "SUBSCRIPTION_STATUS", "DISCOUNT_APPLIED", "PROMO_CODE_USED"]) + " FROM shop"))
def q_label_encode(spark, sf_dir):
    cols = ["GENDER", "SUBSCRIPTION_STATUS", "DISCOUNT_APPLIED", "PROMO_CODE_USED"]
    return E.label_encode(views.shop(spark, sf_dir).select("ROW_ID", *cols), cols)


def _onehot_full_sql():
    multi = [c for c in ONEHOT_COLS if c not in BINARY_COLS]
    parts = [f"SELECT ROW_ID, '{c}_' || {c} AS onehot FROM feat WHERE {c} IS NOT NULL" for c in multi]
    for c in BINARY_COLS:  # label-encoded: the indicator of the larger value
        parts.append(f"SELECT ROW_ID, '{c}' AS onehot FROM feat WHERE {c} = (SELECT max({c}) FROM feat)")
    return with_views(" UNION ALL ".join(parts), *FEAT)


@register("one_hot_full", _onehot_full_sql())
def q_one_hot_full(spark, sf_dir):
    """The whole frame: two-valued columns as one indicator of the larger value,
    the others by their vocabulary."""
    f = views.feat(spark, sf_dir).drop(*B_DROP)
    cats = E.categorical_columns(f)
    vocab = E.fit_vocabulary_table(f, cats)
    sizes = vocab.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).where("n <= 2").collect()  # a row per column
    binary = {r["c"]: r["v"] if r["n"] == 2 else None for r in sizes}
    multi = [c for c in cats if c not in binary]
    hot = E.indexed(f, vocab, multi, "ROW_ID")
    codes = E.label_encode_with(hot, binary)
    flags = F.explode(F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in binary]), lambda x: x.isNotNull())).alias("onehot")
    return E.hot_names(hot, ["ROW_ID"]).unionByName(codes.select("ROW_ID", flags))


STD_COLS = ["AGE", "PURCHASE_AMOUNT_USD", "PREVIOUS_PURCHASES", "REVIEW_RATING"]


@register("standardize", with_views(
    "SELECT s.ROW_ID, s.part, " + ", ".join(
        f"round((CAST(s.{c} AS DOUBLE) - m.m_{c}) / CASE WHEN m.s_{c} IS NULL OR m.s_{c} = 0 THEN 1 ELSE m.s_{c} END, 6)"
        f" AS {c}" for c in STD_COLS) + " FROM split s CROSS JOIN (SELECT " + ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in STD_COLS)
    + " FROM split WHERE part = 'train') m", *FEAT, *SPLIT))
def q_standardize(spark, sf_dir):
    f = views.feat_split(spark, sf_dir).select("ROW_ID", "part", *STD_COLS)
    train = f.where(F.col("part") == "train")
    scaler = E.fit_standardizer(train, STD_COLS)
    out = E.standardize_apply(f, scaler)
    return out.select("ROW_ID", "part", *[F.round(c, 6).alias(c) for c in STD_COLS])


@register("class_weights", with_views("""
SELECT SUBSCRIPTION_STATUS, count(*) AS n,
  round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight
FROM split WHERE part = 'train' GROUP BY SUBSCRIPTION_STATUS""", *FEAT, *SPLIT))
def q_class_weights(spark, sf_dir):
    train = views.feat_split(spark, sf_dir).where(F.col("part") == "train")
    res = E.class_weights(train, "SUBSCRIPTION_STATUS")
    return res.select("SUBSCRIPTION_STATUS", "n", F.round("weight", 6).alias("weight"))
