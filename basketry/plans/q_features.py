"""Registered queries: projections, derived columns, lookups (P*, J*, W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import constants as K
from basketry.operators import features as FE
from basketry.plans.fixture_sql import with_views
from basketry.plans.registry import register
from basketry.plans.sql_features import (FEAT_COLUMNS, TARGET_SQL, case_climate, case_cut, cond_prob_ctes, split_ctes,
                                         case_map, feat_ctes, nan_text)
from basketry.plans import views
from basketry.plans.views import shop as shop_frame

FEAT = feat_ctes()


def feat_frame(spark, sf_dir):
    return views.feat(spark, sf_dir)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


@register("encode_target", with_views(f"SELECT ROW_ID, {TARGET_SQL} AS TEMP_TARGET FROM shop"))
def q_encode_target(spark, sf_dir):
    return FE.encode_target(shop_frame(spark, sf_dir)).select("ROW_ID", "TEMP_TARGET")


@register("derive_spend", with_views("""
SELECT ROW_ID, PREVIOUS_PURCHASES * PURCHASE_AMOUNT_USD AS TOTAL_SPEND_WEIGHTED_NEW,
  PURCHASE_AMOUNT_USD / (PREVIOUS_PURCHASES + 1) AS SPEND_PER_PURCHASE_NEW,
  PURCHASE_AMOUNT_USD * REVIEW_RATING AS SPEND_RATING_NEW FROM shop"""))
def q_derive_spend(spark, sf_dir):
    return FE.derive_spend(shop_frame(spark, sf_dir)).select(
        "ROW_ID", "TOTAL_SPEND_WEIGHTED_NEW", "SPEND_PER_PURCHASE_NEW", "SPEND_RATING_NEW")


@register("map_frequency", with_views(
    f"SELECT ROW_ID, FREQUENCY_OF_PURCHASES, {case_map('FREQUENCY_OF_PURCHASES', K.FREQUENCY_PER_YEAR)} "
    "AS FREQUENCY_VALUE_NEW FROM shop"))
def q_map_frequency(spark, sf_dir):
    return FE.map_frequency(shop_frame(spark, sf_dir)).select(
        "ROW_ID", "FREQUENCY_OF_PURCHASES", "FREQUENCY_VALUE_NEW")


@register("map_payment_type", with_views(
    f"SELECT ROW_ID, PAYMENT_METHOD, {case_map('PAYMENT_METHOD', K.PAYMENT_TYPE)} AS PAYMENT_TYPE_NEW FROM shop"))
def q_map_payment_type(spark, sf_dir):
    return FE.map_payment_type(shop_frame(spark, sf_dir)).select("ROW_ID", "PAYMENT_METHOD", "PAYMENT_TYPE_NEW")


@register("bin_age", with_views(
    f"SELECT ROW_ID, AGE, {case_cut('AGE', K.AGE_EDGES, K.AGE_LABELS)} AS AGE_NEW FROM shop"))
def q_bin_age(spark, sf_dir):
    return FE.bin_age(shop_frame(spark, sf_dir)).select("ROW_ID", "AGE", "AGE_NEW")


@register("bin_loyalty", with_views(
    f"SELECT ROW_ID, PREVIOUS_PURCHASES, "
    f"{case_cut('PREVIOUS_PURCHASES', K.LOYALTY_EDGES, K.LOYALTY_LABELS, True)} AS LOYALTY_LEVEL_NEW FROM shop"))
def q_bin_loyalty(spark, sf_dir):
    return FE.bin_loyalty(shop_frame(spark, sf_dir)).select("ROW_ID", "PREVIOUS_PURCHASES", "LOYALTY_LEVEL_NEW")


@register("quantile_bin", with_views(
    "SELECT ROW_ID, PURCHASE_AMOUNT_USD_NEW, LOYALTY_SCORE_NEW FROM feat", *FEAT))
def q_quantile_bin(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    s = FE.qcut(s, "PURCHASE_AMOUNT_USD", 4, K.AMOUNT_QUARTILE_LABELS, "PURCHASE_AMOUNT_USD_NEW")
    s = FE.qcut(s, "PREVIOUS_PURCHASES", 4, K.LOYALTY_SCORE_LABELS, "LOYALTY_SCORE_NEW")
    return s.select("ROW_ID", "PURCHASE_AMOUNT_USD_NEW", "LOYALTY_SCORE_NEW")


@register("flag_columns", with_views(
    "SELECT ROW_ID, PROMO_NO_SUB_NEW, HIGH_REVIEW_RATING_NEW, SUBSCRIPTION, PROMO_USED_VAL FROM feat", *FEAT))
def q_flag_columns(spark, sf_dir):
    s = FE.encode_target(shop_frame(spark, sf_dir))
    return FE.flag_columns(s).select("ROW_ID", "PROMO_NO_SUB_NEW", "HIGH_REVIEW_RATING_NEW",
                                     "SUBSCRIPTION", "PROMO_USED_VAL")


@register("concat_crosses", with_views(
    f"""SELECT ROW_ID, SUB_FREQ_NEW, SHIP_SUB_NEW, SEASON_CATEGORY_NEW, SEASON_COLOR_NEW, ITEM_CATEGORY_NEW,
    concat_ws('_', {nan_text('CLIMATE_GROUP_NEW')}, {nan_text('LOYALTY_LEVEL_NEW')}) AS CLIMATE_LOYALTY_NEW
    FROM feat""", *FEAT))
def q_concat_crosses(spark, sf_dir):
    s = FE.encode_target(shop_frame(spark, sf_dir))
    s = FE.bin_loyalty(FE.add_climate_group(s))
    return FE.concat_crosses(s, variant="b").select(
        "ROW_ID", "SUB_FREQ_NEW", "SHIP_SUB_NEW", "SEASON_CATEGORY_NEW", "SEASON_COLOR_NEW",
        "ITEM_CATEGORY_NEW", "CLIMATE_LOYALTY_NEW")


@register("climate_group", with_views(
    f"SELECT ROW_ID, LOCATION, {case_climate('LOCATION')} AS CLIMATE_GROUP_NEW FROM shop"))
def q_climate_group(spark, sf_dir):
    return FE.add_climate_group(shop_frame(spark, sf_dir)).select("ROW_ID", "LOCATION", "CLIMATE_GROUP_NEW")


@register("topk_group", with_views(
    "SELECT ROW_ID, LOCATION, LOCATION_GROUPED_NEW FROM feat", *FEAT))
def q_topk_group(spark, sf_dir):
    return FE.topk_group(shop_frame(spark, sf_dir)).select("ROW_ID", "LOCATION", "LOCATION_GROUPED_NEW")


RARE_COLS = ["GENDER", "ITEM_PURCHASED", "CATEGORY", "LOCATION", "SIZE", "COLOR", "SEASON",
             "SUBSCRIPTION_STATUS", "SHIPPING_TYPE", "DISCOUNT_APPLIED", "PROMO_CODE_USED",
             "PAYMENT_METHOD", "FREQUENCY_OF_PURCHASES"]
RARE_TEST_SHARE = 0.015


def _rare_sql() -> str:
    cols = []
    for c in RARE_COLS:
        cols.append(f"""CASE WHEN {c} IS NULL THEN NULL
          WHEN {c} IN (SELECT {c} FROM shop WHERE {c} IS NOT NULL GROUP BY {c}
                       HAVING count(*) / (SELECT count(*) FROM shop) >= {RARE_TEST_SHARE}) THEN {c}
          ELSE 'Rare' END AS {c}""")
    return "SELECT ROW_ID, " + ",\n".join(cols) + " FROM shop"


@register("rare_encode", with_views(_rare_sql()))
def q_rare_encode(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    return FE.rare_encode(s, RARE_TEST_SHARE).select("ROW_ID", *RARE_COLS)


@register("interaction_features", with_views(
    "SELECT ROW_ID, PROMO_X_LOYALTY, PROMO_X_FREQ FROM feat", *FEAT))
def q_interaction_features(spark, sf_dir):
    return feat_frame(spark, sf_dir).select("ROW_ID", "PROMO_X_LOYALTY", "PROMO_X_FREQ")


@register("derive_features", with_views(
    f"SELECT ROW_ID, {', '.join(FEAT_COLUMNS)} FROM feat", *FEAT))
def q_derive_features(spark, sf_dir):
    return feat_frame(spark, sf_dir).select("ROW_ID", *FEAT_COLUMNS)


SPLIT = split_ctes()


def split_frame(spark, sf_dir):
    return views.feat_split(spark, sf_dir)


@register("stratified_split", with_views(
    "SELECT ROW_ID, SUBSCRIPTION_STATUS, part FROM split", *FEAT, *SPLIT))
def q_stratified_split(spark, sf_dir):
    from basketry.operators.split import add_split_column
    return add_split_column(shop_frame(spark, sf_dir)).select("ROW_ID", "SUBSCRIPTION_STATUS", "part")


@register("fit_conditional_probs", with_views(
    "SELECT g AS CLIMATE_GROUP_NEW, c AS CATEGORY, round(prob, 6) AS prob FROM pc",
    *FEAT, *cond_prob_ctes("pc", "CLIMATE_GROUP_NEW", "CATEGORY", "feat")))
def q_fit_conditional_probs(spark, sf_dir):
    probs = FE.fit_conditional_probs(feat_frame(spark, sf_dir), "CLIMATE_GROUP_NEW", "CATEGORY")
    return probs.select("CLIMATE_GROUP_NEW", "CATEGORY", r6("prob").alias("prob"))


@register("lookup_join_2key", with_views(
    """SELECT f.ROW_ID, round(pc.prob, 6) AS P_CATEGORY_given_CLIMATE_NEW
       FROM feat f LEFT JOIN pc ON pc.g = f.CLIMATE_GROUP_NEW AND pc.c = f.CATEGORY""",
    *FEAT, *cond_prob_ctes("pc", "CLIMATE_GROUP_NEW", "CATEGORY", "feat")))
def q_lookup_join_2key(spark, sf_dir):
    f = feat_frame(spark, sf_dir)
    probs = FE.fit_conditional_probs(f, "CLIMATE_GROUP_NEW", "CATEGORY")
    out = FE.map_conditional_probs(f, probs, "CLIMATE_GROUP_NEW", "CATEGORY", "P_CATEGORY_given_CLIMATE_NEW")
    return out.select("ROW_ID", r6("P_CATEGORY_given_CLIMATE_NEW").alias("P_CATEGORY_given_CLIMATE_NEW"))


def _fit_score_sql() -> str:
    ctes = []
    for c in ("CATEGORY", "SIZE", "SEASON"):
        ctes += cond_prob_ctes(f"p_{c.lower()}", "CLIMATE_GROUP_NEW", c, "split", "part = 'train'")
    cols, joins, means = [], [], []
    for c in ("CATEGORY", "SIZE", "SEASON"):
        t = f"p_{c.lower()}"
        joins.append(f"LEFT JOIN {t} ON {t}.g = s.CLIMATE_GROUP_NEW AND {t}.c = s.{c}")
        cols.append(f"CASE WHEN s.part = 'train' THEN {t}.prob ELSE coalesce({t}.prob, "
                    f"(SELECT avg(x.prob) FROM split y JOIN {t} x ON x.g = y.CLIMATE_GROUP_NEW AND x.c = y.{c} "
                    f"WHERE y.part = 'train')) END")
    body = f"""SELECT ROW_ID, part, round(P_CATEGORY_given_CLIMATE_NEW, 6) AS P_CATEGORY_given_CLIMATE_NEW,
      round(P_SIZE_given_CLIMATE_NEW, 6) AS P_SIZE_given_CLIMATE_NEW,
      round(P_SEASON_given_CLIMATE_NEW, 6) AS P_SEASON_given_CLIMATE_NEW,
      round(P_CATEGORY_given_CLIMATE_NEW * P_SIZE_given_CLIMATE_NEW * P_SEASON_given_CLIMATE_NEW, 6)
        AS CLIMATE_ITEM_FIT_SCORE_NEW
    FROM (SELECT s.ROW_ID, s.part, {cols[0]} AS P_CATEGORY_given_CLIMATE_NEW,
            {cols[1]} AS P_SIZE_given_CLIMATE_NEW, {cols[2]} AS P_SEASON_given_CLIMATE_NEW
          FROM split s {' '.join(joins)})"""
    return with_views(body, *FEAT, *SPLIT, *ctes)


def train_test(spark, sf_dir):
    f = views.feat_split(spark, sf_dir)
    return f.where(F.col("part") == "train"), f.where(F.col("part") == "test")


@register("fit_score", _fit_score_sql())
def q_fit_score(spark, sf_dir):
    f = views.feat_split(spark, sf_dir)
    fit = FE.fit_group_probs(f.where(F.col("part") == "train"), "CLIMATE_GROUP_NEW", ["CATEGORY", "SIZE", "SEASON"])
    out = FE.attach_probs(f, fit, F.col("part") == "test")  # both parts in one scan, one lookup join
    cols = ["P_CATEGORY_given_CLIMATE_NEW", "P_SIZE_given_CLIMATE_NEW", "P_SEASON_given_CLIMATE_NEW",
            "CLIMATE_ITEM_FIT_SCORE_NEW"]
    return out.select("ROW_ID", "part", *[r6(c).alias(c) for c in cols])


RATIOS = K.RATIO_SPECS


def _ratio_sql() -> str:
    ctes, cols, joins = [], [], []
    for i, (g, v, out) in enumerate(RATIOS):
        ctes.append(f"m{i} AS (SELECT {g} AS g, avg({v}) AS mu FROM split WHERE part = 'train' GROUP BY {g})")
        joins.append(f"LEFT JOIN m{i} ON m{i}.g = s.{g}")
        gm = f"(SELECT avg({v}) FROM split WHERE part = 'train')"
        cols.append(f"round(CASE WHEN s.part = 'train' THEN s.{v} / m{i}.mu "
                    f"ELSE coalesce(s.{v} / m{i}.mu, s.{v} / {gm}) END, 6) AS {out}")
    body = f"SELECT s.ROW_ID, s.part, {', '.join(cols)} FROM split s {' '.join(joins)}"
    return with_views(body, *FEAT, *SPLIT, *ctes)


@register("group_mean_ratio", _ratio_sql())
def q_group_mean_ratio(spark, sf_dir):
    f = views.feat_split(spark, sf_dir)
    out = FE.fit_group_mean_tables(f.where(F.col("part") == "train"), RATIOS).attach(f, F.col("part") == "test")
    outs = [o for _, _, o in RATIOS]
    return out.select("ROW_ID", "part", *[r6(c).alias(c) for c in outs])


def _transform_sql() -> str:
    ctes, cols, joins = [], [], []
    for i, (g, v, out) in enumerate(RATIOS):
        ctes.append(f"m{i} AS (SELECT {g} AS g, avg({v}) AS mu FROM feat GROUP BY {g})")
        joins.append(f"LEFT JOIN m{i} ON m{i}.g = f.{g}")
        cols.append(f"round(f.{v} / m{i}.mu, 6) AS {out}")
    return with_views(f"SELECT f.ROW_ID, {', '.join(cols)} FROM feat f {' '.join(joins)}", *FEAT, *ctes)


@register("group_transform_mean", _transform_sql())
def q_group_transform_mean(spark, sf_dir):
    f = feat_frame(spark, sf_dir)
    for g, v, out in RATIOS:
        f = FE.group_transform_mean(f, g, v, "_mean", ratio=out).drop("_mean")
    return f.select("ROW_ID", *[r6(o).alias(o) for _, _, o in RATIOS])


@register("lookup_join", with_views(
    """SELECT s.ROW_ID, s.CATEGORY, round(m.mu, 6) AS CATEGORY_MEAN_SPEND
       FROM shop s LEFT JOIN (SELECT CATEGORY, avg(PURCHASE_AMOUNT_USD) AS mu FROM shop GROUP BY CATEGORY) m
       ON m.CATEGORY = s.CATEGORY"""))
def q_lookup_join(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    means = FE.group_means(s, "CATEGORY", "PURCHASE_AMOUNT_USD", "CATEGORY_MEAN_SPEND")
    from basketry.operators.lookup import lookup_join
    return lookup_join(s, means, ["CATEGORY"]).select(
        "ROW_ID", "CATEGORY", r6("CATEGORY_MEAN_SPEND").alias("CATEGORY_MEAN_SPEND"))


@register("drop_leakage", with_views(
    "SELECT * EXCLUDE (SUB_FREQ_NEW, PROMO_NO_SUB_NEW, SHIP_SUB_NEW) FROM feat", *FEAT))
def q_drop_leakage(spark, sf_dir):
    return FE.drop_leakage(feat_frame(spark, sf_dir), mode="prefix")


@register("drop_leakage_substring", with_views(
    "SELECT * EXCLUDE (SUB_FREQ_NEW, PROMO_NO_SUB_NEW, SHIP_SUB_NEW) FROM feat", *FEAT))
def q_drop_leakage_substring(spark, sf_dir):
    """The earlier variant on one-hot names: a leaking column anywhere in a
    name. The indicator names carry a prefix, so only the substring finds them."""
    f = feat_frame(spark, sf_dir).withColumnsRenamed({c: f"X_{c}" for c in K.LEAKAGE_COLUMNS})
    return FE.drop_leakage(f, mode="substring")


@register("drop_columns", with_views(
    "SELECT * EXCLUDE (" + ", ".join(c for c in K.MODEL_DROP_COLUMNS if c != "SUBSCRIPTION_STATUS")
    + ") FROM feat", *FEAT))
def q_drop_columns(spark, sf_dir):
    cols = [c for c in K.MODEL_DROP_COLUMNS if c != "SUBSCRIPTION_STATUS"]
    return FE.drop_columns(feat_frame(spark, sf_dir), cols + ["NOT_A_COLUMN"])


SEG_FEATURES = ["FREQUENCY_VALUE_NEW", "SPEND_PER_PURCHASE_NEW", "LOYALTY_SCORE_NEW",
                "TOTAL_SPEND_WEIGHTED_NEW", "PROMO_X_FREQ"]


@register("fill_missing", with_views(
    "SELECT ROW_ID, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SEG_FEATURES) + " FROM feat", *FEAT))
def q_fill_missing(spark, sf_dir):
    f = feat_frame(spark, sf_dir).select("ROW_ID", *SEG_FEATURES)
    return FE.fill_missing(f, 0, SEG_FEATURES)


@register("fill_missing_mean", with_views(
    "SELECT s.ROW_ID, s.part, round(coalesce(s.REVIEW_RATING, (SELECT avg(REVIEW_RATING) FROM split "
    "WHERE part = 'train')), 6) AS REVIEW_RATING FROM split s", *FEAT, *SPLIT))
def q_fill_missing_mean(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    both = train.unionByName(test).select("ROW_ID", "part", "REVIEW_RATING")
    out = FE.fill_missing(both, cols=["REVIEW_RATING"], means_from=train)
    return out.select("ROW_ID", "part", r6("REVIEW_RATING").alias("REVIEW_RATING"))


# FIXED VALUES — display labels of the discount / promo axes
DISCOUNT_LABELS = {"No": "İndirim Yok", "Yes": "İndirim Var"}
PROMO_LABELS = {"No": "Promo Yok", "Yes": "Promo Var"}


@register("relabel", with_views(
    f"SELECT ROW_ID, {case_map('DISCOUNT_APPLIED', DISCOUNT_LABELS)} AS DISCOUNT_LABEL, "
    f"{case_map('PROMO_CODE_USED', PROMO_LABELS)} AS PROMO_LABEL FROM shop"))
def q_relabel(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    s = FE.relabel(s, "DISCOUNT_APPLIED", DISCOUNT_LABELS, "DISCOUNT_LABEL")
    s = FE.relabel(s, "PROMO_CODE_USED", PROMO_LABELS, "PROMO_LABEL")
    return s.select("ROW_ID", "DISCOUNT_LABEL", "PROMO_LABEL")


ALIGN_TO = ["ROW_ID", "AGE", "REVIEW_RATING", "SEASON_Winter", "PREVIOUS_PURCHASES"]


@register("align_schema", with_views(
    "SELECT ROW_ID, AGE, REVIEW_RATING, 0 AS SEASON_Winter, PREVIOUS_PURCHASES FROM shop"))
def q_align_schema(spark, sf_dir):
    return FE.align_schema(shop_frame(spark, sf_dir), ALIGN_TO)


@register("filter_eq", with_views(
    "SELECT ROW_ID, PURCHASE_AMOUNT_USD FROM shop WHERE SUBSCRIPTION_STATUS = 'Yes'"))
def q_filter_eq(spark, sf_dir):
    s = shop_frame(spark, sf_dir)
    return s.where(F.col("SUBSCRIPTION_STATUS") == "Yes").select("ROW_ID", "PURCHASE_AMOUNT_USD")


# --------------------------------------------------------------------------- from the file to the features
CLEAN_TEXT = ["GENDER", "ITEM_PURCHASED", "CATEGORY", "LOCATION", "SIZE", "COLOR", "SEASON", "SUBSCRIPTION_STATUS", "SHIPPING_TYPE",
              "DISCOUNT_APPLIED", "PROMO_CODE_USED", "PAYMENT_METHOD", "FREQUENCY_OF_PURCHASES"]
CLEAN_SHARE = 0.03


def _clean_cte(share: float) -> str:
    cols = ", ".join(f"""CASE WHEN {c} IS NULL THEN NULL WHEN {c} IN (SELECT {c} FROM shop WHERE {c} IS NOT NULL GROUP BY {c}
       HAVING count(*) / (SELECT count(*) FROM shop) >= {share}) THEN {c} ELSE '{K.RARE_LABEL}' END AS {c}""" for c in CLEAN_TEXT)
    return f"clean AS (SELECT * REPLACE ({cols}) FROM shop)"


@register("csv_to_features", with_views(
    f"SELECT ROW_ID, LOCATION, {', '.join(FEAT_COLUMNS)} FROM feat", _clean_cte(CLEAN_SHARE), *feat_ctes("clean")))
def q_csv_to_features(spark, sf_dir):
    """A header CSV through every front step in order: scan, normalise the
    names, canonical names, rare values, association drop, features."""
    from basketry.plans.q_sources import CSV_SCHEMA
    from basketry.session import scratch_path
    from basketry.sources.files import canonical_columns, raw_header_frame, scan_csv, write_csv
    path = write_csv(raw_header_frame(shop_frame(spark, sf_dir)), scratch_path(spark, "shop-csv"))
    clean = FE.clean_shoppers(canonical_columns(scan_csv(spark, path, schema=CSV_SCHEMA)), CLEAN_SHARE)
    return FE.derive_features(clean).select("ROW_ID", "LOCATION", *FEAT_COLUMNS)


# --------------------------------------------------------------------------- the candidate form's features
@register("candidate_features", with_views(f"""
SELECT ROW_ID, GENDER, CATEGORY, PURCHASE_AMOUNT_USD, PREVIOUS_PURCHASES,
  CAST(PREVIOUS_PURCHASES AS DOUBLE) * PURCHASE_AMOUNT_USD AS TOTAL_SPEND_WEIGHTED_NEW,
  round(CAST(PURCHASE_AMOUNT_USD AS DOUBLE) / (PREVIOUS_PURCHASES + 1), 6) AS SPEND_PER_PURCHASE_NEW, f AS FREQUENCY_VALUE_NEW, l AS LOYALTY_SCORE_NEW,
  CAST(coalesce(REVIEW_RATING >= 4, false) AS INT) AS HIGH_REVIEW_RATING_NEW, round(PURCHASE_AMOUNT_USD * REVIEW_RATING, 6) AS SPEND_RATING_NEW,
  CAST(PROMO_CODE_USED = 'Yes' AS INT) * l AS PROMO_X_LOYALTY, CAST(PROMO_CODE_USED = 'Yes' AS INT) * f AS PROMO_X_FREQ
FROM (SELECT *, coalesce({case_map('FREQUENCY_OF_PURCHASES', K.FREQUENCY_PER_YEAR)}, 12) AS f,
        CASE WHEN PREVIOUS_PURCHASES < 13 THEN 1 WHEN PREVIOUS_PURCHASES < 25 THEN 2 WHEN PREVIOUS_PURCHASES < 38 THEN 3 ELSE 4 END AS l FROM shop)"""))
def q_candidate_features(spark, sf_dir):
    from basketry.operators.models import candidate_features
    out = candidate_features(shop_frame(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("SPEND_PER_PURCHASE_NEW", "SPEND_RATING_NEW")})
