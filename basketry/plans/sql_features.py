"""Oracle SQL for the feature pipeline (``feat`` view) on top of ``shop``."""

from __future__ import annotations

from basketry.functions import constants as K


def _q(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def case_map(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + " END"


def case_cut(col: str, edges, labels, include_lowest=False) -> str:
    parts = []
    for i, lab in enumerate(labels):
        op = ">=" if (i == 0 and include_lowest) else ">"
        parts.append(f"WHEN {col} {op} {edges[i]} AND {col} <= {edges[i + 1]} THEN {_q(lab)}")
    return "CASE " + " ".join(parts) + " END"


def case_climate(col: str) -> str:
    parts = []
    for name, states in K.CLIMATE_STATES:
        parts.append(f"WHEN {col} IN ({', '.join(_q(s) for s in states)}) THEN {_q(name)}")
    return "CASE " + " ".join(parts) + f" ELSE {_q(K.CLIMATE_UNKNOWN)} END"


def nan_text(col: str) -> str:
    return f"coalesce(CAST({col} AS VARCHAR), 'nan')"


def yes(col: str) -> str:
    return f"CAST(coalesce({col} = 'Yes', false) AS INT)"


def quart_case(col: str, q: str, labels) -> str:
    return (f"CASE WHEN {col} <= {q}[1] THEN {_q(labels[0])} WHEN {col} <= {q}[2] THEN {_q(labels[1])} "
            f"WHEN {col} <= {q}[3] THEN {_q(labels[2])} WHEN {col} IS NOT NULL THEN {_q(labels[3])} END")


TARGET_SQL = "CASE WHEN SUBSCRIPTION_STATUS = 'Yes' THEN 1 WHEN SUBSCRIPTION_STATUS = 'No' THEN 0 END"

FEAT_COLUMNS = [
    "TOTAL_SPEND_WEIGHTED_NEW", "SPEND_PER_PURCHASE_NEW", "FREQUENCY_VALUE_NEW", "PAYMENT_TYPE_NEW",
    "AGE_NEW", "PURCHASE_AMOUNT_USD_NEW", "LOYALTY_LEVEL_NEW", "PROMO_NO_SUB_NEW",
    "HIGH_REVIEW_RATING_NEW", "SUBSCRIPTION", "PROMO_USED_VAL", "SPEND_RATING_NEW", "CLIMATE_GROUP_NEW",
    "SUB_FREQ_NEW", "SHIP_SUB_NEW", "SEASON_CATEGORY_NEW", "SEASON_COLOR_NEW", "ITEM_CATEGORY_NEW",
    "LOCATION_GROUPED_NEW", "LOYALTY_SCORE_NEW", "PROMO_X_LOYALTY", "PROMO_X_FREQ",
]


def feat_ctes(src: str = "shop") -> list[str]:
    """CTEs fq, ftop, ft, feat: the full feature pipeline over ``src``."""
    return [
        f"""fq AS (SELECT quantile_cont(PURCHASE_AMOUNT_USD, [0.25, 0.5, 0.75]) AS qa,
                  quantile_cont(PREVIOUS_PURCHASES, [0.25, 0.5, 0.75]) AS ql FROM {src})""",
        f"""ftop AS (SELECT LOCATION FROM {src} WHERE LOCATION IS NOT NULL GROUP BY LOCATION
                   ORDER BY count(*) DESC, LOCATION LIMIT {K.TOP_LOCATIONS})""",
        f"""ft AS (SELECT *, {TARGET_SQL} AS TEMP_TARGET FROM {src})""",
        f"""feat AS (SELECT ft.* EXCLUDE (TEMP_TARGET),
  PREVIOUS_PURCHASES * PURCHASE_AMOUNT_USD AS TOTAL_SPEND_WEIGHTED_NEW,
  PURCHASE_AMOUNT_USD / (PREVIOUS_PURCHASES + 1) AS SPEND_PER_PURCHASE_NEW,
  {case_map('FREQUENCY_OF_PURCHASES', K.FREQUENCY_PER_YEAR)} AS FREQUENCY_VALUE_NEW,
  {case_map('PAYMENT_METHOD', K.PAYMENT_TYPE)} AS PAYMENT_TYPE_NEW,
  {case_cut('AGE', K.AGE_EDGES, K.AGE_LABELS)} AS AGE_NEW,
  {quart_case('PURCHASE_AMOUNT_USD', 'fq.qa', K.AMOUNT_QUARTILE_LABELS)} AS PURCHASE_AMOUNT_USD_NEW,
  {case_cut('PREVIOUS_PURCHASES', K.LOYALTY_EDGES, K.LOYALTY_LABELS, True)} AS LOYALTY_LEVEL_NEW,
  CAST(coalesce(PROMO_CODE_USED = 'Yes' AND TEMP_TARGET = 0, false) AS INT) AS PROMO_NO_SUB_NEW,
  CAST(coalesce(REVIEW_RATING >= 4, false) AS INT) AS HIGH_REVIEW_RATING_NEW,
  {yes('SUBSCRIPTION_STATUS')} AS SUBSCRIPTION,
  {yes('PROMO_CODE_USED')} AS PROMO_USED_VAL,
  PURCHASE_AMOUNT_USD * REVIEW_RATING AS SPEND_RATING_NEW,
  {case_climate('LOCATION')} AS CLIMATE_GROUP_NEW,
  concat_ws('_', {nan_text('TEMP_TARGET')}, {nan_text('FREQUENCY_OF_PURCHASES')}) AS SUB_FREQ_NEW,
  concat_ws('_', {nan_text('SHIPPING_TYPE')}, {nan_text('TEMP_TARGET')}) AS SHIP_SUB_NEW,
  concat_ws('_', {nan_text('SEASON')}, {nan_text('CATEGORY')}) AS SEASON_CATEGORY_NEW,
  concat_ws('_', {nan_text('SEASON')}, {nan_text('COLOR')}) AS SEASON_COLOR_NEW,
  concat_ws('_', {nan_text('CATEGORY')}, {nan_text('ITEM_PURCHASED')}) AS ITEM_CATEGORY_NEW,
  CASE WHEN LOCATION IN (SELECT LOCATION FROM ftop) THEN LOCATION ELSE 'Other' END AS LOCATION_GROUPED_NEW,
  CAST({quart_case('PREVIOUS_PURCHASES', 'fq.ql', [1, 2, 3, 4])} AS INT) AS LOYALTY_SCORE_NEW,
  {yes('PROMO_CODE_USED')} * CAST({quart_case('PREVIOUS_PURCHASES', 'fq.ql', [1, 2, 3, 4])} AS INT) AS PROMO_X_LOYALTY,
  {yes('PROMO_CODE_USED')} * {case_map('FREQUENCY_OF_PURCHASES', K.FREQUENCY_PER_YEAR)} AS PROMO_X_FREQ
FROM ft CROSS JOIN fq)""",
    ]


def split_ctes(src: str = "feat", label: str = "SUBSCRIPTION_STATUS", share: str = "0.2",
               salt: int = 42) -> list[str]:
    """``split``: ``src`` plus part = test for the first round(share*n) rows of
    each label in (md5(id || '-salt'), id) order."""
    return [
        f"""sp AS (SELECT *, row_number() OVER (PARTITION BY {label}
              ORDER BY md5(CAST(ROW_ID AS VARCHAR) || '-{salt}'), ROW_ID) AS _rk,
              count(*) OVER (PARTITION BY {label}) AS _n FROM {src})""",
        """split AS (SELECT * EXCLUDE (_rk, _n),
              CASE WHEN _rk <= round(""" + share + """ * _n) THEN 'test' ELSE 'train' END AS part FROM sp)""",
    ]


def cond_prob_ctes(name: str, group: str, cat: str, src: str, where: str = "TRUE") -> list[str]:
    """``{name}``: (g, c, prob) smoothed P(cat | group), s = 1, fitted on ``src`` rows matching ``where``."""
    return [
        f"""{name}_n AS (SELECT {group} AS g, {cat} AS c, count(*) AS n FROM {src}
             WHERE {where} AND {group} IS NOT NULL AND {cat} IS NOT NULL GROUP BY 1, 2)""",
        f"""{name}_g AS (SELECT g, sum(n) AS ng FROM {name}_n GROUP BY g)""",
        f"""{name}_c AS (SELECT DISTINCT c FROM {name}_n)""",
        f"""{name} AS (SELECT gg.g, cc.c,
             CAST(coalesce(nn.n, 0) + 1 AS DOUBLE) / CAST(gg.ng + (SELECT count(*) FROM {name}_c) AS DOUBLE) AS prob
             FROM {name}_g gg CROSS JOIN {name}_c cc LEFT JOIN {name}_n nn ON nn.g = gg.g AND nn.c = cc.c)""",
    ]


def segf_cte() -> str:
    """``segf``: feat plus the fixed segment id (the seg view over features)."""
    return """segf AS (
SELECT *, CAST(CASE WHEN PREVIOUS_PURCHASES >= 14 AND PURCHASE_AMOUNT_USD >= 250000 THEN 3
  WHEN PROMO_CODE_USED = 'Yes' THEN 0 WHEN PURCHASE_AMOUNT_USD >= 350000 THEN 2
  WHEN PREVIOUS_PURCHASES >= 8 THEN 4 ELSE 1 END AS INT) AS Cluster FROM feat)"""
