"""Registered queries: scans and sources (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.plans.fixture_sql import with_views
from basketry.session import scratch_path
from basketry.sources.files import (RAW_HEADERS, coerce_numeric, normalize_columns,
                                    raw_header_frame, scan_csv, write_csv)
from basketry.plans.registry import register
from basketry.plans.views import shop as shop_frame

SHOP_COLS = ["ROW_ID", "CUSTOMER_ID", "AGE", "GENDER", "ITEM_PURCHASED", "CATEGORY",
             "PURCHASE_AMOUNT_USD", "LOCATION", "SIZE", "COLOR", "SEASON", "REVIEW_RATING",
             "SUBSCRIPTION_STATUS", "SHIPPING_TYPE", "DISCOUNT_APPLIED", "PROMO_CODE_USED",
             "PREVIOUS_PURCHASES", "PAYMENT_METHOD", "FREQUENCY_OF_PURCHASES"]

NORMALISED = ["ROW_ID"] + [raw.upper().replace(" ", "_").strip() for raw, _ in RAW_HEADERS]


def _normalised_select() -> str:
    out = ["ROW_ID"]
    for raw, canon in RAW_HEADERS:
        out.append(f'{canon} AS "{raw.upper().replace(" ", "_").strip()}"')
    return ", ".join(out)


@register("shop_view", with_views(f"SELECT {', '.join(SHOP_COLS)} FROM shop"))
def q_shop_view(spark, sf_dir):
    from basketry.sources.tables import shop_frame as derive_shop
    return derive_shop(spark, sf_dir)


CSV_SCHEMA = ("`Row ID` BIGINT, `Customer ID` BIGINT, `Age` INT, `Gender` STRING, "
              "`Item Purchased` STRING, `Category` STRING, `Purchase Amount (USD)` DOUBLE, "
              "`Location` STRING, `Size` STRING, `Color` STRING, `Season` STRING, "
              "`Review Rating` DOUBLE, `Subscription Status` STRING, `Shipping Type` STRING, "
              "`Discount Applied` STRING, `Promo Code Used` STRING, `Previous Purchases` INT, "
              "`Payment Method` STRING, `Frequency of Purchases` STRING")


@register("scan_csv", with_views(f"SELECT {_normalised_select()} FROM shop"))
def q_scan_csv(spark, sf_dir):
    """shop written as a header CSV to the shared checkpoint folder, then
    scanned back with an explicit schema and normalised names."""
    path = write_csv(raw_header_frame(shop_frame(spark, sf_dir)), scratch_path(spark, "shop-csv"))
    return scan_csv(spark, path, schema=CSV_SCHEMA)


@register("normalize_columns", with_views(f"SELECT {_normalised_select()} FROM shop"))
def q_normalize_columns(spark, sf_dir):
    return normalize_columns(raw_header_frame(shop_frame(spark, sf_dir)))


ODD_TEXT = ["unknown", "NaN", "12d", "1f", "  ", "Infinity", " 1.2e3 "]


@register("coerce_numeric", with_views("""
SELECT ROW_ID,
  CASE WHEN ROW_ID % 89 < 5 THEN NULL WHEN ROW_ID % 89 = 5 THEN 'Infinity'::DOUBLE WHEN ROW_ID % 89 = 6 THEN 1200.0
       ELSE CAST(AGE AS DOUBLE) END AS AGE,
  PURCHASE_AMOUNT_USD, CAST(PREVIOUS_PURCHASES AS DOUBLE) AS PREVIOUS_PURCHASES,
  REVIEW_RATING FROM shop"""))
def q_coerce_numeric(spark, sf_dir):
    """The four numeric columns arrive as text (some ages in odd forms, missing
    ratings blank) and are coerced back: unparsable -> null."""
    s = shop_frame(spark, sf_dir)
    text = s.select(
        "ROW_ID",
        F.coalesce(F.get(F.array(*[F.lit(x) for x in ODD_TEXT]), (F.col("ROW_ID") % 89).cast("int")),
                   F.col("AGE").cast("string")).alias("AGE"),
        F.col("PURCHASE_AMOUNT_USD").cast("string").alias("PURCHASE_AMOUNT_USD"),
        F.col("PREVIOUS_PURCHASES").cast("string").alias("PREVIOUS_PURCHASES"),
        F.coalesce(F.col("REVIEW_RATING").cast("string"), F.lit("")).alias("REVIEW_RATING"))
    return coerce_numeric(text, ["AGE", "PURCHASE_AMOUNT_USD", "PREVIOUS_PURCHASES", "REVIEW_RATING"])
