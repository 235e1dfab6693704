"""File sources: CSV / parquet scans and column-name normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StructType

#: Text that counts as a number: digits with point and exponent, or infinity.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# FIXED VALUES — header text of the shopper CSV, in file order, and the
# engine's column name for each
RAW_HEADERS = [
    ("Customer ID", "CUSTOMER_ID"), ("Age", "AGE"), ("Gender", "GENDER"),
    ("Item Purchased", "ITEM_PURCHASED"), ("Category", "CATEGORY"),
    ("Purchase Amount (USD)", "PURCHASE_AMOUNT_USD"), ("Location", "LOCATION"),
    ("Size", "SIZE"), ("Color", "COLOR"), ("Season", "SEASON"),
    ("Review Rating", "REVIEW_RATING"), ("Subscription Status", "SUBSCRIPTION_STATUS"),
    ("Shipping Type", "SHIPPING_TYPE"), ("Discount Applied", "DISCOUNT_APPLIED"),
    ("Promo Code Used", "PROMO_CODE_USED"), ("Previous Purchases", "PREVIOUS_PURCHASES"),
    ("Payment Method", "PAYMENT_METHOD"), ("Frequency of Purchases", "FREQUENCY_OF_PURCHASES"),
]


def normalize_name(name: str) -> str:
    """upper -> blanks to '_' -> strip, in that order (edge blanks become '_')."""
    return name.upper().replace(" ", "_").strip()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns -> double, unparsable (NaN and type suffixes such as 12d
    among them) -> null; numeric columns unchanged but for NaN -> null; absent
    columns skipped."""
    repl = {}
    for f in df.schema.fields:
        if f.name not in cols:
            continue
        if isinstance(f.dataType, (DoubleType, FloatType)):
            repl[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif not isinstance(f.dataType, NumericType):
            repl[f.name] = F.expr(f"CASE WHEN `{f.name}` RLIKE r'{NUMBER}' THEN try_cast(`{f.name}` AS DOUBLE) END")
    return df.withColumns(repl) if repl else df


def canonical_columns(df: DataFrame) -> DataFrame:
    """Normalised header names -> the names the feature step uses (the amount
    column loses its parentheses)."""
    return df.withColumnsRenamed({normalize_name(raw): canon for raw, canon in RAW_HEADERS})


def raw_header_frame(shop: DataFrame) -> DataFrame:
    """A shop frame under the CSV's original header text (plus ``Row ID``)."""
    return shop.select(F.col("ROW_ID").alias("Row ID"),
                       *[F.col(canon).alias(raw) for raw, canon in RAW_HEADERS])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("error").option("header", True).csv(path)
    return path


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             infer: bool = False, normalize: bool = True) -> DataFrame:
    """Header CSV -> frame. An explicit schema is the production path;
    ``infer`` samples the files for types (costs an extra pass)."""
    reader = spark.read.option("header", True).option("nanValue", "\u0000")  # NaN is no number here
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    return normalize_columns(df) if normalize else df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
