"""Driver tables and the three analysis views built from them.

``shop`` is the reference's one-row-per-shopper input reconstructed from the
TPC-H-like tables (one row per order that has a line item); ``seg`` adds a
fixed segment id and ``scored`` holds deterministic probabilities of two
models. The same definitions exist as SQL text in ``basketry.plans.fixture_sql``
for the DuckDB oracle; both must give identical frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.constants import NATION_STATE, PAYMENT_BY_MOD6, FREQUENCY_BY_MOD8
from basketry.operators.ranking import row_number_in_group

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case_map(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr


def _utc_wall_clock(spark: SparkSession, df: DataFrame, col: str) -> Column:
    """The column's UTC wall-clock time whatever the session time zone: naive
    (NTZ) timestamps as they are; instant timestamps rendered in UTC."""
    if dict(df.dtypes)[col] == "timestamp":
        tz = spark.conf.get("spark.sql.session.timeZone")
        return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(col).cast("timestamp_ntz"))
    return F.col(col)


def _top_line(lineitem: DataFrame) -> DataFrame:
    """The most expensive line of each order (ties: partkey, suppkey,
    linenumber, discount). A min over a struct is an ordinary aggregate, so it
    combines map-side and a hot order key costs no more than any other."""
    best = F.min(F.struct((-F.col("l_extendedprice")).alias("neg_price"), "l_partkey",
                          "l_suppkey", "l_linenumber", "l_discount")).alias("best")
    return (lineitem.groupBy("l_orderkey").agg(best)
            .select("l_orderkey", F.col("best.l_partkey").alias("l_partkey"),
                    F.col("best.l_discount").alias("l_discount")))


def shop_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    ords = row_number_in_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "rn")
    ords = ords.withColumn("prior_orders", F.col("rn") - 1).drop("rn")
    line = _top_line(load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount"))
    customer = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")

    j = (ords.join(customer, ords.o_custkey == customer.c_custkey)
         .join(line, ords.o_orderkey == line.l_orderkey)
         .join(part, line.l_partkey == part.p_partkey))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    month = F.month(_utc_wall_clock(spark, ords, "o_orderdate"))
    disc = F.col("l_discount")
    psize = F.col("p_size")
    return j.select(
        ok.alias("ROW_ID"),
        ck.alias("CUSTOMER_ID"),
        (F.lit(18) + (ck * 37) % 53).cast("int").alias("AGE"),
        F.when(ck % 3 == 0, "Female").otherwise("Male").alias("GENDER"),
        F.col("p_name").alias("ITEM_PURCHASED"),
        F.col("p_type").alias("CATEGORY"),
        F.col("o_totalprice").alias("PURCHASE_AMOUNT_USD"),
        _case_map(F.col("c_nationkey"), NATION_STATE).alias("LOCATION"),
        F.when(psize <= 10, "S").when(psize <= 30, "M").when(psize <= 42, "L")
         .when(psize <= 50, "XL").alias("SIZE"),
        F.col("p_brand").alias("COLOR"),
        F.when(month.isin(12, 1, 2), "Winter").when(month <= 5, "Spring")
         .when(month <= 8, "Summer").otherwise("Fall").alias("SEASON"),
        F.when(ok % 97 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(25) + ok % 26).cast("double") / 10).alias("REVIEW_RATING"),
        F.when((disc >= 0.05) & ((ok * 7919) % 100 < 50), "Yes").otherwise("No")
         .alias("SUBSCRIPTION_STATUS"),
        F.col("o_orderpriority").alias("SHIPPING_TYPE"),
        F.when(disc >= 0.05, "Yes").otherwise("No").alias("DISCOUNT_APPLIED"),
        F.when(disc >= 0.06, "Yes").otherwise("No").alias("PROMO_CODE_USED"),
        (F.col("prior_orders") * 2).cast("int").alias("PREVIOUS_PURCHASES"),
        _case_map(ok % 6, PAYMENT_BY_MOD6).alias("PAYMENT_METHOD"),
        _case_map((ok + ck) % 8, FREQUENCY_BY_MOD8).alias("FREQUENCY_OF_PURCHASES"),
    )


def seg_column() -> Column:
    """Fixed segment id of the ``seg`` view."""
    pp, amt = F.col("PREVIOUS_PURCHASES"), F.col("PURCHASE_AMOUNT_USD")
    return (F.when((pp >= 14) & (amt >= 250000), 3)
            .when(F.col("PROMO_CODE_USED") == "Yes", 0)
            .when(amt >= 350000, 2)
            .when(pp >= 8, 4).otherwise(1)).cast("int")


def seg_frame(spark: SparkSession, sf_dir: str, shop: DataFrame | None = None) -> DataFrame:
    shop = shop if shop is not None else shop_frame(spark, sf_dir)
    return shop.withColumn("Cluster", seg_column())


def scored_frame(spark: SparkSession, sf_dir: str, shop: DataFrame | None = None) -> DataFrame:
    """(ROW_ID, model, y, p) for two deterministic score functions."""
    shop = shop if shop is not None else shop_frame(spark, sf_dir)
    y = F.when(F.col("SUBSCRIPTION_STATUS") == "Yes", 1).otherwise(0)
    rid = F.col("ROW_ID")

    def frac(mult: int) -> Column:
        return ((rid * mult) % 1000).cast("double") / 1000

    alpha = shop.select(rid, F.lit("alpha").alias("model"), y.alias("y"), F.round(
        F.when(F.col("DISCOUNT_APPLIED") == "Yes", F.lit(0.4).cast("double")).otherwise(0.0)
        + F.lit(0.6).cast("double") * frac(104729), 3).alias("p"))
    beta = shop.select(rid, F.lit("beta").alias("model"), y.alias("y"), F.round(
        F.when(F.col("PROMO_CODE_USED") == "Yes", F.lit(0.2).cast("double")).otherwise(0.0)
        + F.lit(0.8).cast("double") * frac(15485863), 3).alias("p"))
    return alpha.unionByName(beta)
