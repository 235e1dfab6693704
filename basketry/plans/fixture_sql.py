"""SQL text of the analysis views for the DuckDB oracle (the driver registers
only the base tables, so every oracle inlines these as CTEs)."""

from __future__ import annotations

import re

SHOP_CTES = """ord AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS prior_orders
  FROM orders),
line AS (
  SELECT l_orderkey, l_partkey, l_discount,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey
           ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_discount) AS rn
  FROM lineitem),
shop AS (
SELECT o.o_orderkey AS ROW_ID, o.o_custkey AS CUSTOMER_ID,
  CAST(18 + (o.o_custkey * 37) % 53 AS INT) AS AGE,
  CASE WHEN o.o_custkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS GENDER,
  p.p_name AS ITEM_PURCHASED, p.p_type AS CATEGORY,
  o.o_totalprice AS PURCHASE_AMOUNT_USD,
  CASE c.c_nationkey WHEN 0 THEN 'Alaska' WHEN 1 THEN 'Minnesota' WHEN 2 THEN 'Montana' WHEN 3 THEN 'Maine'
    WHEN 4 THEN 'Vermont' WHEN 5 THEN 'Massachusetts' WHEN 6 THEN 'New York' WHEN 7 THEN 'Ohio'
    WHEN 8 THEN 'Illinois' WHEN 9 THEN 'Colorado' WHEN 10 THEN 'Oregon' WHEN 11 THEN 'Virginia'
    WHEN 12 THEN 'Maryland' WHEN 13 THEN 'Kentucky' WHEN 14 THEN 'Missouri' WHEN 15 THEN 'Tennessee'
    WHEN 16 THEN 'Florida' WHEN 17 THEN 'Texas' WHEN 18 THEN 'Georgia' WHEN 19 THEN 'Arizona'
    WHEN 20 THEN 'Nevada' WHEN 21 THEN 'California' WHEN 22 THEN 'Hawaii' WHEN 23 THEN 'Puerto Rico'
    WHEN 24 THEN 'District of Columbia' END AS LOCATION,
  CASE WHEN p.p_size <= 10 THEN 'S' WHEN p.p_size <= 30 THEN 'M' WHEN p.p_size <= 42 THEN 'L'
       WHEN p.p_size <= 50 THEN 'XL' END AS SIZE,
  p.p_brand AS COLOR,
  CASE WHEN MONTH(o.o_orderdate) IN (12,1,2) THEN 'Winter' WHEN MONTH(o.o_orderdate) <= 5 THEN 'Spring'
       WHEN MONTH(o.o_orderdate) <= 8 THEN 'Summer' ELSE 'Fall' END AS SEASON,
  CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
       ELSE CAST(25 + o.o_orderkey % 26 AS DOUBLE) / 10 END AS REVIEW_RATING,
  CASE WHEN l.l_discount >= 0.05 AND (o.o_orderkey * 7919) % 100 < 50 THEN 'Yes' ELSE 'No' END AS SUBSCRIPTION_STATUS,
  o.o_orderpriority AS SHIPPING_TYPE,
  CASE WHEN l.l_discount >= 0.05 THEN 'Yes' ELSE 'No' END AS DISCOUNT_APPLIED,
  CASE WHEN l.l_discount >= 0.06 THEN 'Yes' ELSE 'No' END AS PROMO_CODE_USED,
  CAST(2 * o.prior_orders AS INT) AS PREVIOUS_PURCHASES,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Debit Card'
    WHEN 3 THEN 'PayPal' WHEN 4 THEN 'Venmo' ELSE 'Bank Transfer' END AS PAYMENT_METHOD,
  CASE (o.o_orderkey + o.o_custkey) % 8 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Fortnightly'
    WHEN 3 THEN 'Quarterly' WHEN 4 THEN 'Annually' WHEN 5 THEN 'Monthly' WHEN 6 THEN 'Every 3 Months'
    ELSE 'Daily' END AS FREQUENCY_OF_PURCHASES
FROM ord o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN line l ON l.l_orderkey = o.o_orderkey AND l.rn = 1
JOIN part p ON p.p_partkey = l.l_partkey)"""

SEG_CTE = """seg AS (
SELECT *, CAST(CASE WHEN PREVIOUS_PURCHASES >= 14 AND PURCHASE_AMOUNT_USD >= 250000 THEN 3
  WHEN PROMO_CODE_USED = 'Yes' THEN 0 WHEN PURCHASE_AMOUNT_USD >= 350000 THEN 2
  WHEN PREVIOUS_PURCHASES >= 8 THEN 4 ELSE 1 END AS INT) AS Cluster FROM shop)"""

SCORED_CTE = """scored AS (
SELECT ROW_ID, 'alpha' AS model, CASE WHEN SUBSCRIPTION_STATUS='Yes' THEN 1 ELSE 0 END AS y,
  round(CASE WHEN DISCOUNT_APPLIED='Yes' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        + CAST(0.6 AS DOUBLE)*CAST((ROW_ID*104729) % 1000 AS DOUBLE)/1000, 3) AS p FROM shop
UNION ALL
SELECT ROW_ID, 'beta', CASE WHEN SUBSCRIPTION_STATUS='Yes' THEN 1 ELSE 0 END,
  round(CASE WHEN PROMO_CODE_USED='Yes' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        + CAST(0.8 AS DOUBLE)*CAST((ROW_ID*15485863) % 1000 AS DOUBLE)/1000, 3) FROM shop)"""


def with_views(body: str, *ctes: str) -> str:
    """``WITH`` the shop view (+ seg / scored when the text uses them) and any
    extra CTEs, then ``body``."""
    parts = [SHOP_CTES]
    text = body + " ".join(ctes)
    if re.search(r"\bseg\b", text):
        parts.append(SEG_CTE)
    if re.search(r"\bscored\b", text):
        parts.append(SCORED_CTE)
    parts.extend(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + body
