"""Inputs for the driver keys: the given parquet tables and the derived
``dirty`` view (FIXTURES.md section 3), built with the DataFrame API so it
stays a lazy plan over ``orders`` (column pruning and pushdown apply)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    base = o.select(
        k.alias("k"),
        F.when(k % 97 == 5, F.lit(None)).otherwise(k).alias("order_id"),
        F.concat(F.lit("Cust "), F.col("o_custkey").cast("string")).alias("customer_name"),
        (F.col("o_custkey") % 150 - 10).alias("customer_age"),
        F.when(k % 4 == 0, "M").when(k % 4 == 1, "f").when(k % 4 == 2, " Male")
        .otherwise("FEMALE ").alias("gender"),
        F.when(k % 10 == 3, F.lit(None)).when(k % 50 == 7, price * 20)
        .otherwise(price).alias("total_price"),
        F.when(k % 7 == 2, F.lit(None)).when(k % 6 == 1, price / 20)
        .otherwise(price / 1000).alias("shipping_cost"),
        F.when(k % 40 == 9, F.lit(-5.0)).otherwise((k % 100).cast("double"))
        .alias("discount_rate"),
        F.when(k % 13 == 4, F.lit(None)).when(k % 500 == 1, "rare_x")
        .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(k % 11 == 6, F.lit(None)).when(price > 250000, "Yes")
        .otherwise("No").alias("is_large"),
        F.when(k % 5 < 3, F.lit(None)).otherwise(F.col("o_custkey")).alias("legacy_code"),
        F.lit(1).alias("source_flag"),
        day.cast("string").alias("start_date"),
        F.when(k % 17 == 8, F.lit(None))
        .otherwise(F.date_add(day, (k % 9 - 2).cast("int")).cast("string")).alias("end_date"),
        F.when(k % 60 == 10, F.lit(-1).cast("bigint")).otherwise(k % 8).alias("item_count"),
        F.col("o_orderstatus").alias("status"),
    )
    return base.unionAll(base.where(F.col("k") % 20 == 0))


DIRTY_SQL = """
WITH base AS (
  SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE o_orderkey END AS order_id,
    'Cust ' || CAST(o_custkey AS STRING) AS customer_name,
    o_custkey % 150 - 10 AS customer_age,
    CASE WHEN o_orderkey % 4 = 0 THEN 'M' WHEN o_orderkey % 4 = 1 THEN 'f' WHEN o_orderkey % 4 = 2 THEN ' Male' ELSE 'FEMALE ' END AS gender,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 50 = 7 THEN o_totalprice * 20 ELSE o_totalprice END AS total_price,
    CASE WHEN o_orderkey % 7 = 2 THEN NULL WHEN o_orderkey % 6 = 1 THEN o_totalprice / 20 ELSE o_totalprice / 1000 END AS shipping_cost,
    CASE WHEN o_orderkey % 40 = 9 THEN -5.0 ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS discount_rate,
    CASE WHEN o_orderkey % 13 = 4 THEN NULL WHEN o_orderkey % 500 = 1 THEN 'rare_x' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 11 = 6 THEN NULL WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS is_large,
    CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_custkey END AS legacy_code,
    1 AS source_flag,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS start_date,
    CASE WHEN o_orderkey % 17 = 8 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 2 AS INT) AS STRING) END AS end_date,
    CASE WHEN o_orderkey % 60 = 10 THEN -1 ELSE o_orderkey % 8 END AS item_count,
    o_orderstatus AS status
  FROM orders)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE k % 20 = 0
"""

DIRTY_COLUMNS = ["k", "order_id", "customer_name", "customer_age", "gender", "total_price",
                 "shipping_cost", "discount_rate", "priority", "is_large", "legacy_code",
                 "source_flag", "start_date", "end_date", "item_count", "status"]
DIRTY_NUMERIC = ["k", "order_id", "customer_age", "total_price", "shipping_cost",
                 "discount_rate", "legacy_code", "source_flag", "item_count"]
DIRTY_TEXT = ["customer_name", "gender", "priority", "is_large", "start_date", "end_date",
              "status"]


def with_dirty(sql: str) -> str:
    """Prefix an oracle query with the ``dirty`` view as a CTE."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH dirty AS ({DIRTY_SQL}), {body[5:]}"
    return f"WITH dirty AS ({DIRTY_SQL}) {body}"
