"""Driver keys: one Spark query per operator, each with its DuckDB oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLES[name] = sql``.
Each query reads whole given tables (or the ``dirty`` view derived from
``orders``); doubles are rounded to a fixed number of decimals in both the
query and the oracle so the value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_COLUMNS = LINEITEM_NUMERIC[:8] + ["l_returnflag", "l_linestatus", "l_shipdate"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Round every double column (``digits`` overrides per column)."""
    digits = digits or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`"), digits.get(f.name, default)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# import the query modules so their @register calls run
from dsengine.plans import q_profile, q_categorical_clean, q_cleaning, q_eda, q_dashboard, q_model_prep, q_models, q_rows, q_sources  # noqa: E402,F401
