"""Driver keys for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dsengine.plans.fixtures import dirty, table, with_dirty
from dsengine.plans.queries import register, rounded
from dsengine.session import work_path
from dsengine.sources import io
from dsengine.sources.quoted import read_quoted


@register("read_csv_roundtrip", """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total_price,
  count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def q_read_csv_roundtrip(spark, sf):
    path = work_path(spark, "orders-csv") + ".csv"
    io.export_csv(table(spark, sf, "orders"), path)
    back = io.read_table(spark, path)
    return rounded(back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total_price"),
        F.count_distinct("o_custkey").alias("customers")), {"total_price": 2})


@register("read_csv_quoted_splits", """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents""")
def q_read_csv_quoted_splits(spark, sf):
    """Texts with line breaks, separators and quotes, read back split by split."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    path = work_path(spark, "documents-csv") + ".csv"
    io.export_csv(docs, path)
    back = read_quoted(spark, path, docs.schema)
    if back is None:
        back = io.read_table(spark, path, infer=False)
    return back.select(F.col("doc_id").cast("bigint"), "lang", "source", F.col("n_chars").cast(docs.schema["n_chars"].dataType), F.md5("text").alias("text_md5"))


@register("read_parquet_columns", """
SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS qty
FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2""")
def q_read_parquet_columns(spark, sf):
    li = io.read_table(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    return rounded(li.where(F.col("l_discount") > 0.05).groupBy("l_returnflag", "l_linestatus")
                   .agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("qty")),
                   {"qty": 2})


@register("export_csv", with_dirty("""
SELECT count(*) AS rows, count(*) FILTER (WHERE total_price IS NULL) AS null_total_price,
  count(*) FILTER (WHERE gender = ' Male') AS padded_gender,
  round(sum(total_price), 2) AS total_price FROM dirty"""))
def q_export_csv(spark, sf):
    d = dirty(spark, sf)
    path = work_path(spark, "dirty-csv")
    io.export_csv(d, path)
    back = io.read_exported_csv(spark, path, d.schema)
    return rounded(back.agg(F.count(F.lit(1)).alias("rows"),
                            F.count_if(F.col("total_price").isNull()).alias("null_total_price"),
                            F.count_if(F.col("gender") == " Male").alias("padded_gender"),
                            F.sum("total_price").alias("total_price")), {"total_price": 2})


@register("preview_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10""")
def q_preview_rows(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))
    return rounded(io.preview(o, ["o_orderkey"], 10))


@register("prediction_csv_quoting", """
SELECT conv_id, turn, role, text FROM conversations""")
def q_prediction_csv_quoting(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = work_path(spark, "conv-csv")
    io.export_csv(c, path)
    return io.read_exported_csv(spark, path, c.schema)


@register("sanitize_nonfinite", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax, 6) END AS ratio FROM lineitem""")
def q_sanitize_nonfinite(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = (F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan")))
                  .otherwise(F.lit(float("inf"))))
           .otherwise(F.col("l_discount") / F.col("l_tax")))
    return rounded(li.select("l_orderkey", "l_linenumber",
                             io.sanitize_nonfinite(raw).alias("ratio")))
