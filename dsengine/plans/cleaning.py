"""Cleaning pipeline (C28) and its report roll-up.

Order of steps (column types are fixed first, on the input):
  K1 classify text -> K6 drop fully categorical -> K3 encode binary pairs ->
  types -> dedup -> identifier-null rows -> rows-first rule -> high-missing
  columns -> impute by type -> casts -> standardise + synonyms -> winsorise ->
  domain rules -> rare categories -> drop constant/identifier/low-impact
  columns -> consistency checks -> optional scaling -> drop incomplete rows.

Every decision comes from an aggregate job whose result is a handful of
numbers; the rows only see literals. The table is written once after the
row-removing head (dedup + identifier rows) and once after imputation and
standardisation, so later statistics passes re-read compact parquet instead
of re-running the lineage, and a lost executor only recomputes from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import col, is_numeric_type, is_text_type
from dsengine.operators import categorical as K
from dsengine.operators import clean as C
from dsengine.operators.profile import semantic_type_map
from dsengine.session import work_path

REPORT_SCHEMA = "step string, column_name string, metric string, value double, detail string"


@dataclass
class CleanResult:
    df: DataFrame
    report: DataFrame
    types: dict
    removed_columns: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)
    rows_before: int = 0
    cols_before: int = 0


def materialize(df: DataFrame, name: str, enabled: bool = True) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage)."""
    if not enabled:
        return df
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written stage that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def clean(df: DataFrame, target: str | None = None, order_by: str | None = None,
          scale_numeric: bool = False, protect_target: bool = True,
          keep_typed_text: bool = True, encode_binary: bool = True,
          drop_fully: bool = True, exact: bool = True,
          write_stages: bool = True) -> CleanResult:
    spark: SparkSession = df.sparkSession
    rep: list[tuple] = []
    keep = [target] if (target and protect_target) else []

    import os
    import time
    trace = os.environ.get("DSENGINE_TRACE")
    clock = [time.perf_counter()]

    def add(step, column, metric, value=None, detail=None):
        if trace:
            now = time.perf_counter()
            print(f"[clean] {step:24s} +{now - clock[0]:.2f}s", flush=True)
            clock[0] = now
        rep.append((step, column, metric, None if value is None else float(value), detail))

    # the head of the pipeline reads the input several times (counts,
    # classification, types, dedup): spread and persist one that the cores hold
    # until the deduplicated table is written
    from pyspark import StorageLevel
    from dsengine.functions.staging import is_kept, spread
    source = None if is_kept(df) else spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    df = df if source is None else source
    rows_before, cols_before = df.count(), len(df.columns)
    add("input", None, "rows", rows_before)
    add("input", None, "columns", cols_before)

    # K1 / K6 / K3: one bounded-cardinality pass serves classification and
    # types (exact counts only for columns that may have few values) --------
    from dsengine.operators.profile import bounded_cardinality, semantic_types
    card, counts = bounded_cardinality(df)
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    classes = K.classify_categoricals(df, counts=counts, cardinality=card)
    removed: list[tuple[str, str]] = []
    pairs = {}
    sem_in = ({r["column_name"]: r["semantic_type"] for r in semantic_types(df, card).collect()}
              if (drop_fully and keep_typed_text) else None)
    if drop_fully:
        sem0 = sem_in
        df, dropped = K.drop_fully_categorical(df, classes, keep=keep, semantic=sem0)
        for c in dropped:
            removed.append((c, "fully_categorical"))
            add("drop_fully_categorical", c, "dropped", 1)
    if encode_binary:
        pairs = {c: p for c, p in K.binary_pairs(classes).items() if c in df.columns}
        df = K.binary_encode(df, pairs)
        for c, (p, n) in pairs.items():
            add("binary_encode", c, "encoded", 1, f"1={p},0={n}")

    # 1. types -------------------------------------------------------------
    # reuse the input's types; only encoded pairs change (text -> 0/1 boolean)
    types = dict(sem_in) if sem_in is not None else semantic_type_map(df)
    for c in pairs:
        types[c] = "boolean"
    types = {c: types[c] for c in df.columns}
    for c in df.columns:
        add("types", c, "semantic_type", None, types[c])

    # 2. dedup, 3. identifier-null rows ------------------------------------
    n0 = df.count()
    df = df.dropDuplicates()
    df = unique = materialize(df, "dedup", write_stages)
    n1 = df.count()
    if write_stages and source is not None:
        source.unpersist()
    counts.unpersist()
    add("dedup", None, "rows_removed", n0 - n1)
    df, details = C.drop_null_identifiers(df)
    for d in details:
        add("identifier_rows", d["column"], "rows_removed", d["missing_count"])

    # 4. rows-first rule, 5. high-missing columns (one aggregate unless the
    # rule fires and the shares have to be recomputed on fewer rows) -------
    n, missing, rows_missing = C.missing_profile(df)
    ratio = rows_missing / max(1, n)
    high_before = [c for c in df.columns if missing[c] / max(1, n) >= rules.HIGH_MISSING_SHARE]
    fired = bool(high_before) and ratio < rules.ROWS_FIRST_LIMIT
    if fired:
        df = C.drop_incomplete(df)
        n, missing, _ = C.missing_profile(df)
    add("rows_first", None, "applied", 1 if fired else 0)
    add("rows_first", None, "row_missing_ratio", ratio)
    add("rows_first", None, "rows_removed", rows_missing if fired else 0)
    high = [(c, missing[c], missing[c] / max(1, n)) for c in df.columns
            if missing[c] / max(1, n) >= rules.HIGH_MISSING_SHARE and c not in keep]
    df = df.drop(*[h[0] for h in high])
    for c, miss, ratio in high:
        removed.append((c, "missing_values"))
        add("drop_high_missing", c, "missing", miss, ">=40% missing")
        add("drop_high_missing", c, "ratio", ratio)

    # 6. imputation by type -------------------------------------------------
    numeric = [c for c in df.columns if types.get(c) == "numeric"]
    datetime = [c for c in df.columns if types.get(c) == "datetime"]
    categorical = [c for c in df.columns if types.get(c) == "categorical"]
    boolean = [c for c in df.columns if types.get(c) == "boolean"]
    # text typed numeric is cast before imputation so the statistics are numbers
    df = df.select(*[(C.coerce_numeric(col(c)).alias(c)
                      if c in numeric and is_text_type(df.schema[c].dataType) else col(c))
                     for c in df.columns])
    df, fills = C.impute_numeric(df, numeric)
    for c, (method, value, miss) in fills.items():
        add("impute", c, "missing", miss, method)
        if miss:
            add("impute", c, "fill_value", value, method)
    if datetime:
        order = order_by or df.columns[0]
        df = C.ffill_bfill(df, [c for c in datetime if missing[c]], order_by=order)
        for c in datetime:
            add("impute", c, "missing", missing[c], rules.IMPUTE_FILL if missing[c] else "none")
    # categorical and boolean modes from one value-count job
    modes = C.mode_values(df, categorical + boolean)
    df, cinfo = C.impute_mode(df, categorical, modes=modes)
    for c, (method, _, m) in cinfo.items():
        add("impute", c, "missing", m, method)
    df, binfo = C.impute_mode(df, boolean, boolean=True, modes=modes)
    for c, (method, _, m) in binfo.items():
        add("impute", c, "missing", m, method)

    # 7. casts, 8. standardise + synonyms ----------------------------------
    out = []
    for f in df.schema.fields:
        c = f.name
        t = types.get(c)
        if t == "numeric":
            out.append(col(c).cast("double").alias(c))
        elif t == "datetime":
            ts = col(c) if not is_text_type(f.dataType) else C.coerce_datetime(col(c))
            out.append(C.canonical_values(C.standardize_date(ts)).alias(c))
        elif t == "categorical":
            out.append(C.canonical_values(C.standardize_text(col(c).cast("string"))).alias(c))
        elif is_text_type(f.dataType):
            out.append(C.canonical_values(col(c)).alias(c))
        else:
            out.append(col(c))
    df = standard = materialize(df.select(*out), "standardized", write_stages)
    discard(unique)

    # 9. winsorise, 10. domain rules ---------------------------------------
    numeric = [c for c in df.columns if types.get(c) == "numeric"]
    df, winfo = C.winsorize(df, numeric, exact=exact)
    for c, v in winfo.items():
        add("winsorize", c, "outliers", v["outliers"])
        add("winsorize", c, "lower", v["lower"])
        add("winsorize", c, "upper", v["upper"])
    df, dinfo = C.domain_rules(df, numeric)
    for c, v in dinfo.items():
        add("domain", c, "invalid_removed", v["invalid_removed"], v["rule"])

    # 11. rare categories ---------------------------------------------------
    categorical = [c for c in df.columns if types.get(c) == "categorical"]
    df, rinfo = C.group_rare(df, categorical)
    for c, v in rinfo.items():
        add("rare", c, "rare_replaced", v["rare_replaced"])

    # 12. irrelevant columns -------------------------------------------------
    irrelevant = []
    for c in C.constant_columns_minmax(df):
        irrelevant.append((c, "constant"))
    for c in C.identifier_columns(df):
        irrelevant.append((c, "identifier"))
    for c in C.low_impact_columns(df):
        irrelevant.append((c, "low_impact"))
    seen = set()
    for c, why in irrelevant:
        if c in seen or c in keep:
            continue
        seen.add(c)
        removed.append((c, "irrelevant/constant"))
        add("drop_irrelevant", c, "dropped", 1, why)
    df = df.drop(*seen)

    # 13. consistency checks -----------------------------------------------
    for a, b, n in C.check_date_order(df):
        if n:
            add("consistency", f"{a}|{b}", "date_order_violations", n)
    for c, n in C.check_non_negative(df):
        if n:
            add("consistency", c, "negative_values", n)

    # 14. optional scaling, 15. drop incomplete rows -----------------------
    if scale_numeric:
        num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
        df = C.standard_scale(df, num)
        add("scale", None, "columns_scaled", len(num))
    before = df.count()
    df = C.drop_incomplete(df)
    df = materialize(df, "cleaned", write_stages)
    discard(standard)
    if not write_stages:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        if source is not None:
            source.unpersist()
    after = df.count()
    add("final", None, "rows_removed_missing", before - after)
    add("output", None, "rows", after)
    add("output", None, "columns", len(df.columns))
    report = spark.createDataFrame(rep, REPORT_SCHEMA)
    return CleanResult(df=df, report=report, types=types, removed_columns=removed,
                       pairs=pairs, rows_before=rows_before, cols_before=cols_before)


def cleaning_summary(res: CleanResult) -> DataFrame:
    """C29 roll-up: (metric, value, detail) rows - rows/columns before and
    after, removed columns in order with reason (first reason kept), imputed
    cells in total, duplicates and identifier rows removed."""
    spark = res.df.sparkSession
    rep = res.report
    rows = []
    first_reason = {}
    for c, why in res.removed_columns:
        first_reason.setdefault(c, why)
    for i, (c, why) in enumerate(first_reason.items()):
        rows.append(("removed_column", float(i), f"{c}:{why}"))
    rows.append(("rows_before", float(res.rows_before), None))
    rows.append(("columns_before", float(res.cols_before), None))
    base = spark.createDataFrame(rows, "metric string, value double, detail string")
    agg = rep.agg(
        F.sum(F.when((F.col("step") == "dedup") & (F.col("metric") == "rows_removed"), F.col("value"))).alias("duplicates_removed"),
        F.sum(F.when(F.col("step") == "identifier_rows", F.col("value"))).alias("identifier_rows_removed"),
        F.sum(F.when((F.col("step") == "impute") & (F.col("metric") == "missing"), F.col("value"))).alias("imputed_cells"),
        F.sum(F.when((F.col("step") == "output") & (F.col("metric") == "rows"), F.col("value"))).alias("rows_after"),
        F.sum(F.when((F.col("step") == "output") & (F.col("metric") == "columns"), F.col("value"))).alias("columns_after"),
        F.sum(F.when(F.col("step") == "final", F.col("value"))).alias("final_rows_removed"),
    )
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0.0)).cast("double").alias("value"),
                 F.lit(None).cast("string").alias("detail"))
        for m in agg.columns])).alias("s")).select("s.*")
    return base.unionByName(stacked)


def imputed_by_method(res: CleanResult) -> DataFrame:
    """Imputed cells per method family."""
    r = res.report.where((F.col("step") == "impute") & (F.col("metric") == "missing")
                         & (F.col("value") > 0))
    family = F.when(F.col("detail").startswith("mode"), "mode").otherwise(F.col("detail"))
    return r.groupBy(family.alias("method")).agg(F.sum("value").cast("bigint").alias("cells"))
