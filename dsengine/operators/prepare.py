"""Model preparation (M1-M8): task detection, one-hot encoding, valid-row
filter, label normalisation, deterministic splits, train-fitted scaling and
preparation statistics.

Splits are functions of an md5 hash of the row key, so they do not depend on
partitioning or task retries (``randomSplit`` does). The exact stratified
quota never ranks a whole class in one task: rows are hashed into buckets,
per (class, bucket) counts locate the boundary bucket of each class, and only
rows of that boundary bucket are ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import (all_of, col, is_numeric_type, isclose_to_rint, mean_expr,
                                      std_pop_expr, text_columns)
from dsengine.operators.onehot import VECTOR, SparseOneHot, fit_sparse

HASH_BITS = 60            # 15 hex digits of md5
BUCKET_HEX = 3            # 4096 buckets
BROADCAST_CLASSES = 10_000  # classes whose boundaries go to every task


def row_hash(key: list[str], seed: int = rules.SEED) -> Column:
    """60-bit integer hash of the row key (md5 prefix), seed mixed in."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_bucket(key: list[str], seed: int = rules.SEED) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, BUCKET_HEX), 16, 10).cast("int")


# --------------------------------------------------------------------------- M1
def detect_task(df: DataFrame, target: str) -> dict:
    """classification / regression plus the statistics behind it (M1)."""
    dt = df.schema[target].dataType
    y = col(target)
    if not is_numeric_type(dt):
        row = df.agg(F.count_distinct(y).alias("d"), F.count(y).alias("n")).first()
        return {"target": target, "task_type": "classification", "n_distinct": row["d"],
                "integer_share": None, "unique_ratio": (row["d"] / row["n"]) if row["n"] else None}
    v = y.cast("double")
    v = F.when(~F.isnan(v), v)
    row = df.agg(F.count_distinct(v).alias("d"), F.count(v).alias("n"),
                 F.avg(F.when(v.isNotNull(), isclose_to_rint(v).cast("double"))).alias("ints")).first()
    d, n = row["d"], row["n"]
    if not n:
        return {"target": target, "task_type": "classification", "n_distinct": 0,
                "integer_share": None, "unique_ratio": None}
    share, ratio = row["ints"], d / max(1, n)
    if d <= rules.TASK_MAX_DISTINCT and (share >= rules.TASK_INTEGER_SHARE or ratio <= rules.TASK_UNIQUE_RATIO):
        task = "classification"
    elif d <= rules.TASK_MAX_DISTINCT_WIDE and ratio <= rules.TASK_UNIQUE_RATIO_WIDE:
        task = "classification"
    else:
        task = "regression"
    return {"target": target, "task_type": task, "n_distinct": d, "integer_share": share,
            "unique_ratio": ratio}


# --------------------------------------------------------------------------- M2
@dataclass
class OneHotModel:
    """Fitted vocabulary: column -> sorted values (the first is the baseline);
    ``wide`` encodes columns with many values as one sparse vector."""
    vocab: dict
    wide: SparseOneHot | None = None

    def feature_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.vocab.items() for v in vals[1:]] + ([VECTOR] if self.wide else [])

    def n_features(self, names: list[str]) -> int:
        """Features behind the columns ``names``: every slot of a vector is one."""
        return len(names) + (self.wide.n_slots - 1 if self.wide and VECTOR in names else 0)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each text column by 0/1 double columns ``col_value``
        (baseline and unseen values -> all zeros, missing column -> zeros)."""
        out = [col(c) for c in df.columns if c not in self.vocab]
        for c, vals in self.vocab.items():
            for v in vals[1:]:
                if c in df.columns:
                    out.append(F.when(col(c).cast("string") == F.lit(v), 1.0).otherwise(0.0)
                               .alias(f"{c}_{v}"))
                else:
                    out.append(F.lit(0.0).alias(f"{c}_{v}"))
        df = df.select(*out)
        return self.wide.transform(df) if self.wide else df


def fit_one_hot(df: DataFrame, cols: list[str] | None = None, columns_at_most: int | None = None) -> OneHotModel:
    """Learn the sorted vocabulary of text columns (M2). Every value but the
    first becomes an output column, so the vocabulary is the schema of the
    encoded table and reaches the driver whole; text columns with more than
    ``columns_at_most`` values become one sparse vector instead, whose vocabulary
    stays a table."""
    cols = text_columns(df) if cols is None else list(cols)
    if not cols:
        return OneHotModel({})
    if columns_at_most is not None:
        row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        wide = [c for i, c in enumerate(cols) if row[f"d{i}"] > columns_at_most]
        narrow = fit_one_hot(df, [c for c in cols if c not in wide])
        return OneHotModel(narrow.vocab, fit_sparse(df, wide) if wide else None)
    items = [F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in cols]
    vals = (df.select(F.explode(F.array(*items)).alias("s")).select("s.c", "s.v")
            .where(F.col("v").isNotNull()).distinct())
    vocab = {c: [] for c in cols}
    for r in vals.collect():
        vocab[r["c"]].append(r["v"])
    return OneHotModel({c: sorted(v) for c, v in vocab.items()})


# --------------------------------------------------------------------------- M3
@dataclass
class Prepared:
    df: DataFrame            # feature columns (double) + target, valid rows only
    features: list[str]
    target: str
    one_hot: OneHotModel
    task_type: str
    label_kind: str          # "int" | "text" | "numeric"
    total_rows: int = 0


def assemble_numeric(df: DataFrame, target: str, one_hot: OneHotModel | None = None,
                     passthrough: list[str] | None = None
                     ) -> tuple[DataFrame, list[str], OneHotModel]:
    """One-hot the text features, cast everything to double, keep rows with
    every feature and the target present (M3). ``passthrough`` columns (row
    ids) are kept unchanged and are not features."""
    keep = list(passthrough or [])
    feats = df.drop(target, *keep)
    one_hot = one_hot or fit_one_hot(feats, columns_at_most=rules.ONE_HOT_COLUMNS)
    names = one_hot.transform(feats).columns
    enc = one_hot.transform(df)
    sel = ([col(c) if c == VECTOR else F.col(f"`{c}`").cast("double").alias(c) for c in names] + [col(target)]
           + [col(k) for k in keep])
    out = enc.select(*sel)
    conds = [col(target).isNotNull()]
    for c in names:
        if c == VECTOR:
            continue
        v = F.col(f"`{c}`")
        conds += [v.isNotNull(), ~F.isnan(v)]
    if is_numeric_type(df.schema[target].dataType):
        conds.append(~F.isnan(col(target).cast("double")))
    return out.where(all_of(conds)), names, one_hot


# --------------------------------------------------------------------------- M4
def normalize_labels(df: DataFrame, target: str) -> tuple[DataFrame, str]:
    """Numeric classification labels: integer-like share >= .95 -> rounded
    int, else text; text labels stay text (M4)."""
    dt = df.schema[target].dataType
    if not is_numeric_type(dt):
        return df, "text"
    v = col(target).cast("double")
    share = df.agg(F.avg(isclose_to_rint(v).cast("double")).alias("s")).first()["s"]
    if share is not None and share >= rules.LABEL_ROUND_SHARE:
        return df.withColumn(target, F.rint(v).cast("bigint")), "int"
    return df.withColumn(target, col(target).cast("string")), "text"


# --------------------------------------------------------------------------- M5/M6
def random_split(df: DataFrame, key: list[str], test_share: float = rules.TEST_SHARE,
                 seed: int = rules.SEED) -> DataFrame:
    """Adds ``is_test``: hash below test_share of the 60-bit range (M6)."""
    limit = int(test_share * (1 << HASH_BITS))
    return df.withColumn("is_test", row_hash(key, seed) < F.lit(limit))


def stratified_split(df: DataFrame, label: str, key: list[str],
                     test_share: float = rules.TEST_SHARE, seed: int = rules.SEED,
                     rank_limit: int = 100_000, report: bool = False):
    """Adds ``is_test`` with an exact per-class quota round(test_share * n_c):
    the rows of each class with the smallest hashes (ties by key text) (M5).

    Counts per (class, md5 prefix) give, by a running sum over at most a few
    thousand prefixes of each class, the prefix that holds the class's quota
    boundary; only the rows of that prefix are ranked. The prefix is as long as
    it takes to hold about ``rank_limit`` rows, so a class with a third of all
    rows never becomes one sorted window. Nor does it meet its boundary in one
    task: few boundaries are broadcast, many are joined by class and prefix.
    Classes stay in DataFrames, in any number. Falls back to the random split when a class has fewer than 2 rows;
    rows without a label form a class of their own."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in key])
    full = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    sizes = df.groupBy(col(label).cast("string").alias("__y")).agg(F.count(F.lit(1)).alias("n_c"))
    told = sizes.agg(F.count(F.lit(1)).alias("classes"), F.min("n_c").alias("least"), F.max("n_c").alias("most")).first()
    if not told["classes"] or told["least"] < 2:
        out = random_split(df, key, test_share, seed)
        return (out, 0) if report else out
    digits = BUCKET_HEX
    while told["most"] / 16 ** digits > rank_limit:
        digits += 1
    tagged = (df.withColumn("__y", col(label).cast("string")).withColumn("__md5", full).withColumn("__k", text)
              .withColumn("__p", F.substring("__md5", 1, digits)))
    per = tagged.groupBy("__y", "__p").agg(F.count(F.lit(1)).alias("cnt"))
    upto = Window.partitionBy("__y").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.floor(F.sum("cnt").over(Window.partitionBy("__y")) * F.lit(test_share) + 0.5)
    per = per.select("__y", "__p", (F.sum("cnt").over(upto) - F.col("cnt")).alias("__before"), quota.alias("__quota"))
    # each class's boundary: the last prefix that starts below the quota
    bounds = (per.where(F.col("__before") < F.col("__quota")).groupBy("__y")
              .agg(F.max("__p").alias("__bp"), F.max("__before").alias("__before"), F.max("__quota").alias("__quota"))
              .withColumnRenamed("__y", "__by"))
    if told["classes"] <= BROADCAST_CLASSES:
        tagged = tagged.join(F.broadcast(bounds), F.col("__y").eqNullSafe(F.col("__by")), "left")
    else:
        pieces = (per.select(F.col("__y").alias("__py"), F.col("__p").alias("__pp"))
                  .join(bounds, F.col("__py").eqNullSafe(F.col("__by")), "left"))
        tagged = tagged.join(pieces, F.col("__y").eqNullSafe(F.col("__py")) & (F.col("__p") == F.col("__pp")), "left")
    at = F.coalesce(F.col("__p") == F.col("__bp"), F.lit(False))
    wr = Window.partitionBy("__y").orderBy("__md5", "__k")
    ranked = (tagged.where(at)
              .withColumn("is_test", F.col("__before") + F.row_number().over(wr) <= F.col("__quota")))
    rest = tagged.where(~at).withColumn("is_test", F.coalesce(F.col("__p") < F.col("__bp"), F.lit(False)))
    cols = df.columns + ["is_test"]
    out = rest.select(*cols).unionByName(ranked.select(*cols))
    return (out, told["classes"]) if report else out


def split(df: DataFrame, label: str, key: list[str], task_type: str,
          test_share: float = rules.TEST_SHARE, seed: int = rules.SEED) -> DataFrame:
    """Stratified for classification, random for regression; a train side
    with one class (or < 2 rows) falls back to all rows on both sides."""
    if task_type == "classification":
        out, n_classes = stratified_split(df, label, key, test_share, seed, report=True)
        if n_classes >= 2:
            # stratified: every class has >= 2 rows and keeps
            # n_c - round(0.2 n_c) >= 1 training rows, so train has every class
            return out
        train_classes = out.where(~F.col("is_test")).select(label).distinct().limit(2).count()
        if train_classes < 2:
            return _both(df)
        return out
    out = random_split(df, key, test_share, seed)
    if out.where(~F.col("is_test")).limit(2).count() < 2:
        return _both(df)
    return out


def _both(df: DataFrame) -> DataFrame:
    """All rows as train and again as test."""
    return (df.withColumn("is_test", F.lit(False))
            .unionByName(df.withColumn("is_test", F.lit(True))))


# --------------------------------------------------------------------------- M7
def fit_scaler(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, population std)} from the train side (M7). A sparse vector
    is left as it is: centring would fill it."""
    cols = [c for c in cols if c != VECTOR]
    if not cols:
        return {}
    row = train.agg(*[mean_expr(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[std_pop_expr(col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            m = 0.0 if m is None else m
            s = 1.0 if not s else s
            out.append(((col(c) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


# --------------------------------------------------------------------------- M8
def prep_stats(split_df: DataFrame, target: str, features: list[str], task_type: str, n_features: int | None = None) -> DataFrame:
    """Sample counts, feature count and target statistics in one aggregate (M8)."""
    y = col(target).cast("string").try_cast("double") if not is_numeric_type(
        split_df.schema[target].dataType) else col(target).cast("double")
    return split_df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(~F.col("is_test")).alias("train_samples"),
        F.count_if(F.col("is_test")).alias("test_samples"),
        F.lit(len(features) if n_features is None else n_features).cast("bigint").alias("n_features"),
        F.lit(task_type).alias("task_type"),
        F.min(y).alias("target_min"), F.max(y).alias("target_max"),
        mean_expr(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"),
        F.count_distinct(col(target)).alias("target_unique"))
