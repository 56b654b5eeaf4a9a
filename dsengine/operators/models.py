"""Model zoo (M9-M24): eight classifiers and eight regressors.

Input of every ``fit_*``: a train DataFrame with double feature columns, a
``label`` column (class index 0..K-1 for classification, double for
regression) and optionally ``__w`` weights. Output: a ``Fitted`` object whose
``transform(df)`` adds ``prediction`` (and ``probability`` array for
classifiers that have one).

Built-in Spark ML estimators are used where they exist (logistic, forests,
GBT, trees, linear regression). Composed ones:
* AdaBoost (SAMME): each round a weighted decision stump is chosen from one
  job over (feature, cut, class); the vote reads the stumps from one array.
* AdaBoost.R2: weighted depth-3 regression trees (Spark ML, ``weightCol``),
  weighted-median read-out with array functions.
* kNN: exact, by metric partitions (``neighbours.py``), one path at every size.
* RBF SVM / SVR: landmark features of measured error (``kernel.py``), then
  LinearSVC (one-vs-rest) / Huber linear regression.
* Neural networks: data-parallel Adam with early stop (``network.py``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions import staging
from dsengine.functions.staging import drop_stage, spread_rows, write_stage
from dsengine.operators.kernel import fit_landmarks, kernel_features
from dsengine.operators.neighbours import nearest_rows
from dsengine.operators.network import apply_network, fit_network
from dsengine.operators.onehot import VECTOR

CLASSIFIERS = rules.CLASSIFIERS
REGRESSORS = rules.REGRESSORS


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


@dataclass
class Fitted:
    name: str
    task: str
    features: list[str]
    n_classes: int = 0
    model: Any = None
    extra: dict = field(default_factory=dict)
    transform_fn: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transform_fn(self, df)

    def importances(self) -> list[tuple[str, float]]:
        """Tree importances, else |coefficient| (first class); descending."""
        m = self.model
        vals = None
        if m is not None and hasattr(m, "featureImportances"):
            vals = m.featureImportances.toArray().tolist()
        elif m is not None and hasattr(m, "coefficientMatrix"):
            vals = [abs(v) for v in m.coefficientMatrix.toArray()[0].tolist()]
        elif m is not None and hasattr(m, "coefficients"):
            vals = [abs(v) for v in m.coefficients.toArray().tolist()]
        elif "importance" in self.extra:
            vals = self.extra["importance"]
        if vals is not None and VECTOR in self.features and len(vals) >= len(self.features):
            vals = vals[:len(self.features) - 1] + [sum(vals[len(self.features) - 1:])]  # the vector comes last
        if vals is None or len(vals) != len(self.features):
            return []
        return sorted(zip(self.features, [float(v) for v in vals]), key=lambda t: -t[1])


def _ml_transform(f: Fitted, df: DataFrame) -> DataFrame:
    cols = df.columns
    out = f.model.transform(assemble(df, f.features))
    sel = [F.col(c) for c in cols] + [F.col("prediction").cast("double").alias("prediction")]
    if f.task == "classification" and "probability" in out.columns:
        sel.append(vector_to_array("probability").alias("probability"))
    elif f.task == "classification" and "rawPrediction" in out.columns:
        # one-vs-rest gives raw margins only: normalised sigmoid as probabilities
        raw = vector_to_array("rawPrediction")
        sig = F.transform(raw, lambda v: 1 / (1 + F.exp(-v)))
        tot = F.aggregate(sig, F.lit(0.0), lambda a, v: a + v)
        sel.append(F.transform(sig, lambda v: v / tot).alias("probability"))
    return out.select(*sel)


def _fit_ml(name, task, est, train, features, n_classes=0, weight=False, alike=False) -> Fitted:
    if weight and "__w" in train.columns:
        est = est.setWeightCol("__w")
    model = est.fit(assemble(dealt(train, features, alike=alike), features))
    return Fitted(name, task, features, n_classes, model, transform_fn=_ml_transform)


#: About what a fit keeps of a row in memory beside its values.
ROW_BYTES = 128


def dealt(train: DataFrame, features: list[str], values: int | None = None, alike: bool = False) -> DataFrame:
    """``train`` in tasks of bounded size for a fit that keeps ``values`` numbers a row
    (its features, if not given) and goes over them many times. With ``alike`` the rows of
    a large table come in the order of their features in each task: neighbours then mostly
    reach the same nodes of deep trees, whose sums are still in the processor's cache."""
    kept = [c for c in train.columns if c in features or c in ("label", "__w")]
    rows, size = train.count(), ROW_BYTES + 8 * (values or len(features))
    out = spread_rows(train.select(*[F.col(f"`{c}`") for c in kept]), rows, size)
    if alike and rows * size > staging.TASK_BYTES:
        out = out.sortWithinPartitions(*[F.col(f"`{c}`") for c in [f for f in features if f != VECTOR] + ["label"]])
    return out


def scalars(name: str, features: list[str]) -> None:
    """Models that work on plain columns cannot read a sparse vector."""
    if VECTOR in features:
        raise ValueError(f"{name} reads plain columns only: group rare values or drop wide text columns first")


# --------------------------------------------------------------------------- built-in
def fit_logistic(train, features, n_classes, max_iter=rules.MAX_ITER):
    n = train.count()
    est = LogisticRegression(maxIter=max_iter, regParam=1.0 / max(1, n), elasticNetParam=0.0,
                             family="multinomial", standardization=False)
    return _fit_ml("Logistic Regression", "classification", est, train, features, n_classes)


def fit_forest_classifier(train, features, n_classes, trees=rules.N_TREES, depth=rules.TREE_MAX_DEPTH):
    est = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=rules.SEED)
    return _fit_ml("Random Forest Classifier", "classification", est, train, features, n_classes)


def fit_gbt_classifier(train, features, n_classes, rounds=rules.N_TREES):
    gbt = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=rules.SEED)
    est = gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
    return _fit_ml("Gradient Boosting Classifier", "classification", est, train, features, n_classes)


def fit_tree_classifier(train, features, n_classes, depth=rules.TREE_MAX_DEPTH):
    est = DecisionTreeClassifier(maxDepth=depth, seed=rules.SEED)
    return _fit_ml("Decision Tree Classifier", "classification", est, train, features, n_classes)


def fit_mlp_classifier(train, features, n_classes, max_iter=rules.MLP_MAX_ITER):
    """Neural network with cross-entropy, early stop by held-out loss."""
    scalars("Neural Network Classifier", features)
    extra = fit_network(train, features, max(2, n_classes), max_iter)
    return Fitted("Neural Network Classifier", "classification", features, n_classes, None, extra, net_transform)


def net_transform(f: Fitted, df: DataFrame) -> DataFrame:
    out = apply_network(f.extra, f.features, df)
    kept = [F.col(f"`{c}`") for c in df.columns]
    if not f.extra["classes"]:
        return out.select(*kept, F.col("__net")[0].alias("prediction"))
    best = (F.array_position("__net", F.array_max("__net")) - 1).cast("double")
    return out.select(*kept, best.alias("prediction"), F.col("__net").alias("probability"))


def fit_linear(train, features):
    est = LinearRegression(solver="normal", regParam=0.0)
    return _fit_ml("Linear Regression", "regression", est, train, features)


def fit_forest_regressor(train, features, trees=rules.N_TREES, depth=rules.TREE_MAX_DEPTH):
    # a row keeps the node it has reached in every tree, instead of falling from the root again for each level
    est = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=rules.SEED, cacheNodeIds=True)
    return _fit_ml("Random Forest Regressor", "regression", est, train, features, alike=True)


def fit_gbt_regressor(train, features, rounds=rules.N_TREES):
    est = GBTRegressor(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=rules.SEED)
    return _fit_ml("Gradient Boosting Regressor", "regression", est, train, features)


def fit_tree_regressor(train, features, depth=rules.TREE_MAX_DEPTH):
    est = DecisionTreeRegressor(maxDepth=depth, seed=rules.SEED, cacheNodeIds=True)
    return _fit_ml("Decision Tree Regressor", "regression", est, train, features)


# --------------------------------------------------------------------------- kernel SVM
def _kernel_frame(df: DataFrame, features, extra):
    return df.withColumn("__phi", kernel_features(extra, features))


def fit_svm(train, features, n_classes, n_out=rules.LANDMARKS, max_iter=rules.KERNEL_MAX_ITER):
    """Linear SVM on landmark features of the RBF kernel, with unit cost a row; with two
    classes the margin is turned into a probability by a logistic model of the training
    labels. The kernel's measured error is in ``extra``."""
    scalars("Support Vector Machine", features)
    extra = fit_landmarks(train, features, n_out)
    t = _kernel_frame(dealt(train, features, len(extra["landmarks"])), features, extra)
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / max(1, train.count()), featuresCol="__phi", standardization=False)
    est = svc if n_classes <= 2 else OneVsRest(classifier=svc, featuresCol="__phi")
    model = est.fit(t)
    if n_classes <= 2:
        margin = model.transform(t).select(F.col("label"), vector_to_array("rawPrediction")[1].alias("m"))
        curve = LogisticRegression(maxIter=50).fit(assemble(margin, ["m"]))
        extra["platt"] = [float(curve.coefficients[0]), float(curve.intercept)]
    return Fitted("Support Vector Machine", "classification", features, n_classes, model, extra, svm_transform)


def svm_transform(f: Fitted, df: DataFrame) -> DataFrame:
    out = f.model.transform(_kernel_frame(df, f.features, f.extra))
    raw = vector_to_array("rawPrediction")
    if "platt" in f.extra:
        a, b = f.extra["platt"]
        p = 1 / (1 + F.exp(-(F.lit(a) * raw[1] + F.lit(b))))
        prob = F.array(1 - p, p)
    else:
        sig = F.transform(raw, lambda v: 1 / (1 + F.exp(-v)))
        tot = F.aggregate(sig, F.lit(0.0), lambda x, v: x + v)
        prob = F.transform(sig, lambda v: v / tot)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("prediction").cast("double").alias("prediction"),
                      prob.alias("probability"))


def fit_svr(train, features, n_out=rules.LANDMARKS, max_iter=rules.KERNEL_MAX_ITER):
    """Robust linear regression on landmark features of the RBF kernel."""
    scalars("Support Vector Regressor", features)
    extra = fit_landmarks(train, features, n_out)
    model = LinearRegression(loss="huber", maxIter=max_iter, regParam=0.0, featuresCol="__phi").fit(_kernel_frame(dealt(train, features, len(extra["landmarks"])), features, extra))
    return Fitted("Support Vector Regressor", "regression", features, 0, model, extra, svr_transform)


def svr_transform(f: Fitted, df: DataFrame) -> DataFrame:
    out = f.model.transform(_kernel_frame(df, f.features, f.extra))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("prediction").cast("double").alias("prediction"))


# --------------------------------------------------------------------------- kNN
#: Distances that a kNN task holds at once: test rows x train rows of a tile.
KNN_TILE = (256, 8192)


def knn_neighbours(train: DataFrame, test: DataFrame, features: list[str], k: int,
                   id_col: str, chunk_cells: int = 5_000_000, n_train: int | None = None) -> DataFrame:
    """Exact k nearest train rows for every test row: (qid, d2, nid, ny, rank), by
    metric partitions. Blocks of train rows hold ``chunk_cells`` values (rows x
    features) at most; ties in distance are broken by the train id."""
    return nearest_rows(train, test, features, k, id_col, chunk_cells, KNN_TILE, n_train)


def fit_knn(train, features, task, k=rules.KNN_K, id_col="__rowid"):
    """Lazy learner: keeps the train frame; k = min(5, train rows)."""
    scalars("K-Nearest Neighbors", features)
    n = train.count()
    k = min(k, n)
    name = "K-Nearest Neighbors " + ("Regressor" if task == "regression" else "Classifier")
    keep = train.select(id_col, "label", *[F.col(f"`{c}`") for c in features])
    return Fitted(name, task, features, 0, None, {"train": keep, "k": k, "id_col": id_col, "n": n}, knn_transform)


def knn_transform(f: Fitted, df: DataFrame) -> DataFrame:
    """Mean of the neighbours' labels, or their vote (smallest label on ties)
    with the vote shares as probabilities."""
    id_col = f.extra["id_col"]
    nb = knn_neighbours(f.extra["train"], df, f.features, f.extra["k"], id_col, n_train=f.extra.get("n"))
    if f.task == "regression":
        agg = nb.groupBy("__qid").agg(F.avg("__ny").alias("prediction"))
    else:
        votes = nb.groupBy("__qid", "__ny").agg(F.count(F.lit(1)).alias("__v"))
        agg = votes.groupBy("__qid").agg(F.min(F.struct((-F.col("__v")).alias("v"), "__ny"))["__ny"].alias("prediction"),
                                         F.map_from_entries(F.collect_list(F.struct("__ny", (F.col("__v") / F.lit(f.extra["k"])).alias("s")))).alias("__shares"))
        if f.n_classes:
            agg = agg.withColumn("probability", F.array(*[F.coalesce(F.col("__shares")[F.lit(float(i))], F.lit(0.0)) for i in range(f.n_classes)]))
        agg = agg.drop("__shares")
    return df.join(agg, df[id_col] == agg["__qid"], "left").drop("__qid")


# --------------------------------------------------------------------------- AdaBoost
def _stump_candidates(train: DataFrame, features: list[str], bins: int = 32) -> dict:
    probs = [i / bins for i in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.col(f"`{c}`"), probs, 10000).alias(f"t{i}")
                      for i, c in enumerate(features)]).first()
    return {c: sorted(set(float(v) for v in (row[f"t{i}"] or []))) for i, c in enumerate(features)}


def _stump_weights(stumps: list[tuple[int, int, float, float, float, float]], bins: np.ndarray, label: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights after the stumps (feature, cut, left, right, alpha, norm)."""
    for f, cut, left, right, alpha, norm in stumps:
        w = w * np.where(np.where(bins[:, f] <= cut, left, right) != label, math.exp(alpha) / norm, 1.0 / norm)
    return w


def best_stump(rows: DataFrame, n_cuts: list[int], k: int, stumps: list = ()) -> DataFrame:
    """(f, cut, err, total, left, right): the stump of least weighted error among all
    (feature, cut), ties to the first feature and the lowest cut. ``rows`` has the bins
    ``__bins`` of each row (a row goes left of a cut if its bin is at most the cut),
    ``label`` (0 to k - 1) and ``__w``, to be renewed by ``stumps``.

    Tasks sum weights by (feature, bin, class); a group a feature adds those up, and
    running sums over the bins give both sides of every cut. The sides' heaviest classes
    (ties to the smallest) decide the error."""
    def count(batches):
        cells = [np.zeros((n + 1, k)) for n in n_cuts]
        for batch in batches:
            label = batch["label"].to_numpy().astype(np.int64)
            bins = np.asarray(batch["__bins"].flatten().to_numpy(zero_copy_only=False)).reshape(len(label), -1)
            w = _stump_weights(stumps, bins, label, batch["__w"].to_numpy())
            for f, n in enumerate(n_cuts):
                cells[f] += np.bincount(bins[:, f] * k + label, w, (n + 1) * k).reshape(n + 1, k)
        yield pa.RecordBatch.from_pydict({"f": pa.array(range(len(n_cuts)), pa.int32()), "cells": pa.array([c.ravel() for c in cells], pa.list_(pa.float64()))})

    def search(key, table):
        f = key[0].as_py()
        cells = np.sum([c.values.to_numpy(zero_copy_only=False) for c in table["cells"].combine_chunks()], axis=0).reshape(-1, k)
        left, right = cells.cumsum(0)[:-1], cells[::-1].cumsum(0)[::-1][1:]
        heavy = [np.round(side, 12).argmax(1) for side in (left, right)]
        err = sum(side.sum(1) - side[np.arange(len(side)), h] for side, h in zip((left, right), heavy))
        cut = int(np.round(err, 12).argmin())
        return pa.table({"f": pa.array([f], pa.int32()), "cut": pa.array([cut], pa.int32()), "err": [float(err[cut])], "total": [float(cells.sum())],
                         "left": [float(heavy[0][cut])], "right": [float(heavy[1][cut])]})

    summed = rows.select("__bins", "label", "__w").mapInArrow(count, "f int, cells array<double>").where(F.lit(n_cuts)[F.col("f")] > 0)
    found = summed.groupBy("f").applyInArrow(search, "f int, cut int, err double, total double, left double, right double")
    return found.orderBy(F.round("err", 12), "f").limit(1)


def _renewed(rows: DataFrame, stumps: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            label = batch["label"].to_numpy()
            bins = np.asarray(batch["__bins"].flatten().to_numpy(zero_copy_only=False)).reshape(len(label), -1)
            yield pa.RecordBatch.from_arrays([batch["__bins"], batch["label"], pa.array(_stump_weights(stumps, bins, label, batch["__w"].to_numpy()))], names=["__bins", "label", "__w"])

    return rows.select("__bins", "label", "__w").mapInArrow(run, "__bins array<int>, label double, __w double")


def fit_adaboost_classifier(train, features, n_classes, rounds=rules.N_TREES,
                            checkpoint_every=10):
    """SAMME with weighted decision stumps (M16). Features are binned once; a round is
    one job whose best row reaches the driver. Weights are a column, renewed by the last
    stumps and written every ``checkpoint_every`` rounds."""
    scalars("AdaBoost Classifier", features)
    k = max(2, n_classes)
    cands = _stump_candidates(train, features)
    n = train.count()
    live = [c for c in features if cands[c]]

    def bin_of(c):
        return F.size(F.filter(F.lit(cands[c]), lambda t: t < F.col(f"`{c}`"))).alias(c)

    n_cuts = [len(cands[c]) for c in live]
    cur = train.select(F.array(*[bin_of(c) for c in live]).alias("__bins") if live else F.array().cast("array<int>").alias("__bins"),
                       F.col("label").cast("double").alias("label"))
    # rows that agree in all bins and in the label keep one weight
    cur = cur.groupBy("__bins", "label").agg((F.count("*") / F.lit(float(n))).alias("__w"))
    cur = old = write_stage(cur, "adaboost")
    stumps, fresh = [], []
    for m in range(rounds if live else 0):
        best = best_stump(cur, n_cuts, k, fresh).first()
        if best is None:
            break
        c, t = live[best["f"]], cands[live[best["f"]]][best["cut"]]
        err = max(best["err"] / best["total"], 1e-12) if best["total"] else 1.0
        if err >= 1 - 1.0 / k:
            if not stumps:
                stumps.append((c, t, best["left"], best["right"], 1.0))
            break
        alpha = math.log((1 - err) / err) + math.log(k - 1)
        stumps.append((c, t, best["left"], best["right"], alpha))
        if best["err"] <= 0:
            break
        # the sum of the new weights is known: (1 - err) + err * e^alpha of the total
        fresh.append((best["f"], best["cut"], best["left"], best["right"], alpha, (1 - err) + err * math.exp(alpha)))
        if (m + 1) % checkpoint_every == 0:
            cur, fresh = write_stage(_renewed(cur, fresh), "adaboost"), []
            drop_stage(old)
            old = cur
    drop_stage(old)
    imp = [0.0] * len(features)
    for c, _, _, _, a in stumps:
        imp[features.index(c)] += a
    s = sum(imp) or 1.0
    return Fitted("AdaBoost Classifier", "classification", features, k, None,
                  extra={"stumps": stumps, "k": k, "importance": [v / s for v in imp]},
                  transform_fn=adaboost_transform)


def adaboost_transform(f: Fitted, df: DataFrame) -> DataFrame:
    """Weighted vote over the stumps, held as an array whatever their number and that
    of the classes (SAMME read-out)."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in f.features])
    stumps = f.extra["stumps"]
    if not stumps:
        stumps = [(f.features[0], 0.0, 0.0, 0.0, 0.0)]
    each = F.arrays_zip(*[F.lit([float(v) for v in column]).alias(name) for name, column in
                          zip("ftlra", [[f.features.index(s[0]) for s in stumps], *[[s[i] for s in stumps] for i in (1, 2, 3, 4)]])])
    out = df.withColumn("__x", x)
    votes = F.transform(each, lambda s: F.struct(F.when(F.get(F.col("__x"), s.f.cast("int")) <= s.t, s.l).otherwise(s.r).alias("c"), s.a.alias("a")))
    out = out.withColumn("__votes", votes)
    score = F.transform(F.sequence(F.lit(0), F.lit(f.extra["k"] - 1)), lambda c: F.aggregate(F.filter("__votes", lambda v: v.c == c), F.lit(0.0), lambda acc, v: acc + v.a))
    out = out.withColumn("__scores", score)
    arr = F.col("__scores")
    best_i = F.array_position(arr, F.array_max(arr)) - 1
    e = F.transform(arr, lambda v: F.exp(v - F.array_max(arr)))
    tot = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], best_i.cast("double").alias("prediction"),
                      F.transform(e, lambda v: v / tot).alias("probability"))


def fit_adaboost_regressor(train, features, rounds=rules.N_TREES, checkpoint_every=10):
    """AdaBoost.R2 (linear loss) over weighted depth-3 regression trees."""
    from dsengine.plans.cleaning import materialize
    n = train.count()
    some = dealt(train, features)
    cur = assemble(some.select(*[F.col(f"`{c}`") for c in features],
                               F.col("label").cast("double").alias("label")), features)
    cur = materialize(cur, "adaboost_r2")  # dealt once, not in every round
    cur = cur.withColumn("__w", F.lit(1.0 / n))
    models, betas = [], []
    for m in range(rounds):
        est = DecisionTreeRegressor(maxDepth=3, weightCol="__w", seed=rules.SEED)
        model = est.fit(cur)
        pred = model.transform(cur).withColumn("__e", F.abs(F.col("prediction") - F.col("label")))
        r = pred.agg(F.max("__e").alias("most"), F.sum(F.col("__w") * F.col("__e")).alias("lost"), F.sum("__w").alias("all")).first()
        emax = r["most"] or 0.0
        if emax == 0:
            models.append(model)
            betas.append(1e-10)
            break
        loss = F.col("__e") / F.lit(emax)
        avg = r["lost"] / emax / r["all"]  # the mean of the loss, in the pass that finds emax
        if avg >= 0.5:
            if not models:
                models.append(model)
                betas.append(1.0)
            break
        beta = avg / (1 - avg)
        models.append(model)
        betas.append(beta)
        cur = pred.withColumn("__w", F.col("__w") * F.pow(F.lit(beta), 1 - loss)).drop("prediction", "__e")
        if (m + 1) % checkpoint_every == 0:
            cur = materialize(cur, "adaboost_r2")

    return Fitted("AdaBoost Regressor", "regression", features, 0, None,
                  extra={"models": models, "betas": betas}, transform_fn=adaboost_r2_transform)


def adaboost_r2_transform(f: Fitted, df: DataFrame) -> DataFrame:
    base = assemble(df, f.features, "__feat")
    cols = []
    for i, mdl in enumerate(f.extra["models"]):
        mdl = mdl.copy().setFeaturesCol("__feat").setPredictionCol(f"__p{i}")
        base = mdl.transform(base)
        cols.append(f"__p{i}")
    weights = [math.log(1.0 / b) for b in f.extra["betas"]]
    half = 0.5 * sum(weights)
    pairs = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(w).alias("w"))
                                    for c, w in zip(cols, weights)]))
    cum = F.aggregate(pairs, F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("med")),
                      lambda st, x: F.struct(
                          (st["acc"] + x["w"]).alias("acc"),
                          F.when(st["med"].isNull() & (st["acc"] + x["w"] >= F.lit(half)), x["p"])
                          .otherwise(st["med"]).alias("med")))
    return base.select(*[F.col(f"`{c}`") for c in df.columns], cum["med"].alias("prediction"))


# --------------------------------------------------------------------------- MLP regressor
def fit_mlp_regressor(train, features, max_iter=rules.MLP_MAX_ITER, bins=None):
    """Neural network with squared loss, early stop by held-out loss (M23). ``bins``
    is accepted from older callers and not used: the target is no longer binned."""
    scalars("Neural Network Regressor", features)
    return Fitted("Neural Network Regressor", "regression", features, 0, None, fit_network(train, features, 0, max_iter), net_transform)


#: How a stored model predicts, by the kind it is stored under.
TRANSFORMS = {"ml": _ml_transform, "svm": svm_transform, "svr": svr_transform, "knn": knn_transform, "stumps": adaboost_transform,
              "trees": adaboost_r2_transform, "net": net_transform}


# --------------------------------------------------------------------------- registry
def fit(name: str, task: str, train: DataFrame, features: list[str], n_classes: int = 0,
        **kw) -> Fitted:
    if name in ("K-Nearest Neighbors Classifier", "K-Nearest Neighbors Regressor"):
        f = fit_knn(train, features, task, **kw)
        f.n_classes = n_classes
        return f
    if task == "classification":
        fits = [fit_logistic, fit_forest_classifier, fit_gbt_classifier, fit_svm, fit_tree_classifier, None, fit_mlp_classifier, fit_adaboost_classifier]
        return dict(zip(CLASSIFIERS, fits))[name](train, features, n_classes, **kw)
    fits = [fit_linear, fit_forest_regressor, fit_gbt_regressor, fit_svr, fit_tree_regressor, None, fit_mlp_regressor, fit_adaboost_regressor]
    return dict(zip(REGRESSORS, fits))[name](train, features, **kw)
