"""Neural networks trained data-parallel.

Two hidden layers of rectified units; softmax and cross-entropy for classes, identity
and squared loss for a number (the target is standardised inside). Rows are written
once, dealt by hash into shards. In a round every task starts from the shared weights
and moments, runs Adam over mini-batches of its rows, and answers with its state; the
states are averaged by rows, in two levels, so the driver gets at most ``FAN`` of them.
With one shard this is plain mini-batch Adam.

A tenth of the rows, by hash, is held out: each round also measures the loss of the
weights it starts from on them. Training stops when that loss has not improved for
``PATIENCE`` rounds, or after the epochs allowed; the best weights are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dsengine import rules
from dsengine.functions.exprs import std_pop_expr
from dsengine.functions.staging import drop_stage, write_stage

#: Rows of a shard, about; mini-batch; mini-batches that a round runs at least.
SHARD, BATCH, STEPS = 1 << 14, 200, 100
RATE, PENALTY, TOLERANCE, PATIENCE, FAN = 1e-3, 1e-4, 1e-4, 3, 32
STATE = "rows long, held long, loss double, state array<double>"


class Net:
    """Weights of all layers in one vector; forward and backward passes."""

    def __init__(self, layers: list[int], classes: bool):
        self.layers, self.classes = layers, classes
        self.shapes = [(a, b) for a, b in zip(layers, layers[1:])]
        self.size = sum(a * b + b for a, b in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        r, out = np.random.Generator(np.random.PCG64(seed)), []
        for a, b in self.shapes:
            reach = math.sqrt(6.0 / (a + b))
            out.append(r.uniform(-reach, reach, a * b + b))
        return np.concatenate(out)

    def _parts(self, w: np.ndarray):
        at = 0
        for a, b in self.shapes:
            yield w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]
            at += a * b + b

    def forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (m, b) in enumerate(self._parts(w)):
            z = out[-1] @ m + b
            out.append(np.maximum(z, 0.0) if i + 1 < len(self.shapes) else z)
        if self.classes:
            e = np.exp(out[-1] - out[-1].max(1, keepdims=True))
            out[-1] = e / e.sum(1, keepdims=True)
        return out

    def loss(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        """Sum over the rows, without the penalty."""
        out = self.forward(w, x)[-1]
        if self.classes:
            return float(-np.log(np.maximum(out[np.arange(len(y)), y.astype(np.int64)], 1e-15)).sum())
        return float(((out[:, 0] - y) ** 2).sum() / 2)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the mean loss with the penalty."""
        acts, n = self.forward(w, x), len(x)
        delta = acts[-1].copy()
        if self.classes:
            delta[np.arange(n), y.astype(np.int64)] -= 1.0
        else:
            delta[:, 0] -= y
        delta /= n
        out = []
        for i, (m, _) in reversed(list(enumerate(self._parts(w)))):
            out.append(np.concatenate([(acts[i].T @ delta + PENALTY / n * m).ravel(), delta.sum(0)]))
            if i:
                delta = (delta @ m.T) * (acts[i] > 0)
        return np.concatenate(out[::-1])


class Adam:
    """Weights and their moments; the state of a round."""

    def __init__(self, w: np.ndarray, m: np.ndarray, v: np.ndarray, t: int):
        self.w, self.m, self.v, self.t = w.copy(), m.copy(), v.copy(), t

    def epoch(self, net: Net, x: np.ndarray, y: np.ndarray, r: np.random.Generator) -> None:
        order = r.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            some = order[lo:lo + BATCH]
            g = net.gradient(self.w, x[some], y[some])
            self.t += 1
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.999 * self.v + 0.001 * g * g
            self.w -= RATE * math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t) * self.m / (np.sqrt(self.v) + 1e-8)


def epochs_of(rows: int) -> int:
    """Epochs of a round: enough for ``STEPS`` mini-batches."""
    return max(1, math.ceil(STEPS * BATCH / max(rows, 1)))


def _round(net: Net, state: np.ndarray, t: int, epochs: int, seed: int, last: bool):
    """One round on the rows of a task: a single pass if they are many, else kept."""
    def run(batches):
        w, m, v = state.reshape(3, -1)
        adam, rows, held, loss, kept = Adam(w, m, v, t), 0, 0, 0.0, []
        r = np.random.Generator(np.random.PCG64(seed))
        for batch in batches:
            x = np.asarray(batch["x"].flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
            y, out = batch["y"].to_numpy(), batch["held"].to_numpy(zero_copy_only=False)
            if out.any():
                held, loss = held + int(out.sum()), loss + net.loss(w, x[out], y[out])
            x, y = x[~out], y[~out]
            rows += len(x)
            if last or not len(x):
                continue
            if epochs == 1:
                adam.epoch(net, x, y, r)
            else:
                kept.append((x, y))
        if kept:
            x, y = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            for _ in range(epochs):
                adam.epoch(net, x, y, r)
        if rows or held:
            total = np.concatenate([adam.w, adam.m, adam.v]) * rows
            yield pa.RecordBatch.from_pylist([{"rows": rows, "held": held, "loss": loss, "state": total}],
                                             pa.schema([("rows", pa.int64()), ("held", pa.int64()), ("loss", pa.float64()), ("state", pa.list_(pa.float64()))]))

    return run


def _add(key, table):
    total = np.sum([s.values.to_numpy(zero_copy_only=False) for s in table["state"].combine_chunks()], axis=0)
    return pa.table({"rows": [sum(table["rows"].to_pylist())], "held": [sum(table["held"].to_pylist())], "loss": [sum(table["loss"].to_pylist())],
                     "state": pa.array([total], pa.list_(pa.float64()))})


def fit_network(train: DataFrame, features: list[str], n_classes: int = 0, max_epochs: int = rules.MLP_MAX_ITER,
                hidden: list[int] | None = None, seed: int = rules.SEED, shard: int = SHARD) -> dict:
    """Layers, weights, centre and scale of the target, and the held-out losses."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    src = train.select(x.alias("x"), F.col("label").cast("double").alias("y"))
    row = src.agg(F.count("*").alias("n"), F.avg("y").alias("m"), std_pop_expr(F.col("y")).alias("s")).first()
    n, centre, scale = row["n"], 0.0, 1.0
    if not n:
        raise ValueError("no rows to train on")
    if not n_classes:
        centre, scale = row["m"], row["s"] or 1.0
    src = src.withColumn("y", (F.col("y") - F.lit(centre)) / F.lit(scale)).withColumn("h", F.xxhash64("x", "y"))
    parts = max(1, math.ceil(n / shard))
    dealt = src.withColumn("held", F.pmod(F.xxhash64("h"), F.lit(10)) == 0).repartition(parts, "h").sortWithinPartitions("h", "x", "y")
    stage = write_stage(dealt.select("x", "y", "held"), "network")
    net = Net([len(features), *(hidden or rules.MLP_HIDDEN), max(2, n_classes) if n_classes else 1], bool(n_classes))
    w = net.start(seed)
    state, best, least, wait, losses, done, t = np.concatenate([w, 0 * w, 0 * w]), w, math.inf, 0, [], 0, 0
    epochs = epochs_of(min(n, shard))
    while True:
        last = done >= max_epochs
        out = stage.mapInArrow(_round(net, state, t, epochs, seed + done, last), STATE)
        if parts > 1:
            out = out.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("fan")).applyInArrow(_add, STATE)
        answers = out.collect()
        rows, held = sum(a["rows"] for a in answers), sum(a["held"] for a in answers)
        now = np.sum([np.array(a["state"]) for a in answers], axis=0) / max(rows, 1)
        loss = sum(a["loss"] for a in answers) / held if held else math.nan
        losses.append(loss)
        wait = wait + 1 if held and not loss < least - TOLERANCE else 0
        if not held or loss < least:
            least, best = loss, state[:net.size]
        if last or wait >= PATIENCE or not rows:
            break
        state, done = now, done + epochs
        t += epochs * math.ceil(min(rows, shard) / BATCH)
    drop_stage(stage)
    return {"layers": net.layers, "classes": bool(n_classes), "weights": [float(v) for v in best], "centre": centre, "scale": scale, "losses": losses}


def apply_network(extra: dict, features: list[str], df: DataFrame) -> DataFrame:
    """``df`` with ``__net``: class probabilities, or one value."""
    net, w = Net(extra["layers"], extra["classes"]), np.array(extra["weights"])
    centre, scale = extra["centre"], extra["scale"]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = net.forward(w, np.vstack(x.to_numpy()).astype(np.float64))[-1] if len(x) else np.zeros((0, net.layers[-1]))
        if not net.classes:
            out = out * scale + centre
        return pd.Series(list(out))

    return df.withColumn("__net", run(F.array(*[F.col(f"`{c}`").cast("double") for c in features])))
