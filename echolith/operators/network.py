"""Small convolutional networks on spectra, fitted on grouped bootstraps and validated over groups.

Resampling is relational and runs over all rows; what a fold trains on is
capped per group and balanced, so its size is known before one task takes it.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows that the bootstraps of one fold may have together, and most folds whose networks are broadcast.
MAX_TRAIN, MAX_FOLDS = 500_000, 2_000


@dataclass(frozen=True)
class NetworkParams:
    filters: int = 16
    kernel: int = 3
    pool: int = 2
    slope: float = 0.1
    dense: int = 10
    dropout: float = 0.3
    l2: float = 1e-4
    rate: float = 5e-4
    epochs: int = 20
    batch: int = 2
    patience: int = 20
    seed: int = 42


@dataclass(frozen=True)
class ResamplingParams:
    max_per_group: int = 30
    bootstraps: int = 5
    val_fraction: float = 0.33
    balance: bool = True


def _draw(key: str, *salt: Column) -> Column:
    """A place in a random order that any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), *[s.cast("string") for s in salt]))


def group_folds(df: DataFrame, label: str, group: str, folds: int) -> DataFrame:
    """(group, fold): the groups of each label dealt over the folds in turn, on from where the label before ended."""
    groups = df.groupBy(group).agg(F.min(label).alias("_l"))
    seat = groups.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy(_draw(group), group)))
    sizes = seat.groupBy("_l").agg(F.count("*").alias("_n"))  # a row a label
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_l", before.alias("_before"))
    return seat.join(offsets, "_l").select(group, ((F.col("_before") + F.col("_k") - 1) % folds).cast("int").alias("fold"))


def bootstraps(df: DataFrame, key: str, label: str, group: str, fold: str, folds: list[int], p: ResamplingParams) -> DataFrame:
    """Rows of each (held_out, bootstrap) with validation, the rows of the held-out fold being absent.

    Groups are capped; a class above the smallest loses rows of its largest
    groups first, which is to keep the rows of the lowest places in their
    groups. A fold whose rest lacks a class of the table is left out.
    """
    b = df.withColumn("bootstrap", F.explode(F.array(*(F.lit(k) for k in range(p.bootstraps)))))
    b = b.withColumn("_o", _draw(key, F.col("bootstrap")))
    b = b.withColumn("_place", F.row_number().over(Window.partitionBy("bootstrap", group).orderBy("_o", key))).filter(F.col("_place") <= p.max_per_group)
    b = b.withColumn("held_out", F.explode(F.filter(F.array(*(F.lit(f) for f in folds)), lambda f: f != F.col(fold))))
    n = b.groupBy("held_out", "bootstrap", label).agg(F.count("*").alias("_n"))
    classes = df.select(F.countDistinct(label).alias("_k"))
    whole = n.groupBy("held_out", "bootstrap").agg(F.min("_n").alias("_least"), F.count("*").alias("_c")).crossJoin(F.broadcast(classes)).filter("_c = _k").drop("_c", "_k")
    b = b.join(whole, ["held_out", "bootstrap"]).join(n, ["held_out", "bootstrap", label])
    cell = Window.partitionBy("held_out", "bootstrap", label)
    if p.balance:
        b = b.withColumn("_seat", F.row_number().over(cell.orderBy("_place", "_o", key))).filter("_seat <= _least").drop("_seat").withColumn("_n", F.col("_least"))
    turn = F.row_number().over(cell.orderBy(_draw(key, F.col("bootstrap"), F.lit("v")), key))
    return b.withColumn("validation", turn <= F.bround(F.col("_n") * p.val_fraction, 0)).drop("_o", "_place", "_n", "_least")


def _columns(x: np.ndarray, k: int) -> np.ndarray:
    left = (k - 1) // 2
    padded = np.pad(x, ((0, 0), (left, k - 1 - left), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(padded, k, 1).reshape(*x.shape[:2], -1)


def _spread(d: np.ndarray, k: int) -> np.ndarray:
    """Gradient of _columns."""
    left, n, c = (k - 1) // 2, d.shape[1], d.shape[2] // k
    out = np.zeros((d.shape[0], n + k - 1, c), d.dtype)
    d = d.reshape(*d.shape[:2], c, k)
    for i in range(k):
        out[:, i : i + n] += d[..., i]
    return out[:, left : left + n]


class Network:
    """Convolution, pooling, convolution, pooling, leaky units, a dense layer, class probabilities."""

    def __init__(self, inputs: int, classes: int, p: NetworkParams, seed: int):
        self.p, self.rng, self.step = p, np.random.default_rng(seed), 0
        flat = -(-(-(-inputs // p.pool)) // p.pool) * p.filters
        shapes = [(p.kernel, p.filters), (p.filters * (p.kernel + 2), p.filters), (flat, p.dense), (p.dense, classes)]
        fans = [(p.kernel, p.kernel * p.filters), (p.filters * (p.kernel + 2),) * 2, (flat, p.dense), (p.dense, classes)]
        self.w: list[np.ndarray] = []
        for shape, fan in zip(shapes, fans, strict=True):
            edge = np.sqrt(6 / sum(fan))
            self.w += [self.rng.uniform(-edge, edge, shape).astype(np.float32), np.zeros(shape[1], np.float32)]
        self.moments = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = self.p.pool
        short = -x.shape[1] % q
        blocks = np.pad(x, ((0, 0), (0, short), (0, 0)), constant_values=-np.inf).reshape(x.shape[0], -1, q, x.shape[2])
        return blocks.max(2), blocks.argmax(2)

    def _unpool(self, d: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((*d.shape[:2], self.p.pool, d.shape[2]), d.dtype)
        np.put_along_axis(out, at[:, :, None], d[:, :, None], 2)
        return out.reshape(d.shape[0], -1, d.shape[2])[:, :n]

    def _forward(self, x: np.ndarray, drop: bool) -> tuple:
        w, p = self.w, self.p
        c1 = _columns(x[..., None].astype(np.float32), p.kernel)
        p1, a1 = self._pool(c1 @ w[0] + w[1])
        c2 = _columns(p1, p.kernel + 2)
        p2, a2 = self._pool(c2 @ w[2] + w[3])
        h = np.where(p2 > 0, p2, p.slope * p2).reshape(len(x), -1)
        z = h @ w[4] + w[5]
        mask = (self.rng.random(z.shape) >= p.dropout) / np.float32(1 - p.dropout) if drop else np.float32(1)
        out = (z * mask) @ w[6] + w[7]
        e = np.exp(out - out.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), (c1, a1, c2, a2, p2, h, z * mask, mask)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, False)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, drop: bool = True) -> list[np.ndarray]:
        probs, (c1, a1, c2, a2, p2, h, z, mask) = self._forward(x, drop)
        w, p = self.w, self.p
        d = probs.astype(np.float32)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g6, g7 = z.T @ d, d.sum(0)
        d = (d @ w[6].T) * mask
        g4, g5 = h.T @ d + 2 * p.l2 * w[4], d.sum(0)
        d = (d @ w[4].T).reshape(p2.shape) * np.where(p2 > 0, 1, p.slope)
        d = self._unpool(d, a2, c2.shape[1])
        g2, g3 = np.einsum("bni,bnj->ij", c2, d), d.sum((0, 1))
        d = self._unpool(_spread(d @ w[2].T, p.kernel + 2), a1, c1.shape[1])
        return [np.einsum("bni,bnj->ij", c1, d), d.sum((0, 1)), g2, g3, g4, g5, g6, g7]

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(np.maximum(self.predict(x)[np.arange(len(y)), y], 1e-7)).mean() + self.p.l2 * (self.w[4] ** 2).sum())

    def _update(self, x: np.ndarray, y: np.ndarray) -> None:
        self.step += 1
        rate = self.p.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for w, g, m, v in zip(self.w, self.gradients(x, y), *self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray) -> list[tuple[float, float]]:
        """(training loss, validation loss) of each epoch; the weights of the best validation epoch stay."""
        best, kept, waited, history = np.inf, None, 0, []
        for _ in range(self.p.epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), self.p.batch):
                pick = order[at : at + self.p.batch]
                self._update(x[pick], y[pick])
            now = self.loss(vx, vy) if len(vx) else float("nan")
            history.append((self.loss(x, y), now))
            if now < best:
                best, kept, waited = now, [w.copy() for w in self.w], 0
            elif len(vx):
                waited += 1
                if waited >= self.p.patience:
                    break
        if kept is not None:
            self.w = kept
        return history


def cross_validate(frames: DataFrame, key: str, label: str, fold: str, samples: DataFrame, vector: str, p: NetworkParams) -> tuple[DataFrame, DataFrame]:
    """(frames with probs and predicted by the network of their held-out fold, training history).

    samples: what bootstraps() gives. Each fold's network goes on learning
    from bootstrap to bootstrap. Frames of a left-out fold get nulls.
    """
    sizes = samples.groupBy("held_out").count().collect()  # a row a fold
    if len(sizes) > MAX_FOLDS or any(r["count"] > MAX_TRAIN for r in sizes):
        raise ValueError(f"over {MAX_FOLDS} folds or over {MAX_TRAIN} rows of a fold: use fewer folds, a lower cap or fewer bootstraps")

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["bootstrap", key], kind="stable")
        names = sorted(d[label].unique())
        x = np.stack([np.asarray(v, np.float32) for v in d[vector]])
        y = np.searchsorted(names, d[label].to_numpy())
        f = int(d["held_out"].iloc[0])
        net, history = Network(x.shape[1], len(names), p, p.seed + f), []
        boot, val = d["bootstrap"].to_numpy(), d["validation"].to_numpy(bool)
        for b in np.unique(boot):
            t, v = (boot == b) & ~val, (boot == b) & val
            history += [(int(b), e, int(t.sum()), int(v.sum()), *h) for e, h in enumerate(net.train(x[t], y[t], x[v], y[v]))]
        return pd.DataFrame({"held_out": [f], "model": [pickle.dumps((names, net.w, history))]})

    keep = samples.select("held_out", "bootstrap", "validation", key, label, vector)
    models = {r["held_out"]: pickle.loads(r["model"]) for r in keep.groupBy("held_out").applyInPandas(fit, "held_out int, model binary").collect()}
    spark = frames.sparkSession
    shared = spark.sparkContext.broadcast({f: (names, w) for f, (names, w, _) in models.items()})

    @F.pandas_udf("probs array<double>, predicted string")
    def of(d: pd.DataFrame) -> pd.DataFrame:
        probs, names = [None] * len(d), [None] * len(d)
        for f in d["fold"].drop_duplicates():
            if f in shared.value:
                classes, w = shared.value[f]
                at = np.flatnonzero(d["fold"] == f)
                x = np.stack([np.asarray(v, np.float32) for v in d["x"].iloc[at]])
                net = Network(x.shape[1], len(classes), p, 0)
                net.w = w
                for i, row in zip(at, net.predict(x), strict=True):
                    probs[i], names[i] = row.tolist(), str(classes[int(row.argmax())])
        return pd.DataFrame({"probs": probs, "predicted": names})

    scored = frames.withColumn("_f", of(F.struct(F.col(fold).alias("fold"), F.col(vector).alias("x")))).select("*", "_f.probs", "_f.predicted").drop("_f")
    rows = [(f, *h) for f, (_, _, history) in sorted(models.items()) for h in history]
    return scored, spark.createDataFrame(rows, "held_out int, bootstrap int, epoch int, n_train int, n_val int, loss double, val_loss double")
