"""Balanced forests, their cross-validation over groups, and scoring of stored forests.

Trees are grown in tasks of one fold and a batch of trees each, over a capped
training table whose size is checked before it is broadcast.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a training table; the cap per group keeps it below, else fitting is refused.
MAX_TRAIN = 200_000


@dataclass(frozen=True)
class ForestParams:
    trees: int = 500
    mtry: int | None = None
    node_size: int = 25
    max_per_group: int = 25
    seed: int = 42
    batch: int = 25


def grow(x: np.ndarray, y: np.ndarray, k: int, rng: np.random.Generator, mtry: int, node_size: int) -> dict:
    """One tree by Gini impurity, as arrays of its nodes."""
    nodes = {"left": [], "right": [], "feature": [], "threshold": [], "probs": [], "size": []}

    def add(rows: np.ndarray) -> int:
        at = len(nodes["left"])
        share = np.bincount(y[rows], minlength=k) / len(rows)
        for name, v in (("left", -1), ("right", -1), ("feature", -1), ("threshold", 0.0), ("probs", share), ("size", len(rows))):
            nodes[name].append(v)
        return at

    stack = [(add(rows := np.arange(len(y))), rows)]
    while stack:
        at, rows = stack.pop()
        if len(rows) < 2 * node_size or nodes["probs"][at].max() == 1.0:
            continue
        best = (1e-12, -1, 0.0)
        total = np.bincount(y[rows], minlength=k).astype(float)
        for f in rng.choice(x.shape[1], mtry, replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows, f][order]
            left = np.cumsum(np.eye(k)[y[rows][order]], 0)[:-1]
            n = np.arange(1, len(rows), dtype=float)
            right = total - left
            purity = (left**2).sum(1) / n + (right**2).sum(1) / (len(rows) - n)
            ok = (v[1:] > v[:-1]) & (n >= node_size) & (len(rows) - n >= node_size)
            if ok.any():
                i = int(np.where(ok, purity, -1).argmax())
                gain = purity[i] - (total**2).sum() / len(rows)
                if gain > best[0]:
                    best = (gain, int(f), np.float32((v[i] + v[i + 1]) / 2))
        if best[1] < 0:
            continue
        go = x[rows, best[1]] <= best[2]
        if go.all() or not go.any():
            continue
        a, b = add(rows[go]), add(rows[~go])
        nodes["feature"][at], nodes["threshold"][at], nodes["left"][at], nodes["right"][at] = best[1], best[2], a, b
        stack += [(a, rows[go]), (b, rows[~go])]
    return {n: np.array(v) for n, v in nodes.items()}


def balanced_rows(y: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """As many rows of each class as the smallest has, drawn with replacement."""
    n = np.bincount(y, minlength=k)
    n = int(n[n > 0].min())
    return np.concatenate([rng.choice(np.flatnonzero(y == c), n) for c in range(k) if (y == c).any()])


def score(forest: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean leaf probabilities; features are 32-bit before they are compared, equal goes left."""
    x = x.astype(np.float32)
    out = 0.0
    for t in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := t["feature"][at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(t["feature"][at], 0)] <= t["threshold"][at].astype(np.float32)
            at = np.where(inner, np.where(go, t["left"][at], t["right"][at]), at)
        out = out + t["probs"][at]
    return out / max(len(forest), 1)


def compiled(forest: list[dict], at_once: int = 32) -> list[tuple[dict, list]]:
    """The forest as masks of leaves, for ``score_compiled``: of some trees at a time their features' thresholds, and each tree.

    A tree is (feature, masks) of its features and the leaves' probabilities: for each number of thresholds
    below a value, one bit for each leaf that the value leaves possible.
    """
    out = []
    for low in range(0, len(forest), at_once):
        some = forest[low : low + at_once]
        cut = [t["threshold"].astype(np.float32) for t in some]
        used = np.unique(np.concatenate([t["feature"] for t in some]))
        steps = {int(f): np.unique(np.concatenate([c[t["feature"] == f] for t, c in zip(some, cut, strict=True)])) for f in used if f >= 0}
        out.append((steps, [_masks(t, c, steps) for t, c in zip(some, cut, strict=True)]))
    return out


def _masks(t: dict, cut: np.ndarray, steps: dict) -> tuple[list, np.ndarray]:
    left, right, feature = t["left"].tolist(), t["right"].tolist(), t["feature"].tolist()
    inner = [i for i, f in enumerate(feature) if f >= 0]
    leaves, first = [1] * len(feature), [0] * len(feature)
    for i in reversed(inner):  # a node comes before those below it
        leaves[i] = leaves[left[i]] + leaves[right[i]]
    for i in inner:
        first[left[i]], first[right[i]] = first[i], first[i] + leaves[left[i]]
    seat = np.arange(-(-leaves[0] // 64) * 64)
    masks = []
    for f in sorted({feature[i] for i in inner}):
        own = sorted((i for i in inner if feature[i] == f), key=lambda i: cut[i])
        gone = np.array([[first[left[i]], first[left[i]] + leaves[left[i]]] for i in own])
        keep = (seat < gone[:, :1]) | (seat >= gone[:, 1:])
        keep = np.logical_and.accumulate(np.concatenate([np.ones((1, len(seat)), bool), keep]))
        packed = np.packbits(keep, axis=1, bitorder="little").view("<u8")
        below = np.concatenate([[0], np.searchsorted(cut[own], steps[f], "right")])
        masks.append((f, packed[below].T.copy()))
    ends = np.array([i for i, f in enumerate(feature) if f < 0])
    return masks, t["probs"][ends[np.argsort(np.array(first)[ends])]]


def score_compiled(forest: list[tuple[dict, list]], x: np.ndarray) -> np.ndarray:
    """What ``score`` gives for the forest that was compiled, bit for bit."""
    x = x.astype(np.float32)
    out, n = 0.0, 0
    for steps, trees in forest:
        below = {f: np.searchsorted(v, x[:, f]) for f, v in steps.items()}
        for masks, probs in trees:
            leaf, there = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            for w in range(len(masks[0][1]) if masks else 0):
                v = masks[0][1][w].take(below[masks[0][0]])
                for f, m in masks[1:]:
                    v &= m[w].take(below[f])
                at = np.bitwise_count((v & (~v + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                leaf = at if w == 0 else np.where(there, leaf, at + 64 * w)
                there |= v != 0
            out, n = out + probs.take(leaf, axis=0), n + 1
    return out / max(n, 1)


def importance(forest: list[dict], features: int) -> np.ndarray:
    """Share of the Gini impurity that each feature's splits take away, the mean of the trees' shares."""
    out = np.zeros(features)
    for t in forest:
        impure = t["size"] * (1 - (t["probs"] ** 2).sum(1))
        at = np.flatnonzero(t["feature"] >= 0)
        gone = np.bincount(t["feature"][at], impure[at] - impure[t["left"][at]] - impure[t["right"][at]], features)
        out += gone / max(gone.sum(), 1e-300)
    return out / out.sum() if out.sum() > 0 else np.full(features, 1 / max(features, 1))


def fit_folds(train: DataFrame, features: list[str], label: str, fold: str, folds: list, params: ForestParams) -> dict:
    """{fold: (classes, medians, trees)}: each fold's forest is grown on the other folds' rows; None is all rows."""
    if (n := train.limit(MAX_TRAIN + 1).count()) > MAX_TRAIN:
        raise ValueError(f"{n} training rows; lower max_per_group")
    data = train.select(fold, label, *features).toPandas()
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(data)
    classes = sorted(data[label].unique())

    def run(batches):
        for b in batches:
            for f, batch in zip(b["fold"], b["batch"], strict=True):
                d = shared.value
                rows = d if f < 0 else d[d[fold] != folds[f]]
                if rows[label].nunique() < len(classes):
                    continue  # a class is absent from the rest
                x = rows[features].to_numpy(np.float32)
                y = np.searchsorted(classes, rows[label].to_numpy())
                mid = np.nanmedian(x, 0)
                x = np.where(np.isnan(x), mid, x)
                mtry = params.mtry or max(1, int(np.sqrt(len(features))))
                trees = []
                for k in range(batch * params.batch, min((batch + 1) * params.batch, params.trees)):
                    rng = np.random.default_rng([params.seed, k])
                    pick = balanced_rows(y, len(classes), rng)
                    trees.append(grow(x[pick], y[pick], len(classes), rng, mtry, params.node_size))
                yield pd.DataFrame({"fold": [f], "model": [pickle.dumps((mid, trees))]})

    tasks = [(f, b) for f in (range(len(folds)) if folds else [-1]) for b in range(-(-params.trees // params.batch))]
    got = spark.createDataFrame(tasks, "fold int, batch int").repartition(len(tasks), "fold", "batch").mapInPandas(run, "fold int, model binary").collect()
    out: dict = {}
    for r in got:
        mid, trees = pickle.loads(r["model"])
        out.setdefault(folds[r["fold"]] if r["fold"] >= 0 else None, (classes, mid, []))[2].extend(trees)
    return out


def predict(df: DataFrame, models: dict, features: list[str], fold: str | None = None) -> DataFrame:
    """df with probs (in the order of classes) and predicted, each row by the forest of its fold."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    made: dict = {}

    @F.arrow_udf("struct<probs:array<double>,predicted:string>")
    def of(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[: len(features)]], 1).astype(np.float32)
        key = columns[-1].to_pandas() if fold else pd.Series([None] * len(x))
        kind = pa.list_(pa.float64()), pa.string()
        probs, names, rows, rest = [pa.array([], kind[0])], [pa.array([], kind[1])], [], np.ones(len(x), bool)
        for f in key.drop_duplicates():
            if f in shared.value:
                classes, mid, trees = shared.value[f]
                if f not in made:
                    made[f] = compiled(trees)
                at = np.flatnonzero(key == f) if fold else np.arange(len(x))
                p = score_compiled(made[f], np.where(np.isnan(x[at]), mid, x[at]))
                probs.append(pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel())))
                names.append(pa.array([str(c) for c in classes]).take(pa.array(p.argmax(1))))
                rows.append(at)
                rest[at] = False
        rows.append(np.flatnonzero(rest))
        order = pa.array(np.argsort(np.concatenate(rows)))
        whole = [pa.concat_arrays([*v, pa.nulls(len(rows[-1]), k)]).take(order) for v, k in zip((probs, names), kind, strict=True)]
        return pa.StructArray.from_arrays(whole, ["probs", "predicted"])

    columns = [F.col(c).cast("double").alias(c) for c in features] + ([F.col(fold).alias("fold")] if fold else [])
    return df.withColumn("_f", of(*columns)).select("*", "_f.probs", "_f.predicted").drop("_f")
