"""Clusters on features weighted by how well they tell known labels apart, and their strict test: clustering anew without each unit."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .clusters import MAX_UNITS, average_linkage, over_pool


@dataclass(frozen=True)
class HybridParams:
    """cut: cosine distance of average linkage; least: size of a cluster; outlier: quantile of the check by blocks."""

    cut: float = 0.7
    least: int = 15
    outlier: float = 0.95
    trees: int = 300
    node_size: int = 2
    seed: int = 42


@dataclass
class Frozen:
    """A clustering that new vectors can be assigned to."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    centres: np.ndarray
    members: list[np.ndarray]
    edges: list[float]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Nearest centre by weighted cosine; -1 beyond the cut, or farther from all members than the cluster's edge."""
        if not len(self.centres):
            return np.full(len(x), -1)
        z = self.standard(x)
        far = 1 - _unit(z * self.weights) @ self.centres.T
        best = far.argmin(1)
        out = np.where(far[np.arange(len(x)), best] <= self.cut, best, -1)
        for c in np.unique(out[out >= 0]):
            at = np.flatnonzero(out == c)
            if np.isfinite(self.edges[c]):
                near = np.array([np.sqrt(((self.members[c] - z[i]) ** 2).sum(1)).min() for i in at])
                out[at[near > self.edges[c]]] = -1
        return out


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def _forest(x: np.ndarray, y: np.ndarray, k: int, trees: int, node_size: int, seed: int) -> list[dict]:
    out, mtry = [], max(1, int(np.sqrt(x.shape[1])))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        pick = models.balanced_rows(y, k, rng)
        out.append(models.grow(x[pick], y[pick], k, rng, mtry, node_size))
    return out


def label_weights(x: np.ndarray, labels: np.ndarray, p: HybridParams) -> np.ndarray:
    """Square roots of a balanced forest's importances over their mean; ones without two known labels (null is unknown)."""
    known = ~pd.isna(labels)
    names, y = np.unique(labels[known].astype(str), return_inverse=True)
    if len(names) < 2:
        return np.ones(x.shape[1])
    share = models.importance(_forest(x[known].astype(np.float32), y, len(names), p.trees, p.node_size, p.seed), x.shape[1])
    return np.sqrt(share / share.mean())


def cluster(x: np.ndarray, labels: np.ndarray, blocks: np.ndarray, p: HybridParams) -> tuple[np.ndarray, Frozen]:
    """(cluster of each row, the frozen clustering): 0 is the largest, -1 none.

    A member goes if its nearest member in another block is farther than the
    cluster's quantile; clusters with under five such distances stay whole.
    """
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = (x - mean) / scale
    w = label_weights(z, labels, p)
    u = _unit(z * w)
    found = average_linkage(np.maximum(1 - u @ u.T, 0), p.cut)
    size = np.bincount(found)
    rank = np.full(len(size), -1)
    order = sorted(np.flatnonzero(size >= p.least), key=lambda c: (-size[c], c))
    rank[order] = np.arange(len(order))
    out, edges = rank[found], []
    for c in range(len(order)):
        at = np.flatnonzero(out == c)
        near = np.full(len(at), np.inf)
        for i, row in enumerate(at):
            other = at[blocks[at] != blocks[row]]
            if len(other):
                near[i] = np.sqrt(((z[other] - z[row]) ** 2).sum(1)).min()
        known = np.isfinite(near)
        edge = float(np.quantile(near[known], p.outlier)) if known.sum() >= 5 else float("inf")
        out[at[known & (near > edge)]] = -1
        edges.append(edge)
    held = [np.flatnonzero(out == c) for c in range(len(order))]
    centres = np.array([u[at].mean(0) for at in held]) if held else np.empty((0, x.shape[1]))
    return out, Frozen(mean, scale, w, p.cut, centres, [z[at] for at in held], edges)


def _pool(df: DataFrame, *columns) -> pd.DataFrame:
    got = df.select(*columns).limit(MAX_UNITS + 1).toPandas()
    if len(got) > MAX_UNITS:
        raise ValueError(f"over {MAX_UNITS} units: sample before clustering")
    return got


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


@dataclass
class _Assigned:
    vector: str
    frozen: Frozen

    def assign(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cluster": self.frozen.assign(_matrix(rows[self.vector]))})


def hybrid_clusters(df: DataFrame, key: str, vector: str, label: str, block: str, p: HybridParams | None = None) -> DataFrame:
    """(key, cluster) of a pool, and of rows beyond it by the pool's frozen clustering; null labels have no say in the weights."""
    p = p or HybridParams()

    def fit(d: pd.DataFrame):
        out, frozen = cluster(_matrix(d[vector]), d[label].to_numpy(object), d[block].to_numpy(), p)
        return pd.DataFrame({"cluster": out}), _Assigned(vector, frozen)

    return over_pool(df, key, [vector, label, block], fit, "cluster int")


def freeze(df: DataFrame, key: str, vector: str, label: str, block: str, p: HybridParams | None = None) -> Frozen:
    """The frozen clustering of a pool of at most MAX_UNITS units, made in one task; only it comes to the driver."""
    p = p or HybridParams()

    def run(batches):
        got = [b for b in batches if len(b)]
        if not got:
            return
        d = pd.concat(got).sort_values(key).reset_index(drop=True)
        if len(d) > MAX_UNITS:
            raise ValueError(f"over {MAX_UNITS} units: sample before clustering")
        yield pd.DataFrame({"f": [pickle.dumps(cluster(_matrix(d[vector]), d[label].to_numpy(object), d[block].to_numpy(), p)[1])]})

    got = df.select(key, vector, label, block).limit(MAX_UNITS + 1).repartition(1).mapInPandas(run, "f binary").collect()
    if not got:
        raise ValueError("no units")
    return pickle.loads(got[0]["f"])


def assign_frozen(df: DataFrame, vector: str, frozen: Frozen) -> DataFrame:
    """df with the cluster of each vector, any number of rows: the clustering is broadcast, rows are not shuffled; a null vector has -1."""
    shared = df.sparkSession.sparkContext.broadcast(frozen)

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        out, some = np.full(len(x), -1), x.notna().to_numpy()
        if some.any():
            out[some] = shared.value.assign(_matrix(x[some]))
        return pd.Series(out)

    return df.withColumn("cluster", of(vector))


def self_check(df: DataFrame, key: str, vector: str, clusters: DataFrame, frozen: Frozen) -> DataFrame:
    """(n, n_same, share): how many rows of a clustering the frozen one assigns as it did, unassigned ones included."""
    again = assign_frozen(df.select(key, vector), vector, frozen).select(key, F.col("cluster").alias("_again"))
    same = F.count_if(F.col("cluster") == F.col("_again"))
    return clusters.join(again, key).agg(F.count("*").alias("n"), same.alias("n_same"), F.try_divide(same, F.count("*")).alias("share"))


def frozen_tables(spark: SparkSession, frozen: Frozen) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) for save_library(): a row for each centre and each member."""
    edges = [None if np.isinf(e) else e for e in frozen.edges]
    centres = [(c, len(frozen.members[c]), frozen.centres[c].tolist(), edges[c]) for c in range(len(frozen.centres))]
    members = [(c, row.tolist()) for c, m in enumerate(frozen.members) for row in m]
    tables = {
        "centres": spark.createDataFrame(centres, "cluster int, n int, centre array<double>, edge double"),
        "members": spark.createDataFrame(members, "cluster int, vector array<double>"),
    }
    return tables, {"mean": frozen.mean, "scale": frozen.scale, "weights": frozen.weights, "cut": frozen.cut}


def frozen_from(tables: dict[str, DataFrame], manifest: dict) -> Frozen:
    """What frozen_tables() wrote; refused over MAX_UNITS members."""
    m = _pool(tables["members"], "cluster", "vector")
    rows = tables["centres"].orderBy("cluster").collect()
    width = len(manifest["mean"])
    members = [_matrix(m["vector"][m["cluster"] == r["cluster"]]) if (m["cluster"] == r["cluster"]).any() else np.empty((0, width)) for r in rows]
    centres = np.array([r["centre"] for r in rows], float).reshape(len(rows), width)
    edges = [float("inf") if r["edge"] is None else r["edge"] for r in rows]
    return Frozen(*(np.array(manifest[k], float) for k in ("mean", "scale", "weights")), manifest["cut"], centres, members, edges)


#: Units whose frozen clusterings are broadcast together.
UNITS_AT_ONCE = 8


def _shares(d: pd.DataFrame, clusters: dict, classes: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Of counts n: blocks, their cluster shares by detector (the last of each is unassigned) and the most frequent truth, the least of equals."""
    keys = d[["unit", "block"]].drop_duplicates().sort_values(["unit", "block"]).reset_index(drop=True)
    row = keys.reset_index().merge(d, on=["unit", "block"], how="right")["index"].to_numpy()
    parts = []
    for name, k in clusters.items():
        m = np.zeros((len(keys), k + 1))
        own = (d["detector"] == name).to_numpy()
        np.add.at(m, (row[own], np.where(d["cluster"][own] < 0, k, d["cluster"][own])), d["n"][own])
        parts.append(m / np.maximum(m.sum(1, keepdims=True), 1))
    truth = np.zeros((len(keys), len(classes)))
    np.add.at(truth, (row, np.searchsorted(classes, d["label"].astype(str))), d["n"])
    return keys, np.hstack(parts), truth.argmax(1)


def leave_out_reclustered(
    df: DataFrame, detector: str, unit: str, block: str, vector: str, label: str, p: HybridParams | None = None, trees: int = 300, node_size: int = 2
) -> DataFrame:
    """(unit, block, truth, predicted, probs): each unit's labelled blocks by a forest that never saw the unit.

    A task for each unit: every detector's pool is clustered without the unit,
    all labelled rows are assigned to those clusters, and a forest over the
    other units' cluster shares scores the unit's blocks. ``probs`` follow the
    sorted classes. The pool, all rows of all detectors or MAX_UNITS of them by
    a hash, is broadcast; the assigned rows are not limited and travel as
    counts. A unit without which one class or none is left has no rows.
    """
    p = p or HybridParams()
    spark = df.sparkSession
    names = {detector: "detector", unit: "unit", block: "block", vector: "vector", label: "label"}
    rows = df.select(*(F.col(c).cast("string").alias(n) if n in ("detector", "unit", "label") else F.col(c).alias(n) for c, n in names.items()))
    labelled = rows.filter("label IS NOT NULL")
    pool = rows.orderBy(F.xxhash64(*names.values())).limit(MAX_UNITS).toPandas()
    pool = pool.iloc[np.lexsort((pool["block"], pool["unit"], pool["detector"]))].reset_index(drop=True)
    classes = sorted(r[0] for r in labelled.select("label").distinct().collect())
    units = sorted(r[0] for r in labelled.select("unit").distinct().collect())
    shared = spark.sparkContext.broadcast(pool)

    def fit(batches):
        for b in batches:
            for u in b["out"]:
                found = {}
                for name, part in shared.value.groupby("detector", sort=True):
                    rest = part[part["unit"] != u]
                    if rest["label"].notna().any():
                        found[name] = cluster(_matrix(rest["vector"]), rest["label"].to_numpy(object), (rest["unit"] + "@" + rest["block"].astype(str)).to_numpy(), p)[1]
                yield pd.DataFrame({"out": [u], "f": [pickle.dumps(found)]})

    def counted(frozen):
        def run(batches):
            for b in batches:
                for u, f in frozen.value.items():
                    for name, clustering in pickle.loads(f).items():
                        own = b[b["detector"] == name]
                        if len(own):
                            own = own.drop(columns="vector").assign(out=u, k=len(clustering.centres), cluster=clustering.assign(_matrix(own["vector"])))
                            yield own.groupby(keys).size().rename("n").reset_index()[[*keys, "n"]]

        return run

    def one(d: pd.DataFrame) -> pd.DataFrame:
        u = d["out"].iloc[0]
        clusters = dict(sorted(zip(d["detector"], d["k"], strict=True)))
        blocks, x, truth = _shares(d, clusters, classes)
        test = (blocks["unit"] == u).to_numpy()
        seen = np.unique(truth[~test])
        if not test.any() or len(seen) < 2:
            return pd.DataFrame({"unit": [], "block": [], "truth": [], "predicted": [], "probs": []})
        forest = _forest(x[~test].astype(np.float32), truth[~test], len(classes), trees, node_size, p.seed)
        probs = models.score(forest, x[test])
        return pd.DataFrame({
            "unit": u, "block": blocks["block"][test].to_numpy(), "truth": [classes[k] for k in truth[test]],
            "predicted": [classes[k] for k in probs.argmax(1)], "probs": probs.tolist(),
        })

    kind = df.schema[block].dataType.simpleString()
    keys = ["out", "detector", "k", "unit", "block", "label", "cluster"]
    counts = spark.createDataFrame([], f"out string, detector string, k int, unit string, block {kind}, label string, cluster int, n long")
    for at in range(0, len(units), UNITS_AT_ONCE):
        some = units[at : at + UNITS_AT_ONCE]
        tasks = spark.createDataFrame([(u,) for u in some], "out string").repartition(len(some), "out")
        frozen = spark.sparkContext.broadcast({r["out"]: bytes(r["f"]) for r in tasks.mapInPandas(fit, "out string, f binary").collect()})
        counts = counts.unionByName(labelled.select("detector", "unit", "block", "vector", "label").mapInPandas(counted(frozen), counts.schema))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    return total.groupBy("out").applyInPandas(one, f"unit string, block {kind}, truth string, predicted string, probs array<double>")
