"""Clusters of units and the statistics that judge them against labels."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most units that are clustered at once, all pairs being held; any more are assigned to the clusters of such a pool.
MAX_UNITS = 8000


def over_pool(df: DataFrame, key: str, columns: list[str], fit, kinds: str) -> DataFrame:
    """(key, results of ``kinds``) of every row of df.

    ``fit(rows)`` sees one pool, all rows or MAX_UNITS of them by a hash of the
    key, sorted by key. It returns the pool's results, a table of the columns of
    ``kinds``, and an object whose ``assign(rows)`` gives those of any others.
    Both are broadcast; rows are not shuffled.
    """
    part = df.select(*dict.fromkeys([key, *columns]))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {kinds}"

    def run(batches):
        got = [b for b in batches if len(b)]
        if got:
            d = pd.concat(got).sort_values(key).reset_index(drop=True)
            yield pd.DataFrame({"b": [pickle.dumps((d[key].tolist(), *fit(d)))]})

    fitted = part.orderBy(F.xxhash64(key), key).limit(MAX_UNITS).repartition(1).mapInPandas(run, "b binary").collect()
    if not fitted:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(bytes(fitted[0]["b"]))

    def each(batches):
        keys, known, model = pickle.loads(shared.value)
        place = pd.Index(keys)
        for b in batches:
            if not len(b):
                continue
            b = b.reset_index(drop=True)
            at = place.get_indexer(b[key])
            old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            parts = [known.iloc[at[old]].set_index(old)]
            if len(new):
                parts.append(model.assign(b.iloc[new].reset_index(drop=True)).set_index(new))
            out = pd.concat(parts).sort_index()
            out.insert(0, key, b[key])
            yield out

    return part.mapInPandas(each, schema)


@dataclass
class Nearest:
    """The nearest centre by cosine of standard vectors, -1 beyond the cut."""

    vector: str
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    cut: float

    def assign(self, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(self.centres):
            return pd.DataFrame({"cluster": np.full(len(rows), -1)})
        x = (np.stack([np.asarray(v, float) for v in rows[self.vector]]) - self.mean) / self.scale
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        far = 1 - x @ self.centres.T
        best = far.argmin(1)
        return pd.DataFrame({"cluster": np.where(far[np.arange(len(x)), best] <= self.cut, best, -1)})


def beta_quantile(p: float, a: float, b: float) -> float:
    """Quantile of the Beta distribution by bisection on the continued fraction of its integral."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete(1 - x, b, a)
    return _incomplete(x, a, b)


def _incomplete(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d)
            c = 1 + term / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def binary_verdicts(df: DataFrame, cluster: str, unit: str, positive: str, cap: int = 50, prior: float = 10.0, ci: float = 0.9, min_units: int = 2) -> DataFrame:
    """Verdict of each cluster on a yes/no label: share as it is (raw) and shrunk, Beta interval against the base rate, support.

    Rows without cluster (-1) or label count nowhere; a cluster without labelled rows has the base rate and is uncertain.
    The base rate caps a unit's rows over its clusters together. Years are the first four characters of units, which are days then.
    """
    held = df.filter(F.col(cluster) >= 0)
    per = held.filter(F.col(positive).isNotNull()).groupBy(cluster, unit, positive).agg(F.count("*").alias("_n")).withColumn("_c", F.least("_n", F.lit(cap)))
    year = F.substring(F.col(unit).cast("string"), 1, 4)
    stats = per.groupBy(cluster).agg(
        F.sum(F.when(F.col(positive), F.col("_c")).otherwise(0)).alias("k"), F.sum("_c").alias("n"),
        F.countDistinct(F.when(F.col(positive), F.col(unit))).alias("units_yes"), F.countDistinct(F.when(~F.col(positive), F.col(unit))).alias("units_no"),
        F.countDistinct(F.when(F.col(positive), year)).alias("years_yes"), F.countDistinct(F.when(~F.col(positive), year)).alias("years_no"),
    )
    whole = per.groupBy(unit, positive).agg(F.least(F.sum("_n"), F.lit(cap)).alias("_c"))
    base = whole.agg(F.try_divide(F.sum(F.when(F.col(positive), F.col("_c")).otherwise(0)), F.sum("_c")).alias("base"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("k", "n", "units_yes", "units_no", "years_yes", "years_no")]
    stats = held.select(cluster).distinct().join(stats, cluster, "left").select(cluster, *counts).crossJoin(F.broadcast(base))  # one row

    @F.pandas_udf("low double, high double")
    def interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ends = [(beta_quantile((1 - ci) / 2, x, y), beta_quantile(1 - (1 - ci) / 2, x, y)) if x > 0 and y > 0 else (None, None) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(ends, columns=["low", "high"])

    a, b = F.col("k") + prior * F.col("base"), F.col("n") - F.col("k") + prior * (1 - F.col("base"))
    out = stats.withColumns({"raw": F.try_divide("k", "n"), "p": a / (a + b)}).withColumn("enrichment", F.try_divide("p", "base")).withColumn("_i", interval(a, b)).select("*", "_i.low", "_i.high").drop("_i")
    verdict = F.when((F.col("low") > F.col("base")) & (F.col("units_yes") >= min_units), "yes").when((F.col("high") < F.col("base")) & (F.col("units_no") >= min_units), "no")
    return out.withColumn("verdict", verdict.otherwise("uncertain"))


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels of average-linkage clusters cut at a distance, by chains of nearest neighbours."""
    d = distance.astype(float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, parent = np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        i = chain[-1]
        row = np.where(alive, d[i], np.inf)
        j = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[j]:
            j = chain[-2]
        if len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            if d[a, b] <= cut:  # above the cut the tree goes on, the labels do not
                parent[parent == b] = a
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = new, new
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(j)
    return np.unique(parent, return_inverse=True)[1]


def cluster_units(df: DataFrame, key: str, vector: str, cut: float = 0.7, least: int = 15) -> DataFrame:
    """(key, cluster): cosine average-linkage clusters of a pool, renumbered by size, small ones -1; rows beyond the pool go to the nearest centre."""

    def fit(d: pd.DataFrame):
        x = np.stack([np.asarray(v, float) for v in d[vector]])
        mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        x = (x - mean) / scale
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        label = average_linkage(np.maximum(1 - x @ x.T, 0), cut)
        size = np.bincount(label)
        rank = np.full(len(size), -1)
        for k, c in enumerate(sorted(np.flatnonzero(size >= least), key=lambda c: (-size[c], c))):
            rank[c] = k
        out = rank[label]
        centres = np.array([x[out == k].mean(0) for k in range(out.max() + 1)])
        return pd.DataFrame({"cluster": out}), Nearest(vector, mean, scale, centres, cut)

    return over_pool(df, key, [vector], fit, "cluster int")
