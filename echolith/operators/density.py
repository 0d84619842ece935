"""Principal components and density clusters of a bounded pool of units, and pruning of outlying rows of any table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.sources.durable import cut

from .clusters import over_pool
from .quantiles import MAX_GROUPS, exact_quantiles

#: Most features whose covariances are summed in one aggregate.
MAX_FEATURES = 60


def standard_matrix(x: np.ndarray) -> np.ndarray:
    """Missing values become medians, varying columns get mean 0 and deviation 1, constant ones go."""
    x = np.where(np.isfinite(x), x, np.nan)
    known = ~np.isnan(x).all(0)
    mid = np.zeros(x.shape[1])
    mid[known] = np.nanmedian(x[:, known], 0)
    x = np.where(np.isnan(x), mid, x)
    spread = x.std(0)
    return (x[:, spread > 0] - x.mean(0)[spread > 0]) / spread[spread > 0]


def components(x: np.ndarray, share: float) -> np.ndarray:
    """Scores of the fewest principal components that hold the share of the variance; the largest loading is positive."""
    x = x - x.mean(0)
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    held = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    return x @ axes[: int(np.searchsorted(held, share - 1e-12)) + 1].T


def spanning_tree(x: np.ndarray, samples: int) -> list[tuple[float, int, int]]:
    """Edges of the least spanning tree over mutual reachability distances, shortest first; distances are made row by row."""
    n = len(x)
    row = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    core = np.array([np.partition(row(i), samples - 1)[samples - 1] for i in range(n)])
    near, source, out = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        out[at] = True
        reach = np.maximum(np.maximum(row(at), core), core[at])
        better = ~out & (reach < near)
        near[better], source[better] = reach[better], at
        at = int(np.where(out, np.inf, near).argmin())
        edges.append((float(near[at]), int(source[at]), at))
    return sorted(edges)


def density_labels(x: np.ndarray, least: int, samples: int | None = None, leaf: bool = True) -> np.ndarray:
    """Clusters by hierarchical density, 0 the largest, -1 none; leaves of the condensed tree or the most stable set."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    # nodes of the dendrogram: 0..n-1 are units, n.. are merges
    root, kids, height, size = list(range(2 * n - 1)), {}, {}, [1] * n + [0] * (n - 1)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (w, a, b) in enumerate(spanning_tree(x, min(samples or least, n))):
        a, b, m = top(a), top(b), n + k
        root[a] = root[b] = m
        kids[m], height[m], size[m] = (a, b), w, size[a] + size[b]
    # condensed clusters: (dendrogram node, parent, stability)
    tops, parents, stable = [2 * n - 2], [-1], []
    births = [0.0]
    i = 0
    while i < len(tops):
        node, gained = tops[i], 0.0
        while node >= n:
            density = 1 / max(height[node], 1e-12)
            big = [c for c in kids[node] if size[c] >= least]
            left = size[node] - (size[big[0]] if len(big) == 1 else 0)
            gained += (density - births[i]) * left
            if len(big) == 2:
                tops += big
                parents += [i, i]
                births += [density, density]
            if len(big) != 1:
                break
            node = big[0]
        stable.append(gained)
        i += 1
    children: dict[int, list[int]] = {}
    for c, p in enumerate(parents):
        children.setdefault(p, []).append(c)
    chosen: list[int] = []
    if leaf:
        chosen = [c for c in range(1, len(tops)) if c not in children]
    else:
        take, best = set(), list(stable)
        for c in range(len(tops) - 1, 0, -1):  # children come after their parents
            below = sum(best[k] for k in children.get(c, []))
            if c in children and below > stable[c]:
                best[c] = below
            else:
                take.add(c)
        todo = list(children.get(0, []))
        while todo:
            c = todo.pop()
            if c in take:
                chosen.append(c)
            else:
                todo += children[c]
    label = np.full(n, -1)
    for c in chosen:
        todo = [tops[c]]
        while todo:
            v = todo.pop()
            if v < n:
                label[v] = c
            else:
                todo += kids[v]
    order = sorted(chosen, key=lambda c: (-size[tops[c]], int(np.flatnonzero(label == c)[0])))
    rank = {c: k for k, c in enumerate(order)}
    return np.array([rank.get(int(v), -1) for v in label])


@dataclass
class Chart:
    """A pool's map, to which other rows are added: each takes the cluster of the pool unit nearest by mutual reachability,
    or none where that is farther than the largest core distance of the cluster."""

    features: list[str]
    filled: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    centre: np.ndarray
    axes: np.ndarray
    pool: np.ndarray
    core: np.ndarray
    labels: np.ndarray
    edges: np.ndarray

    def assign(self, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[self.features].to_numpy(float)
        x = np.where(np.isfinite(x), x, self.filled)
        vary = self.spread > 0
        x = (x[:, vary] - self.mean[vary]) / self.spread[vary]
        z = (x - self.centre) @ self.axes.T
        z = np.pad(z, ((0, 0), (0, max(0, 2 - z.shape[1]))))
        out = np.full(len(z), -1)
        for i, row in enumerate(z[:, : self.pool.shape[1]]):
            reach = np.maximum(np.sqrt(((self.pool - row) ** 2).sum(1)), self.core)
            k = int(reach.argmin())
            c = self.labels[k]
            if c >= 0 and reach[k] <= self.edges[c]:
                out[i] = c
        return pd.DataFrame({"x": z[:, 0], "y": z[:, 1], "cluster": out})


def map_and_cluster(df: DataFrame, key: str, features: list[str], share: float = 0.95, least: int = 25, samples: int | None = None, leaf: bool = True, dims: int = 2) -> DataFrame:
    """(key, x, y, cluster): the map is the first two components of a pool, clusters are of the first ``dims``; rows beyond the pool are added to its map."""

    def fit(d: pd.DataFrame):
        raw = d[features].to_numpy(float)
        x = standard_matrix(raw)
        if len(d) < 5 or not x.shape[1]:
            raise ValueError("under 5 units, or no feature varies")
        z = components(x, share)
        kept = z.shape[1]
        z = np.pad(z, ((0, 0), (0, max(0, 2 - kept))))
        labels = density_labels(z[:, :dims], min(least, len(d)), samples, leaf)
        raw = np.where(np.isfinite(raw), raw, np.nan)
        known = ~np.isnan(raw).all(0)
        filled = np.zeros(raw.shape[1])
        filled[known] = np.nanmedian(raw[:, known], 0)
        raw = np.where(np.isnan(raw), filled, raw)
        _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
        axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        pool = z[:, :dims]
        near = min(samples or min(least, len(d)), len(d))
        core = np.array([np.partition(np.sqrt(((pool - row) ** 2).sum(1)), near - 1)[near - 1] for row in pool])
        edges = np.array([core[labels == c].max() for c in range(labels.max() + 1)])
        chart = Chart(features, filled, raw.mean(0), raw.std(0), x.mean(0), axes[:kept], pool, core, labels, edges)
        return pd.DataFrame({"x": z[:, 0], "y": z[:, 1], "cluster": labels}), chart

    cast = df.select(key, *(F.col(f).cast("double").alias(f) for f in features))
    return over_pool(cast, key, features, fit, "x double, y double, cluster int")


def prune_outliers(df: DataFrame, features: list[str], label: str, prune: float) -> DataFrame:
    """df without the share ``prune`` of each class farthest from its centre in the plane of the two main components.

    Features are centred, not scaled. Covariances are one aggregate over all
    rows; only their matrix comes to the driver.
    """
    if not prune:
        return df
    if len(features) > MAX_FEATURES:
        raise ValueError(f"over {MAX_FEATURES} features")
    x = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    got = df.agg(*(F.covar_pop(x[i], x[j]) for i, j in pairs)).head()
    if got[0] is None:
        return df
    cov = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, got, strict=True):
        cov[i, j] = cov[j, i] = v
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2].T
    plane = df.withColumns({f"_p{k}": sum((F.lit(float(a)) * c for a, c in zip(axis, x, strict=True)), F.lit(0.0)) for k, axis in enumerate(axes)})
    names = [f"_p{k}" for k in range(len(axes))]
    centre = cut(plane.groupBy(label).agg(*(F.avg(p).alias(f"_m{p}") for p in names)))
    few = F.broadcast if centre.count() <= MAX_GROUPS else lambda rows: rows
    far = plane.join(few(centre), label).withColumn("_d", F.sqrt(sum(((F.col(p) - F.col(f"_m{p}")) ** 2 for p in names), F.lit(0.0))))
    edge = cut(exact_quantiles(far, [label], "_d", [1 - prune]).select(label, F.col("quantile").alias("_edge")))
    return far.join(few(edge), label).filter("_d < _edge").select(*df.columns)


@dataclass
class Members:
    """A pool's members and the edge of each cluster that has one."""

    cluster: str
    block: str
    vector: str
    held: dict

    def assign(self, rows: pd.DataFrame) -> pd.DataFrame:
        new = rows[self.cluster].to_numpy().copy()
        for i, (c, b, v) in enumerate(zip(rows[self.cluster], rows[self.block], rows[self.vector], strict=True)):
            if c in self.held:
                x, blocks, edge = self.held[c]
                other = blocks != b
                if other.any() and np.sqrt(((x[other] - np.asarray(v, float)) ** 2).sum(1)).min() > edge:
                    new[i] = -1
        return pd.DataFrame({"_new": new})


def outlying(df: DataFrame, cluster: str, block: str, key: str, vector: str, share: float = 0.95, least: int = 5) -> DataFrame:
    """df with cluster -1 where a unit's nearest member in another block is farther than the cluster's quantile.

    Clusters with under ``least`` such distances stay whole. Quantiles and
    members are those of a pool; rows beyond it are judged by them.
    """

    def fit(d: pd.DataFrame):
        new, held = d[cluster].to_numpy().copy(), {}
        for c in np.unique(new[new >= 0]):
            at = np.flatnonzero(d[cluster] == c)
            x, b = np.stack([np.asarray(v, float) for v in d[vector].iloc[at]]), d[block].to_numpy()[at]
            near = np.full(len(at), np.inf)
            for i in range(len(at)):
                other = b != b[i]
                if other.any():
                    near[i] = np.sqrt(((x[other] - x[i]) ** 2).sum(1)).min()
            known = np.isfinite(near)
            if known.sum() >= least:
                held[c] = (x, b, np.quantile(near[known], share))
                new[at[known & (near > held[c][2])]] = -1
        return pd.DataFrame({"_new": new}), Members(cluster, block, vector, held)

    moved = over_pool(df, key, [cluster, block, vector], fit, f"_new {df.schema[cluster].dataType.simpleString()}")
    return df.join(moved, key).withColumn(cluster, F.col("_new")).drop("_new")


def candidate_new(df: DataFrame, cluster: str, labelled: str, day: str, least: int = 25, p: float = 0.01, min_days: int = 2, top_day: float = 0.8) -> DataFrame:
    """Clusters with fewer labelled units than the overall share gives by chance, over enough days: candidates for a new class."""
    days = df.groupBy(cluster, day).agg(F.count("*").alias("c"), F.count_if(F.col(labelled)).alias("y"))
    per = days.groupBy(cluster).agg(F.sum("c").alias("n"), F.sum("y").alias("n_labelled"), F.count("*").alias("n_days"), (F.max("c") / F.sum("c")).alias("largest_day_share"))
    per = per.withColumn("overall", F.sum("n_labelled").over(Window.partitionBy(F.lit(0))) / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a cluster

    @F.pandas_udf("double")
    def chance(k: pd.Series, n: pd.Series, q: pd.Series) -> pd.Series:
        from .clusters import beta_cdf

        # binomial P(X <= k) is the Beta integral of 1 - q
        return pd.Series([1.0 if a >= b else beta_cdf(1 - r, b - a, a + 1) for a, b, r in zip(k, n, q, strict=True)])

    out = per.withColumn("expected", F.col("overall") * F.col("n")).withColumn("p_underlabelled", chance("n_labelled", "n", "overall"))
    new = (F.col(cluster) != -1) & (F.col("n") >= least) & (F.col("p_underlabelled") < p) & (F.col("n_days") >= min_days) & (F.col("largest_day_share") <= top_day)
    return out.withColumn("candidate_new", new).drop("overall")
