"""Frozen libraries: scaled features, weighted cosine to cluster centroids, a gate, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most centroids that are sent to the executors; beyond it the assignment runs in blocks of them.
MAX_CENTROIDS = 10_000


def unit_vector(x: Column) -> Column:
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: v / F.greatest(norm, F.lit(1e-9)))


def assign(units: DataFrame, key: str, vector: str, centroids: DataFrame, cluster: str, centre: str, gate: float | None = None, carry: list[str] | None = None) -> DataFrame:
    """(key, columns to carry, cluster, distance): nearest centroid by cosine, the least cluster of those equal to 9 digits; -1 beyond the gate."""
    n = centroids.count()
    blocks = -(-n // MAX_CENTROIDS)
    parts = [centroids] if blocks <= 1 else [centroids.filter(F.pmod(F.xxhash64(cluster), F.lit(2 * blocks)) == k) for k in range(2 * blocks)]
    keys = [key, *(carry or [])]
    left = units.select(*keys, unit_vector(F.col(vector)).alias("_u"))
    near = []
    for part in parts:
        right = part.select(F.col(cluster).alias("_c"), unit_vector(F.col(centre)).alias("_v"))
        packed = right.agg(F.collect_list(F.struct("_c", "_v")).alias("_all"))  # at most MAX_CENTROIDS
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        each = F.transform("_all", lambda x: F.struct(x["_c"].alias("c"), (1 - dot(F.col("_u"), x["_v"])).alias("r")))
        best = F.array_min(F.transform(each, lambda y: F.struct(F.round(y["r"], 9).alias("d"), y["c"].alias("c"), y["r"].alias("r"))))
        near.append(left.crossJoin(F.broadcast(packed)).select(*keys, best.alias("_b")))
    rows = near[0] if len(near) == 1 else reduce(DataFrame.unionByName, near).groupBy(*keys).agg(F.min("_b").alias("_b"))
    far = F.lit(False) if gate is None else F.col("_b.d") > gate
    return rows.select(*keys, F.when(far, -1).otherwise(F.col("_b.c")).alias("cluster"), F.col("_b.r").alias("distance"))


def classify(assigned: DataFrame, verdicts: DataFrame, cluster: str = "cluster") -> DataFrame:
    """assigned with the verdict of its cluster; ``uncertain`` without one."""
    return assigned.join(verdicts, cluster, "left").withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))
