"""Exact quantiles of groups whose values no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions.scalars import known
from echolith.operators.intervals import _same
from echolith.sources.durable import cut

#: Most groups whose splitters and wanted ranks are broadcast; beyond it they are joined.
MAX_GROUPS = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], parts: int = 100, times: str | None = None) -> DataFrame:
    """(keys, share, quantile, n): what percentile() gives of each group, by interpolation between neighbouring ranks; null and NaN don't count.

    A mergeable sketch cuts each group's values into about ``parts`` runs of
    as many rows; exact counts of the runs tell in which ones the wanted ranks lie, and only the
    values of those are shuffled, equal ones as one row, and sorted, each run in a task of its own. So df is read three times. ``times``: how many rows each row stands for, 1 or more.
    """
    x = df.select(*keys, known(F.col(value)).alias("_v"), (F.col(times) if times else F.lit(1)).cast("long").alias("_n")).filter("_v IS NOT NULL")
    cuts = cut(x.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*(F.lit(k / parts) for k in range(1, parts))), F.lit(20 * parts)).alias("_s")))
    few = F.broadcast if cuts.count() <= MAX_GROUPS else lambda rows: rows
    placed = _same(x, few(cuts), keys).withColumn("_b", F.lit(0))
    for k in reversed(range((parts - 1).bit_length())):  # by bisection: how many splitters are less
        placed = placed.withColumn("_b", F.col("_b") + F.when(F.get("_s", F.col("_b") + ((1 << k) - 1)) < F.col("_v"), 1 << k).otherwise(0))
    placed = placed.drop("_s")
    at = [*keys, "_b"]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # parts rows a group
    runs = placed.groupBy(*at).agg(F.sum("_n").alias("_m"))
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy(*keys))})
    rank = (F.col("n") - 1) * F.col("share")
    wanted = runs.withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares))))).withColumn("_r", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
    wanted = cut(wanted.filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_m"))))
    held = _same(placed, few(wanted.groupBy(*at).agg(F.first("_before").alias("_before"))), at).filter("_before IS NOT NULL")
    held = held.groupBy(*at, "_v").agg(F.sum("_n").alias("_n"), F.first("_before").alias("_before"))
    ends = held.withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy(*at).orderBy("_v")))
    # The value of a rank is the one whose rows end beyond it and began at it or before.
    found = _same(ends.select(*at, "_v", "_n", "_end"), few(wanted.select(*at, "share", "_r", "n")), at).filter((F.col("_end") > F.col("_r")) & (F.col("_end") - F.col("_n") <= F.col("_r"))).withColumnRenamed("_v", "_x")
    part = F.max_by("_x", "_r") - F.min_by("_x", "_r")
    out = found.groupBy(*keys, "share", "n").agg(F.min_by("_x", "_r").alias("_low"), part.alias("_d"))
    return out.select(*keys, "share", (F.col("_low") + F.coalesce("_d", F.lit(0.0)) * ((F.col("n") - 1) * F.col("share") - F.floor((F.col("n") - 1) * F.col("share")))).alias("quantile"), "n")
