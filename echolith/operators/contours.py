"""Contours as arrays of points: band clip, frame histograms, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(times: Column, freqs: Column, low: float, high: float) -> Column:
    """Points (t, f) whose frequency lies in the band, ends included."""
    points = F.zip_with(times, freqs, lambda t, f: F.struct(t.alias("t"), f.alias("f")))
    return F.filter(points, lambda p: (p["f"] >= low) & (p["f"] <= high))


def prepare(df: DataFrame, times: str, freqs: str, slice_s: str, low: float, high: float, least_s: float) -> DataFrame:
    """df with points, n_points and duration_s; contours with fewer than three points or too short go."""
    x = df.withColumn("points", clip(F.col(times), F.col(freqs), low, high)).filter(F.size("points") >= 3)
    long = F.element_at("points", -1)["t"] - F.element_at("points", 1)["t"] + F.col(slice_s)
    return x.withColumn("n_points", F.size("points")).withColumn("duration_s", long).filter(F.col("duration_s") >= least_s)


def histogram(points: DataFrame, keys: list[str], f: str, low: float, width: float, bins: int) -> DataFrame:
    """(keys, bin, share): frequencies of the points of each key by bin, as shares of the key."""
    b = F.floor((F.col(f) - low) / width).cast("int")
    per = points.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count("*").alias("_c"))
    total = per.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    return per.join(total, keys).select(*keys, "bin", (F.col("_c") / F.col("_t")).alias("share"))
