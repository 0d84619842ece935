"""Assignment of detections to frames, sliding windows and filled blocks; features of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(df: DataFrame, keys: list[str], start: str, end: str, length: int, step: int, anchor: int) -> DataFrame:
    """Each interval with the windows that it touches, on the grid of its keys: floor(first start / anchor) * anchor.

    Window numbers are computed, not joined; ``w_start`` is the window's start.
    """
    first = F.min(start).over(Window.partitionBy(*keys))
    grid = df.withColumn("_g", first - F.pmod(first, F.lit(anchor)))
    low = F.greatest(F.ceil((F.col(start) - F.col("_g") - length + 1) / step), F.lit(0))
    high = F.floor((F.col(end) - 1 - F.col("_g")) / step)
    return grid.withColumn("_k", F.explode(F.sequence(low, F.greatest(low, high)))).withColumn("w_start", F.col("_g") + F.col("_k") * step).drop("_g", "_k")


def frames(df: DataFrame, key: str, start: str, end: str, length: int, hop: int) -> DataFrame:
    """Each detection with the frames (from the key's first start) in which it starts or ends."""
    t0 = F.min(start).over(Window.partitionBy(key))
    last = F.max(end).over(Window.partitionBy(key))
    base = df.withColumn("_t0", t0).withColumn("_n", F.ceil((last - F.col("_t0")) / hop))

    def ids(t: Column) -> Column:
        low = F.greatest(F.floor((t - F.col("_t0") - length) / hop) + 1, F.lit(0))
        high = F.least(F.floor((t - F.col("_t0")) / hop), F.col("_n") - 1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    frame = F.explode(F.array_union(ids(F.col(start)), ids(F.col(end))))
    return base.withColumn("frame", frame).withColumn("frame_start", F.col("_t0") + F.col("frame") * hop).drop("_t0", "_n")


def filled_blocks(periods: DataFrame, counts: DataFrame, start: str, end: str, block: str, width: int) -> DataFrame:
    """Every block that a period touches, with its counts; blocks without any stay, null."""
    first = F.col(start) - F.pmod(F.col(start), F.lit(width))
    grid = periods.select(F.explode(F.sequence(first, F.col(end) - 1, F.lit(width))).alias(block)).distinct()
    return grid.join(counts, block, "left")


def intervals_between(df: DataFrame, keys: list[str], t: str, most: int, least: int = 0) -> DataFrame:
    """df with ``ici``: time since the previous row of the keys; null if over most or not over least."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, "detection_id"))
    return df.withColumn("ici", F.when((gap <= most) & (gap > least), gap))


def interval_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and mean, deviation (0 for one interval), median, 5th and 95th percentile of ``ici``."""
    q = lambda p: F.percentile("ici", F.lit(p))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("ici").alias("n_intervals"), F.avg("ici").alias("ici_mean"),
        F.when(F.count("ici") == 1, F.lit(0.0)).otherwise(F.stddev_samp("ici")).alias("ici_std"), q(0.5).alias("ici_median"), q(0.05).alias("ici_p05"), q(0.95).alias("ici_p95"),
    )


def unit_ids(df: DataFrame, start_us: str, order: str) -> DataFrame:
    """df with ``unit_id``: the start to three decimals, and _k for the k-th row of the same."""
    text = F.format_string("%d.%03d", F.floor(F.col(start_us) / 1_000_000), F.floor(F.pmod(F.col(start_us), F.lit(1_000_000)) / 1000))
    k = F.row_number().over(Window.partitionBy("_u").orderBy(order)) - 1
    return df.withColumn("_u", text).withColumn("_n", k).withColumn("unit_id", F.when(F.col("_n") == 0, F.col("_u")).otherwise(F.concat_ws("_", "_u", "_n"))).drop("_u", "_n")


def click_windows(
    clicks: DataFrame, day: str, t: str, length: int, step: int, max_ici: int, min_ici: int = 0, min_clicks: int = 2, measures: list[str] | None = None, profile: list[str] | None = None
) -> DataFrame:
    """Sliding windows of clicks (detection_id, t in integers) with their intervals and spectra.

    Windows start on the minute of each day's first click; those of too few
    clicks or without an interval go. Intervals are between neighbours in the
    window. ``click_<measure>_median``, quartile ranges of peak_hz and
    centroid_hz, and means of the profile's columns leave out missing values.
    """
    measures, profile = measures or [], profile or []
    held = clicks.select("detection_id", day, t, F.col(t).alias("_a"), (F.col(t) + 1).alias("_z"), *measures, *profile)
    placed = sliding(held, [day], "_a", "_z", length, step, 60_000_000)
    x = intervals_between(placed, [day, "w_start"], t, max_ici, min_ici)
    q = {m: F.percentile(F.when(~F.isnan(m), F.col(m)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for m in measures}
    spectra = [F.get(q[m], F.lit(1)).alias(f"click_{m}_median") for m in measures]
    spectra += [(F.get(q[m], F.lit(2)) - F.get(q[m], F.lit(0))).alias(f"click_{m}_iqr") for m in ("peak_hz", "centroid_hz") if m in measures]
    means = [F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in profile]
    out = interval_features(x, [day, "w_start"])
    if spectra or means:
        out = out.join(x.groupBy(day, "w_start").agg(*spectra, *means), [day, "w_start"])
    kept = out.filter((F.col("n") >= max(min_clicks, 2)) & (F.col("n_intervals") > 0)).withColumn("w_end", F.col("w_start") + length)
    return kept.withColumnsRenamed({"n": "n_clicks", **{f"ici_{k}": f"ici_{k}_s" for k in ("mean", "std", "median", "p05", "p95")}}).withColumns({f"ici_{k}_s": F.col(f"ici_{k}_s") / 1_000_000 for k in ("mean", "std", "median", "p05", "p95")})
