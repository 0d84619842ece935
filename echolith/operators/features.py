"""Features of detection frames and of windows, from contours and clicks; all sums are distributed, no frame is collected whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import scalars as S

from . import acoustics
from .intervals import overlapping
from .windows import frames

#: Width of the linear bins of whistle frames.
BIN_HZ = 100.0


def whistle_frames(
    contours: DataFrame, event: str, length: int, hop: int, low: float = 2000.0, high: float = 20_000.0, min_density: float = 0.05, min_frag_ms: float = 200.0,
    downsample: int = 2, per_octave: int | None = None,
) -> DataFrame:
    """(event, frame, frame_start, n_detections, density, features) of contours (contour_id, start_us, end_us, times, freqs).

    A frame has the contours that start or end in it; density counts their
    points against the slices of the frame, a slice being the first contour's
    mean step. The histogram takes points from the frame's start on, the later
    end being 1000 frame lengths, as in the published feature pipeline.
    per_octave: octave bands, not bins of 100 Hz.
    """
    x = frames(contours, event, "start_us", "end_us", length, hop)
    n = F.size("times")
    step = (F.element_at("times", -1) - F.get("times", F.lit(0))) / F.when(n > 1, n - 1)
    keys = [event, "frame"]
    base = x.groupBy(*keys).agg(
        F.min("frame_start").alias("frame_start"), F.count("*").alias("n_detections"), F.sum(n).alias("_points"),
        F.min_by(F.struct(step.alias("s")), F.struct("start_us", "contour_id")).alias("_first"),
    )
    base = base.withColumn("density", F.col("_points") * F.col("_first.s") / (length / S.US)).filter(F.col("density") >= min_density)

    if per_octave:
        edges = acoustics.band_edges(low, high, per_octave)
        first = int(np.rint(per_octave * np.log2(edges[0] / 1000) + 0.5))
        bins, of = len(edges) - 1, lambda f: F.floor(per_octave * F.log2(f / 1000) + 0.5) - first
    else:
        bins, of = int((high - low) / BIN_HZ), lambda f: F.floor((f - low) / BIN_HZ)
    long = (F.col("end_us") - F.col("start_us")) / 1000 >= min_frag_ms
    point = F.explode(F.arrays_zip("times", "freqs")).alias("p")
    at = (F.col("start_us") - F.col("frame_start")) / S.US + F.col("p.times") - F.col("_t0")
    points = x.filter(long).select(*keys, "start_us", "frame_start", F.get("times", F.lit(0)).alias("_t0"), point)
    points = points.filter((at >= 0) & (at < length / S.US * 1000) & (F.col("p.freqs") > 0)).select(*keys, of(F.col("p.freqs")).cast("int").alias("bin"))
    k = max(downsample, 1)
    kept = points.filter((F.col("bin") >= 0) & (F.col("bin") < bins)).withColumn("bin", F.floor(F.col("bin") / k).cast("int"))
    counts = kept.groupBy(*keys, "bin").agg((F.count("*") / F.least(F.lit(k), bins - F.col("bin") * k)).alias("c"))
    packed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"), F.sum("c").alias("_t"))  # at most one entry a bin
    spectrum = F.transform(F.sequence(F.lit(0), F.lit(-(-bins // k) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i) / F.col("_t"), F.lit(0.0)))
    return base.join(packed, keys).select(*keys, "frame_start", "n_detections", "density", spectrum.alias("features"))


def click_frames(
    clicks: DataFrame, event: str, length: int, hop: int, rate: float, low: float = 10_000.0, high: float = 40_000.0, min_clicks: int = 3, fft_len: int = 512,
    smooth: int = 3, downsample: int = 2,
) -> DataFrame:
    """(event, frame, frame_start, n_detections, features) of clicks (start_us, end_us, wave); frames with an empty bin go."""
    levelled = clicks.withColumn("_level", acoustics.click_level_column("wave", fft_len)).drop("wave")
    x = frames(levelled, event, "start_us", "end_us", length, hop)
    keys = [event, "frame"]
    bins = x.select(*keys, "frame_start", F.posexplode("_level").alias("bin", "v")).groupBy(*keys, "bin").agg(
        F.min("frame_start").alias("frame_start"), F.avg("v").alias("v"), F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("gaps")
    )
    frame, half, k = Window.partitionBy(*keys), fft_len // 2, max(downsample, 1)
    first, last = int(low / (rate / 2) * half), int(high / (rate / 2) * half)
    # trailing means of the level above its least; the least may be taken off after the mean
    level = F.avg("v").over(frame.orderBy("bin").rowsBetween(1 - smooth, 0)) - F.min("v").over(frame)
    whole = bins.withColumn("_gaps", F.sum("gaps").over(frame)).withColumn("v", level).filter((F.col("_gaps") == 0) & (F.col("n") >= max(min_clicks, 1)))
    cut = whole.filter((F.col("bin") >= first) & (F.col("bin") < last)).withColumn("bin", F.floor((F.col("bin") - first) / k))
    part = cut.groupBy(*keys, "bin").agg(F.min("frame_start").alias("frame_start"), F.max("n").alias("n"), F.avg("v").alias("v"))
    packed = part.groupBy(*keys).agg(
        F.min("frame_start").alias("frame_start"), F.max("n").alias("n_detections"), F.sum("v").alias("_t"), F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("_x")
    ).filter("_t > 0")
    return packed.select(*keys, "frame_start", "n_detections", F.transform("_x", lambda e: e["v"] / F.col("_t")).alias("features"))


def window_features(
    windows: DataFrame, contours: DataFrame, key: str, w_span: tuple[str, str], measures: list[str], width: int, low: float = 800.0, high: float = 16_000.0, bins: int = 32,
    min_contours: int = 2, min_occupancy: float = 0.0, min_longest_s: float = 0.0,
) -> DataFrame:
    """windows with features of the contours that overlap them; windows failing a filter go.

    contours: contour_id, start_us, end_us, duration_s, snr_db, slice_s,
    points (array of t, f; t from the contour's start) and the measures. The
    features are mean and sample deviation of each measure, those of the
    longest contour (the first of equals), and of the points inside the window:
    seconds, occupancy, mean, deviation, quantiles and a frequency profile.
    """
    pairs = overlapping(windows.select(key, *w_span), contours, w_span, ("start_us", "end_us"), width)
    named = [F.avg(m).alias(f"{m}_mean") for m in measures] + [F.stddev_samp(m).alias(f"{m}_std") for m in measures]
    longest = F.max_by(F.struct("duration_s", *(m for m in measures if m != "duration_s")), F.struct("duration_s", -F.col("start_us"), -F.col("contour_id"))).alias("_lc")
    agg = pairs.groupBy(key).agg(F.count("*").alias("n_contours"), F.avg("snr_db").alias("snr_db_mean"), *named, longest)
    agg = agg.select("*", *(F.col(f"_lc.{m}").alias(f"lc_{m}") for m in dict.fromkeys(["duration_s", *measures]))).drop("_lc")

    t = lambda p: F.col("start_us") + F.floor(p["t"] * S.US)
    inside = F.filter("points", lambda p: (t(p) >= F.col(w_span[0])) & (t(p) < F.col(w_span[1])))
    points = pairs.select(key, "slice_s", F.explode(inside).alias("p")).select(key, "slice_s", F.col("p.f").alias("f"))
    edges = np.linspace(low, high, bins + 1)
    b = F.greatest(F.least(F.floor((F.col("f") - low) / ((high - low) / bins)), F.lit(bins - 1)), F.lit(0))
    profile = [(F.count_if(b == k) / F.count("*")).alias(f"prof_{int(edges[k])}_{int(edges[k + 1])}") for k in range(bins)]
    q = F.percentile("f", F.array(F.lit(0.1), F.lit(0.9)))
    inner = points.groupBy(key).agg(F.sum("slice_s").alias("tonal_s"), F.avg("f").alias("pts_mean_freq_hz"), F.stddev_samp("f").alias("pts_std_freq_hz"), q.alias("_q"), *profile)
    inner = inner.select("*", F.col("_q")[0].alias("pts_q10_hz"), F.col("_q")[1].alias("pts_q90_hz")).drop("_q")
    out = windows.join(agg, key).join(inner, key, "left")
    span = (F.col(w_span[1]) - F.col(w_span[0])) / S.US
    out = out.withColumn("tonal_s", F.coalesce("tonal_s", F.lit(0.0))).withColumn("occupancy", F.col("tonal_s") / span)
    return out.filter((F.col("n_contours") >= min_contours) & (F.col("occupancy") >= min_occupancy) & (F.col("lc_duration_s") >= min_longest_s))
