"""Detector settings inferred from data: sample rate, FFT length and hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual sample rates in Hz.
RATES = [8000, 16000, 22050, 24000, 32000, 44100, 48000, 62500, 64000, 88200, 96000, 128000, 144000, 192000, 200000, 250000, 256000, 288000, 384000, 500000, 512000, 576000, 768000]


def snap_rate(hz: Column, tolerance: float = 0.005) -> Column:
    """The usual rate nearest to hz within the tolerance, else hz rounded."""
    near = F.array_min(F.transform(F.array(*map(F.lit, RATES)), lambda r: F.struct(F.abs(hz - r).alias("d"), r.alias("r"))))
    return F.when(near["d"] <= tolerance * near["r"], near["r"].cast("double")).otherwise(F.rint(hz))


def sample_rates(df: DataFrame, file: str, sample: str, seconds: str) -> DataFrame:
    """(file, rate): slope of sample numbers on time, snapped."""
    return df.groupBy(file).agg(F.regr_slope(sample, seconds).alias("_s")).select(file, snap_rate(F.col("_s")).alias("rate"))


def consensus(df: DataFrame, value: str) -> DataFrame:
    """(value, n_values): the most frequent rounded value, the least of equals, and how many there are."""
    per = df.groupBy(F.rint(value).alias("v")).agg(F.count("*").alias("c"))
    return per.agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("v"))).alias("m"), F.count("*").alias("n_values")).select(F.col("m.v").alias("value"), "n_values")


def fft_length(hop: Column) -> Column:
    """Twice the hop, as a power of two."""
    return F.pow(F.lit(2.0), F.rint(F.log2(hop * 2))).cast("long")


def whistle_settings(df: DataFrame, file: str) -> DataFrame:
    """(file, rate, hop, fft, bin_hz): what each file's contours tell of the detector; null where they don't.

    df: millis, start_sample, sample_duration, slices (numbers), low_hz and low_bin (the lower limit and the lowest bin
    of the peaks, null where unknown). The hop is the start sample by the first slice number, the width of a bin
    the lower limit by its bin. The FFT length is the power of two whose rate comes nearest to the slope of samples
    on time, taken where that rate is a usual one. Without bin widths it comes from the durations and slices.
    """
    first = F.get("slices", F.lit(0))
    later = first > 0
    per = df.groupBy(file).agg(
        F.rint(F.median(F.when(later, F.col("start_sample") / first))).alias("hop"), F.median(F.when(F.col("low_bin") > 0, F.col("low_hz") / F.col("low_bin"))).alias("bin_hz"),
        F.regr_slope(F.col("start_sample").cast("double"), F.col("millis") / 1000).alias("_slope"), F.rint(F.median(F.when(later, (F.col("start_sample") + 1) / first))).alias("_hop"),
    )
    long = df.join(per.filter("bin_hz IS NULL").select(file, "_hop"), file).groupBy(file).agg(F.median(F.col("sample_duration") - (F.size("slices") - 1) * F.col("_hop")).alias("_long"))
    x = per.join(long, file, "left").withColumn("_rough", snap_rate(F.col("_slope")))
    k = F.greatest(F.least(F.rint(F.log2(F.col("_rough") / F.col("bin_hz"))), F.lit(16.0)), F.lit(6.0))
    near = F.pow(F.lit(2.0), k)
    rate = snap_rate(F.col("bin_hz") * near)
    usual = rate.isin(*map(float, RATES)) & (F.abs(rate - F.col("bin_hz") * near) <= 0.005 * rate)
    known, guessed = F.col("bin_hz").isNotNull() & F.col("_rough").isNotNull() & usual, F.col("bin_hz").isNull() & F.col("hop").isNotNull() & F.col("_rough").isNotNull()
    return x.select(
        file, F.when(known, rate).when(guessed, F.col("_rough")).alias("rate"), "hop",
        F.when(known, near).when(guessed, F.pow(F.lit(2.0), F.rint(F.log2("_long")))).alias("fft"), "bin_hz",
    )


def agreed(per_file: DataFrame, values: list[str]) -> DataFrame:
    """One row: of each value the most frequent one of the files, the least of equals, and n_<value>, how many different ones there are."""
    out = None
    for v in values:
        one = consensus(per_file.filter(F.col(v).isNotNull()), v).select(F.col("value").alias(v), F.col("n_values").alias(f"n_{v}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
