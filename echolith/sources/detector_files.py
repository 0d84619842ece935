"""Clicks, whistles and frames straight from detector files, in two passes.

The files hold sample and slice numbers; neither the sample rate nor the
settings of the detector's FFT are in them. The first pass works these out for
each file from its detections and lets the files agree; the second turns numbers
into seconds and Hz. The decoder of a format is the caller's (``binary.read``):

* clicks: millis, start_sample, sample_duration, wave, uid
* whistles: millis, start_sample, sample_duration, slices, bins, low_hz,
  low_bin, signal, noise, amplitude, uid

Defined results: a file of which a detection is missing gives what it gave until
then; files that the decoder refuses give no detection and are counted; a file
whose settings neither it nor the others tell gives no whistles and is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions.scalars import US
from echolith.operators import features
from echolith.operators.intervals import containing

from . import binary, settings
from .durable import cut

CLICK = "millis long, start_sample long, sample_duration long, wave array<double>, uid long"
WHISTLE = (
    "millis long, start_sample long, sample_duration long, slices array<long>, bins array<double>, low_hz double, low_bin double, signal double, noise double, amplitude double, uid long"
)
Decoder = Callable[[bytes, str], Iterator[dict[str, Any]]]


@dataclass
class Detections:
    """rows; settings: one row of what the files agree on; files: (file, rate and what else is known of each, skipped)."""

    rows: DataFrame
    settings: DataFrame
    files: DataFrame


def clicks(
    spark: SparkSession, path: str, decode: Decoder, periods: DataFrame | None = None, pattern: str = "*Click_Detector_Clicks*.pgdf", rate: float | None = None, wave: bool = True,
    measure: tuple[Callable[[list, float], pd.DataFrame], str] | None = None,
) -> Detections:
    """start, duration (s), wave, uid, file of every click, and the measures.

    measure: (function, its columns as a schema). It gets some clicks' waves and the sample rate of their file, or
    where that one does not tell, the agreed rate, and gives a row for each. Waves are left out where they aren't wanted.
    Durations are by the agreed rate.
    """
    raw = binary.read(spark, path, decode, CLICK, pattern, periods)
    own = raw.filter("error IS NULL").groupBy("file").agg(F.regr_slope(F.col("start_sample").cast("double"), F.col("millis") / 1000).alias("_s"), F.count("*").alias("n"))
    own = own.select("file", (F.lit(float(rate)) if rate else settings.snap_rate(F.col("_s"))).alias("rate"), "n")
    refused = raw.filter("error IS NOT NULL").select("file", "error").distinct()
    files = cut(own.join(refused, "file", "full"))
    said = cut(settings.agreed(files, ["rate"]))
    rows = raw.filter("error IS NULL").join(files.select("file", F.col("rate").alias("_own")), "file").crossJoin(F.broadcast(said.select(F.col("rate").alias("_rate"))))  # one row
    rows = rows.withColumns({"start": F.col("millis") / 1000, "duration": F.col("sample_duration") / F.col("_rate"), "_own": F.coalesce("_own", "_rate")})
    names = ["start", "duration", *(["wave"] if wave else []), "uid", "file"]
    if measure is None:
        return Detections(rows.select(*names), said, files)
    make, schema = measure
    fields = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r, g in b.groupby("_own", dropna=False):
                g = g.reset_index(drop=True)
                known = make(g["wave"].tolist(), float(r))[fields] if pd.notna(r) else pd.DataFrame({f: [None] * len(g) for f in fields})
                yield pd.concat([g[names], known.reset_index(drop=True)], axis=1)

    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return Detections(rows.select(*dict.fromkeys([*names, "wave", "_own"])).mapInPandas(run, f"{kinds}, {schema}"), said, files)


def whistles(
    spark: SparkSession, path: str, decode: Decoder, periods: DataFrame | None = None, pattern: str = "*Contours*.pgdf", rate: float | None = None, hop: int | None = None, fft: int | None = None
) -> Detections:
    """start, duration, times (s), freqs (Hz), slice_s, snr_db, amplitude_db, uid, file of every contour. Given settings overrule the files'."""
    raw = binary.read(spark, path, decode, WHISTLE, pattern, periods)
    found = raw.filter("error IS NULL")
    own = settings.whistle_settings(found, "file")
    given = {"rate": rate, "hop": hop, "fft": fft}
    own = own.withColumns({c: F.lit(float(v)) for c, v in given.items() if v})
    said = cut(settings.agreed(own, ["rate", "hop", "fft"]))
    x = own.crossJoin(F.broadcast(said.select(*(F.col(c).alias(f"_{c}") for c in given))))  # one row
    x = x.withColumns({"rate": F.coalesce("rate", "_rate"), "hop": F.coalesce("hop", "_hop")})
    # A file without a rate of its own: its FFT length by the agreed rate and the width of its bins.
    x = x.withColumn("fft", F.coalesce("fft", F.pow(F.lit(2.0), F.rint(F.log2(F.col("rate") / F.col("bin_hz")))), "_fft"))
    x = x.withColumn("skipped", F.col("rate").isNull() | F.col("hop").isNull() | F.col("fft").isNull())
    refused = raw.filter("error IS NOT NULL").select("file", "error").distinct()
    files = cut(x.select("file", "rate", "hop", "fft", "bin_hz", "skipped").join(refused, "file", "full"))
    rows = found.join(files.filter("NOT skipped").select("file", "rate", "hop", "fft"), "file")
    heard = (F.col("signal") > 0) & (F.col("noise") > 0)
    rows = rows.select(
        (F.col("millis") / 1000).alias("start"), (F.col("sample_duration") / F.col("rate")).alias("duration"), F.transform("slices", lambda s: s * F.col("hop") / F.col("rate")).alias("times"),
        F.transform("bins", lambda b: b * F.col("rate") / F.col("fft")).alias("freqs"), (F.col("hop") / F.col("rate")).alias("slice_s"),
        F.when(heard, 20 * F.log10(F.col("signal") / F.col("noise"))).alias("snr_db"), F.col("amplitude").alias("amplitude_db"), "uid", "file",
    )
    return Detections(rows, said, files)


def labelled(rows: DataFrame, annotations: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """Detections that start in an annotated period, once for each period that holds them, with the periods' other columns."""
    p = annotations.withColumnRenamed("start", "_from").withColumnRenamed("end", "_to")
    clash = [c for c in p.columns if c in rows.columns]
    return containing(rows.drop(*clash), p, "start", "_from", "_to", bucket_s).drop("_from", "_to")


@dataclass
class Frames:
    """frames with their label; counts: one row; by_label: (label, n_frames); missing: events without frames."""

    frames: DataFrame
    counts: DataFrame
    by_label: DataFrame
    missing: DataFrame
    detections: Detections


def make_frames(spark: SparkSession, path: str, annotations: DataFrame, decode: Decoder, kind: str, length_s: float, hop_s: float, rate: float | None = None, pattern: str | None = None, **shape) -> Frames:
    """Frames of the annotated periods (event_id, label, start, end in seconds) from click or whistle files. Only files that may hold detections in a period are read.

    shape: settings of ``features.whistle_frames`` or ``features.click_frames``.
    """
    if kind not in ("click", "whistle"):
        raise ValueError(f"kind is click or whistle, not {kind!r}")
    more = {"pattern": pattern} if pattern else {}
    spans = annotations.select("start", "end")
    got = clicks(spark, path, decode, spans, rate=rate, **more) if kind == "click" else whistles(spark, path, decode, spans, rate=rate, **more)
    own = cut(labelled(got.rows, annotations))
    us = lambda c: F.rint(F.col(c) * US).cast("long")
    rows = own.withColumn("start_us", us("start")).withColumn("end_us", F.rint((F.col("start") + F.col("duration")) * US).cast("long"))
    length, hop = int(length_s * US), int(hop_s * US)
    if kind == "click":
        known = got.settings.head()["rate"]
        frames = features.click_frames(rows.withColumn("detection_id", F.monotonically_increasing_id()), "event_id", length, hop, known, **shape) if known else None
    else:
        frames = features.whistle_frames(rows.withColumn("contour_id", F.monotonically_increasing_id()), "event_id", length, hop, **shape)
    if frames is None:
        raise ValueError("no file tells the sample rate; give it")
    labels = annotations.groupBy("event_id").agg(F.min("label").alias("label"))
    frames = cut(frames.join(labels, "event_id"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(got.rows, "n_detections_read").crossJoin(one(own, "n_detections_annotated")).crossJoin(one(frames, "n_frames"))  # one row each
    missing = annotations.select("event_id").distinct().join(frames.select("event_id").distinct(), "event_id", "left_anti")
    return Frames(frames, counts, frames.groupBy("label").agg(F.count("*").alias("n_frames")), missing, got)
