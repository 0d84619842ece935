"""Clicks, whistles and frames from hand-made detector files.

The test format: records one after the other. A click is ``<qqqqH`` (millis,
start sample, duration in samples, uid, number of samples) and its samples as
``<d``; a whistle is ``<qqqqdddddH`` (millis, start sample, duration in samples,
uid, lower limit in Hz, its bin, signal, noise, amplitude, number of slices)
and ``<qd`` (slice number, peak bin) for each slice; negative signal, noise or bin: unknown.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pytest

from echolith.sources import detector_files as D
from echolith.sources import settings

DAY = 1_704_067_200  # 2024-01-01


def decode_clicks(content, name):
    at = 0
    while at < len(content):
        if len(content) - at < 34:
            raise ValueError(f"{name}: broken record")
        millis, start, long, uid, n = struct.unpack_from("<qqqqH", content, at)
        wave = struct.unpack_from(f"<{n}d", content, at + 34)
        at += 34 + 8 * n
        yield {"millis": millis, "start_sample": start, "sample_duration": long, "uid": uid, "wave": list(wave)}


def decode_whistles(content, name):
    at, size = 0, struct.calcsize("<qqqqdddddH")
    while at < len(content):
        if len(content) - at < size:
            raise ValueError(f"{name}: broken record")
        millis, start, long, uid, low_hz, low_bin, signal, noise, amplitude, n = struct.unpack_from("<qqqqdddddH", content, at)
        pairs = list(struct.iter_unpack("<qd", content[at + size : at + size + 16 * n]))
        at += size + 16 * n
        known = {"low_hz": low_hz, "low_bin": low_bin} if low_bin >= 0 else {}
        yield {
            "millis": millis, "start_sample": start, "sample_duration": long, "uid": uid, "signal": signal, "noise": noise, "amplitude": amplitude,
            "slices": [s for s, _ in pairs], "bins": [b for _, b in pairs], **known,
        }


def whistle(t, first, rate=96_000, hop=512, fft=1024, n=20, low_bin=30, uid=1, signal=10.0, noise=1.0):
    """A contour that starts in slice ``first`` of a recording that began at t - first * hop / rate."""
    head = struct.pack("<qqqqdddddH", round(1000 * t), first * hop, (n - 1) * hop + fft, uid, low_bin * rate / fft, low_bin, signal, noise, 3.0, n)
    return head + b"".join(struct.pack("<qd", first + j, 100 + j) for j in range(n))


def _whistles(folder, at=DAY, rate=96_000, fft=1024, n=6):
    """Contours every 10 s from the start of a file."""
    return b"".join(whistle(at + (s := 1 + 10 * k) * 512 * 100 / rate, s * 100, rate, fft=fft, uid=k) for k in range(n))


def test_whistles_in_hz_and_seconds(spark, tmp_path):
    """Two passes: rates, hops and FFT lengths by file, then of all; a lone contour takes what the others agree on."""
    d = tmp_path / "w"
    d.mkdir()
    (d / "A_Contours_20240101_000000.pgdf").write_bytes(_whistles(d))
    (d / "B_Contours_20240101_010000.pgdf").write_bytes(_whistles(d, DAY + 3600, 48_000, 512))
    (d / "C_Contours_20240101_020000.pgdf").write_bytes(whistle(DAY + 7200.0, 700, signal=-1.0))
    (d / "E_Contours_20240101_030000.pgdf").write_bytes(_whistles(d, DAY + 10_800) + b"rest")
    (d / "F_Contours_20240101_040000.pgdf").write_bytes(b"")
    (d / "G_Contours_20240101_050000.pgdf").write_bytes(_whistles(d, DAY + 18_000))
    got = D.whistles(spark, str(d), decode_whistles)
    said = got.settings.head()
    assert (said["rate"], said["hop"], said["fft"], said["n_rate"], said["n_fft"]) == (96_000, 512, 1024, 2, 2)
    files = {r.file[0]: r for r in got.files.collect()}
    assert (files["A"].rate, files["A"].hop, files["A"].fft, files["A"].bin_hz) == (96_000, 512, 1024, 93.75)
    assert (files["B"].rate, files["B"].fft) == (48_000, 512) and (files["C"].rate, files["C"].fft) == (96_000, 1024)
    assert "broken record" in files["E"].error and "F" not in files
    rows = got.rows.collect()
    assert len(rows) == 6 + 6 + 1 + 6 + 6
    lone = next(r for r in rows if r.file.startswith("C"))
    assert lone.snr_db is None and lone.start == DAY + 7200 and lone.slice_s == pytest.approx(512 / 96_000) and lone.duration == pytest.approx((19 * 512 + 1024) / 96_000)
    assert lone.freqs == pytest.approx([(100 + j) * 93.75 for j in range(20)]) and lone.times == pytest.approx([(700 + j) * 512 / 96_000 for j in range(20)])
    other = next(r for r in rows if r.file.startswith("B"))
    assert other.freqs[0] == pytest.approx(100 * 48_000 / 512) and other.snr_db == pytest.approx(20)
    forced = D.whistles(spark, str(d), decode_whistles, rate=192_000).rows.filter("file LIKE 'A%'").head()
    assert forced.slice_s == pytest.approx(512 / 192_000)


def test_settings_without_bin_widths(spark):
    """Rates from the slope and FFT lengths from durations; one contour tells nothing but its hop."""
    rows = [("a", 1000 * k, 96_000 * k + 512, 9 * 512 + 1024, [(96_000 * k + 512) // 512 + j for j in range(10)], None, None) for k in range(1, 6)]
    rows += [("b", 5, 5120, 100, [10], None, None), ("c", 5, 5120, 100, [10], 93.75 * 8, 8.0), ("d", 1000, 0, 10, [0], None, None), ("d", 1000, 0, 10, [0], None, None)]
    df = spark.createDataFrame(rows, "file string, millis long, start_sample long, sample_duration long, slices array<long>, low_hz double, low_bin double")
    got = {r.file: r for r in settings.whistle_settings(df, "file").collect()}
    assert (got["a"].rate, got["a"].hop, got["a"].fft) == (96_000, 512, 1024)
    assert (got["b"].rate, got["b"].hop, got["b"].fft) == (None, 512, None)
    assert (got["c"].rate, got["c"].fft, got["c"].bin_hz) == (None, None, 93.75)
    assert (got["d"].rate, got["d"].hop) == (None, None)


def _clicks(at, rate=96_000, n=40, every=0.1):
    r = np.random.default_rng(int(at) % 97)
    return b"".join(struct.pack("<qqqqH", round(1000 * (at + k * every)), round(k * every * rate), 96, k, 128) + struct.pack("<128d", *r.normal(0, 1, 128)) for k in range(n))


def test_clicks_with_measures(spark, tmp_path):
    """Durations by the agreed rate; measures get each file's own rate, or the agreed one where a file has none."""
    d = tmp_path / "c"
    d.mkdir()
    for k in range(2):
        (d / f"x_Click_Detector_Clicks_20240101_0{k}0000.pgdf").write_bytes(_clicks(DAY + 3600 * k))
    (d / "y_Click_Detector_Clicks_20240101_020000.pgdf").write_bytes(_clicks(DAY + 7200, 192_000))
    (d / "z_Click_Detector_Clicks_20240101_030000.pgdf").write_bytes(_clicks(DAY + 10_800, n=1))
    (d / "other_20240101_030000.pgdf").write_bytes(b"12345")
    make = lambda waves, rate: pd.DataFrame({"peak": [max(w) for w in waves], "by": [rate] * len(waves)})
    got = D.clicks(spark, str(d), decode_clicks, wave=False, measure=(make, "peak double, by double"))
    assert got.settings.head()["rate"] == 96_000 and got.settings.head()["n_rate"] == 2
    rows = got.rows.collect()
    assert len(rows) == 121 and got.rows.columns == ["start", "duration", "uid", "file", "peak", "by"]
    assert all(r.duration == pytest.approx(0.001) for r in rows)
    assert {(r.file[0], r.by) for r in rows} == {("x", 96_000.0), ("y", 192_000.0), ("z", 96_000.0)}
    assert len(D.clicks(spark, str(d), decode_clicks).rows.head().wave) == 128


def test_frames_of_annotated_periods(spark, tmp_path):
    """Detections outside periods and files that can't hold any are left out; overlapping periods both count; an event without detections is named."""
    d = tmp_path / "f"
    d.mkdir()
    for k in range(3):
        (d / f"x_Click_Detector_Clicks_20240101_0{k}0000.pgdf").write_bytes(_clicks(DAY + 3600 * k))
    (d / "x_Click_Detector_Clicks_20240102_000000.pgdf").write_bytes(b"never read")
    periods = [("e1", "A", DAY, DAY + 4.05), ("e2", "B", DAY + 3600, DAY + 3602.05), ("e3", "A", DAY + 9000, DAY + 9060), ("e4", "B", DAY + 3601, DAY + 3602.05)]
    a = spark.createDataFrame([(e, x, float(s), float(t)) for e, x, s, t in periods], "event_id string, label string, start double, end double")
    got = D.make_frames(spark, str(d), a, decode_clicks, "click", 1.0, 1.0, fft_len=128)
    c = got.counts.head()
    assert (c.n_detections_read, c.n_detections_annotated) == (120, 40 + 21 + 11)
    assert {r.event_id for r in got.missing.collect()} == {"e3"}
    frames = got.frames.collect()
    assert c.n_frames == len(frames) > 0 and {(r.event_id, r.label) for r in frames} == {("e1", "A"), ("e2", "B"), ("e4", "B")}
    assert {r.label: r.n_frames for r in got.by_label.collect()} == {x: sum(r.label == x for r in frames) for x in "AB"}
    assert got.detections.files.filter("error IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="click or whistle"):
        D.make_frames(spark, str(d), a, decode_clicks, "song", 1.0, 1.0)


def test_frames_of_whistles(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    body = b"".join(whistle(DAY + k * 0.3, 1000 + 56 * k, n=60, uid=k) for k in range(40))
    (d / "A_Contours_20240101_000000.pgdf").write_bytes(body)
    a = spark.createDataFrame([("e1", "A", float(DAY), float(DAY + 20)), ("e2", "B", float(DAY + 50), float(DAY + 60))], "event_id string, label string, start double, end double")
    got = D.make_frames(spark, str(d), a, decode_whistles, "whistle", 4.0, 4.0, rate=96_000)
    assert got.frames.count() > 0 and [r.event_id for r in got.missing.collect()] == ["e2"]
    assert all(abs(sum(r.features) - 1) < 1e-9 for r in got.frames.collect())
