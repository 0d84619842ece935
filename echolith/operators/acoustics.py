"""Signal features in numpy behind Arrow: contour shapes, click and whistle spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The measures' names.
CONTOUR = (
    "duration_s start_freq_hz end_freq_hz min_freq_hz max_freq_hz freq_range_hz mean_freq_hz std_freq_hz freq_at_quarter_hz freq_at_half_hz freq_at_threequarter_hz"
    " time_of_min_freq_rel time_of_max_freq_rel overall_slope_hz_s linreg_slope_hz_s quad_curvature mean_abs_slope_hz_s std_slope_hz_s frac_up frac_down n_inflections inflections_per_s"
).split()


def contour_measures(t: np.ndarray, f: np.ndarray, slice_s: float) -> list[float]:
    """Shape of one contour; deviations are of the population, quarter points are rounded half to even."""
    n, span = len(t), float(t[-1] - t[0])
    long = span + slice_s
    q = [float(f[int(np.rint(p * (n - 1)))]) for p in (0.25, 0.5, 0.75)]
    rel = lambda i: (float(t[i]) - t[0]) / span if span else 0.0
    steps, dt = np.diff(f), np.diff(t)
    slopes = steps[dt > 0] / dt[dt > 0]
    line = float(np.polyfit(t - t[0], f, 1)[0]) if n > 2 else 0.0
    quad = float(np.polyfit(t - t[0], f, 2)[0]) if n > 3 else 0.0
    signs = np.sign(slopes)
    turns = signs[signs != 0]
    inflections = int((turns[1:] != turns[:-1]).sum())
    share = lambda m: float(m.mean()) if len(m) else 0.0
    return [
        long, float(f[0]), float(f[-1]), float(f.min()), float(f.max()), float(f.max() - f.min()), float(f.mean()), float(f.std()), *q,
        rel(int(f.argmin())), rel(int(f.argmax())), (float(f[-1]) - float(f[0])) / long if long else 0.0, line, quad,
        share(np.abs(slopes)), float(slopes.std()) if len(slopes) else 0.0, share(slopes > 0), share(slopes < 0), float(inflections), inflections / long if long else 0.0,
    ]


def contour_column(times: str, freqs: str, slice_s: str, fmin: float = 800.0, fmax: float = 16_000.0, least_s: float = 0.4) -> Column:
    """Struct of the measures of a contour clipped to a band; null with fewer than three points or too short."""

    @F.pandas_udf(", ".join(f"{c} double" for c in CONTOUR))
    def of(times: pd.Series, freqs: pd.Series, slices: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f, s in zip(times, freqs, slices, strict=True):
            t, f = np.asarray(t, float), np.asarray(f, float)
            on = (f >= fmin) & (f <= fmax)
            t, f = t[on], f[on]
            rows.append(contour_measures(t, f, s) if len(t) >= 3 and t[-1] - t[0] + s >= least_s else [None] * len(CONTOUR))
        return pd.DataFrame(rows, columns=list(CONTOUR))

    return of(times, freqs, slice_s)


def power_spectrum(waves: np.ndarray, fft_len: int, hann: bool = False) -> np.ndarray:
    """First half of the power spectrum of waves cut or padded at the end to fft_len."""
    w = waves[:, :fft_len]
    return np.abs(np.fft.rfft(w * np.hanning(w.shape[1]) if hann else w, fft_len, axis=1))[:, : fft_len // 2] ** 2


def click_spectrum_column(waves: str, fft_len: int = 512) -> Column:
    """Mean over clicks of 20 log10 of the power, less its minimum; null where a power is 0. waves: array of arrays."""

    @F.pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            width = max((len(w) for w in r), default=0)
            x = np.zeros((len(r), max(width, 1)))
            for k, w in enumerate(r):
                x[k, : len(w)] = w
            power = power_spectrum(x, fft_len)
            level = 20 * np.log10(power).mean(0) if len(r) and (power > 0).all() else None
            out.append(None if level is None else (level - level.min()).tolist())
        return pd.Series(out)

    return of(waves)


def band_edges(low: float, high: float, per_octave: int) -> list[float]:
    """Edges of base-2 fractional octave bands whose centres, counted from 1 kHz, lie within half a band of low to high."""
    first = int(np.ceil(per_octave * np.log2(low / 1000) - 0.5 - 1e-9))
    last = int(np.floor(per_octave * np.log2(high / 1000) + 0.5 + 1e-9))
    return [float(1000 * 2 ** ((k - 0.5) / per_octave)) for k in range(first, last + 2)]


def profile_names(rate: float, low: float = 5000.0, high: float | None = None, bands: int = 16) -> list[str]:
    edges = np.linspace(low, min(high or rate / 2, rate / 2), bands + 1).astype(int)
    return [f"csp_{a}_{b}" for a, b in zip(edges, edges[1:])]


def click_measures(wave: np.ndarray, rate: float, low: float, high: float, bands: int, samples: int, fft_len: int) -> list[float] | None:
    """Peak, centroid, widths at -3 and -10 dB and band shares of one click, cut around its greatest swing; None without power."""
    if not len(wave):
        return None
    start = min(int(np.abs(wave).argmax()) - samples // 2, len(wave) - samples)
    cut = wave[max(start, 0) : max(start, 0) + samples]
    cut = cut - cut.mean()
    power = np.abs(np.fft.rfft(cut * np.hanning(len(cut)) if len(cut) > 1 else cut, max(fft_len, samples))) ** 2
    hz = np.fft.rfftfreq(max(fft_len, samples), 1 / rate)
    on = (hz >= low) & (hz <= high)
    power, hz = power[on], hz[on]
    total = power.sum()
    if not total > 0:
        return None
    top = int(power.argmax())
    widths = []
    for part in (0.5, 0.1):
        under = np.flatnonzero(power < part * power[top])
        before, after = under[under < top], under[under > top]
        inside = (after[0] if len(after) else len(power)) - (before[-1] if len(before) else -1) - 1
        widths.append(float(inside * (hz[1] - hz[0])) if len(hz) > 1 else float("nan"))
    band = np.clip(np.searchsorted(np.linspace(low, high, bands + 1), hz, side="right") - 1, 0, bands - 1) if bands else []
    shares = np.bincount(band, power, bands) / total if bands else []
    return [float(hz[top]), float((power * hz).sum() / total), *widths, *(float(v) for v in shares)]


def click_measures_column(wave: str, rate: float, low: float = 5000.0, high: float | None = None, bands: int = 16, samples: int = 128, fft_len: int = 256) -> Column:
    """Struct of peak_hz, centroid_hz, bw3_hz, bw10_hz and the shares of the bands; all null without power."""
    top = min(high or rate / 2, rate / 2)
    names = ["peak_hz", "centroid_hz", "bw3_hz", "bw10_hz", *profile_names(rate, low, high, bands)]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def of(waves: pd.Series) -> pd.DataFrame:
        rows = [click_measures(np.asarray(w if w is not None else [], float), rate, low, top, bands, samples, fft_len) for w in waves]
        return pd.DataFrame([r or [None] * len(names) for r in rows], columns=names, dtype=float)

    return of(wave)


def click_level_column(wave: str, fft_len: int = 512) -> Column:
    """20 log10 of the power of each bin of one click; an empty place where the power is 0."""

    @F.pandas_udf("array<double>")
    def of(waves: pd.Series) -> pd.Series:
        out = []
        for w in waves:
            w = np.asarray(w if w is not None else [], float)
            power = power_spectrum((w if len(w) else np.zeros(1))[None], fft_len)[0]
            out.append([float(20 * np.log10(p)) if p > 0 else None for p in power])
        return pd.Series(out)

    return of(wave)
