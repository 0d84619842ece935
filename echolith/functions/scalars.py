"""Column functions: scores, decisions, time keys, array transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def floor_to(t: Column, width: int) -> Column:
    """Start of the clock-aligned interval of the given width that holds t (integers)."""
    return t - F.pmod(t, F.lit(width))


def day_of(t_us: Column) -> Column:
    """UTC day as YYYYMMDD."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t_us / (86_400 * US)).cast("int")), "yyyyMMdd")


def known(x: Column) -> Column:
    """x as a double, null where it is NaN: Spark ranks NaN above all numbers."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def top_two(probs: list[Column]) -> tuple[Column, Column]:
    """Greatest and second greatest; the second is 0 with one class; NaN is as null; null where all are null."""
    order = F.sort_array(F.filter(F.array(*map(known, probs)), lambda x: x.isNotNull()), asc=False)
    first = F.get(order, F.lit(0))
    return first, F.when(first.isNotNull(), F.coalesce(F.get(order, F.lit(1)), F.lit(0.0)))


def decision_score(probs: list[Column]) -> Column:
    p1, p2 = top_two(probs)
    return p1 * (p1 - p2)


def argmax_class(probs: list[Column], classes: list[str]) -> Column:
    """The first class with the greatest probability; NaN is as null; null where all are null."""
    best = F.array_max(F.array(*map(known, probs)))
    return F.coalesce(*(F.when(known(p) == best, F.lit(c)) for p, c in zip(probs, classes, strict=True)))


def decide(probs: list[Column], classes: list[str], min_score: float) -> Column:
    """Class, ``uncertain`` under the score, ``no_data`` where there is no probability."""
    score = decision_score(probs)
    return F.when(score.isNull(), "no_data").when(score < min_score, "uncertain").otherwise(argmax_class(probs, classes))


def merge_evidence(by_detector: list[list[Column]], bases: list[list[float | None]], weights: list[float] | None = None) -> list[Column]:
    """Classes of blocks by the evidence of all detectors: products of (p / base)^weight, normalised in logarithms.

    Each detector has its own bases; a class without a base or probability there
    is neutral. A lone detector's probabilities stay as they are, 0 for classes
    that it does not know; null where no detector has any. NaN is as null.
    """
    by_detector = [[known(p) for p in d] for d in by_detector]
    weights = weights or [1.0] * len(by_detector)
    has = [reduce(lambda a, b: a | b, [c.isNotNull() for c in d]) for d in by_detector]
    n = reduce(lambda a, b: a + b, [h.cast("int") for h in has])
    logs, lone = [], []
    for k in range(len(by_detector[0])):
        rated = [(d[k], b[k], w) for d, b, w in zip(by_detector, bases, weights, strict=True) if b[k] is not None]
        parts = [F.when(p.isNotNull(), F.lit(float(w)) * F.ln(F.greatest(p, F.lit(1e-9)) / F.lit(b))).otherwise(F.lit(0.0)) for p, b, w in rated]
        logs.append(reduce(lambda x, y: x + y, parts, F.lit(0.0)))
        lone.append(F.coalesce(*(F.when(h, F.coalesce(d[k], F.lit(0.0))) for h, d in zip(has, by_detector, strict=True))))
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    total = reduce(lambda x, y: x + y, exps)
    return [F.when(n == 1, p).when(n > 1, e / total) for p, e in zip(lone, exps, strict=True)]


def smooth(x: Column, width: int) -> Column:
    """Trailing moving average, shorter at the start."""
    return F.transform(x, lambda _, i: F.aggregate(F.slice(x, F.greatest(i - (width - 2), F.lit(1)), F.least(i + 1, F.lit(width))), F.lit(0.0), lambda a, v: a + v) / F.least(i + 1, F.lit(width)))


def downsample(x: Column, k: int) -> Column:
    """Block means; the last block may be short."""
    starts = F.sequence(F.lit(1), F.size(x), F.lit(k))
    part = lambda i: F.slice(x, i, k)
    return F.transform(starts, lambda i: F.aggregate(part(i), F.lit(0.0), lambda a, v: a + v) / F.size(part(i)))


def trim(x: Column, low: int, high: int) -> Column:
    """Elements low (inclusive) to high (exclusive), from 0."""
    return F.slice(x, low + 1, high - low)


def normalise_sum(x: Column) -> Column:
    """x by its sum; null where the sum is 0."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return F.when(total != 0, F.transform(x, lambda v: v / total))


def rule_chain(rules: list[tuple[str, str, float, str]], default: Column) -> Column:
    """First rule (column, comparison, value, decision) that holds; nulls and values that are not finite never match."""
    ops = {"<": "<", "<=": "<=", ">": ">", ">=": ">=", "==": "=", "!=": "<>"}
    out = None
    for col, op, value, then in rules:
        test = F.expr(f"`{col}` {ops[op]} {value!r} AND abs(CAST(`{col}` AS DOUBLE)) < CAST('Infinity' AS DOUBLE)")
        out = F.when(test, F.lit(then)) if out is None else out.when(test, F.lit(then))
    return default if out is None else out.otherwise(default)
