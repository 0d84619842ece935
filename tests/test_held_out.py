"""Held-out predictions at all levels against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from echolith.operators import held_out as H

CLASSES = ["A", "B", "C"]
NAN = float("nan")


def _rows():
    r = random.Random(8)
    out = []
    for k in range(400):
        p = [r.random() for _ in CLASSES]
        p = [x / sum(p) for x in p] if k % 9 else [None, None, None] if k % 2 else [NAN] * 3
        out.append((f"u{k % 7}" if k % 31 else None, k * 37, r.choice([*CLASSES, "other"]) if k % 13 else None, *p))
    return out


def _plain(rows, width):
    """Mean probabilities and the most frequent truth (the least of equals) of windows, blocks and units."""
    groups = defaultdict(list)
    for n, x in enumerate(rows):
        for at in (("window", n), ("block", x[0], x[1] // width * width), ("unit", x[0])):
            groups[at].append(x)
    for at, g in groups.items():
        known = [x[3:] for x in g if x[3] is not None and x[3] == x[3]]
        truths = Counter(x[2] for x in g if x[2] is not None)
        truth = min(truths, key=lambda t: (-truths[t], t)) if truths else None
        yield at[0], truth, len(g), len(known), [sum(p[k] for p in known) / len(known) for k in range(3)] if known else None


def _curve(levels, threshold):
    out = {}
    for level in H.LEVELS:
        n, said = 0, []
        for name, truth, _, _, p in levels:
            if name == level:
                n += 1
                if p:
                    a, b = sorted(p, reverse=True)[:2]
                    if a * (a - b) >= threshold:
                        said.append((truth, CLASSES[p.index(a)]))
        right = [t == s for t, s in said]
        per = [sum(t == s for t, s in said if t == c) / sum(t == c for t, _ in said) for c in CLASSES if any(t == c for t, _ in said)]
        out[level] = (n, len(said) / n, sum(right) / len(right) if right else None, sum(per) / len(per) if per else None)
    return out


def test_levels_and_curve_by_plain_python(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "unit string, t long, truth string, A double, B double, C double")
    want = list(_plain(rows, 1000))
    got = H.evaluate(df, CLASSES, "unit", "t", "truth", 1000, 0.05, [0.0, 0.02, 0.1, 0.9])
    key = lambda level, truth, n, m, p: (level, str(truth), n, m, tuple(round(x, 9) for x in p) if p else None)
    rows_got = got["rows"].collect()
    assert sorted(map(str, (key(r.level, r.truth, r.n_windows, r.n_with_probs, None if r.A is None else [r.A, r.B, r.C]) for r in rows_got))) == sorted(map(str, (key(*w) for w in want)))
    for r in [*got["curve"].collect(), *got["performance"].collect()]:
        n, coverage, accuracy, balanced = _curve(want, r.threshold)[r.level]
        assert (r.n, r.coverage) == (n, pytest.approx(coverage)) and (r.accuracy is None) == (accuracy is None)
        assert accuracy is None or (r.accuracy == pytest.approx(accuracy) and r.balanced_accuracy == pytest.approx(balanced))
    decided = [r for r in rows_got if r.decision not in ("uncertain", "no_data")]
    assert sum(r.n for r in got["confusion"].collect()) == len(decided) and {r.level for r in got["performance"].collect()} == set(H.LEVELS)


def test_no_predictions(spark):
    df = spark.createDataFrame([], "unit string, t long, truth string, A double, B double, C double")
    assert all(x.collect() == [] for x in H.evaluate(df, CLASSES, "unit", "t", "truth", 1000).values())
