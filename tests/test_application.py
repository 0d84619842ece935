"""Library application and held-out verdicts against hand-computed and plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echolith.operators import application as A
from echolith.operators import clusters, discovery

KIND = A.Task("kind", ("A", "B"))


def _votes(spark, windows, calls, **how):
    w = spark.createDataFrame(windows, "w_start long, w_end long, cluster long, kind_pred string")
    c = spark.createDataFrame(calls, "contour_id long, start long, end long, mean_freq_hz double, duration_s double")
    return {r.block_start: r for r in A.block_votes(w, c, [KIND], 100, 50, **how).collect()}


def test_block_votes(spark):
    windows = [(0, 40, 1, "A"), (30, 70, 1, "A"), (60, 100, 2, "B"), (100, 140, 2, "B"), (150, 190, -1, "uncertain"), (210, 250, 1, "A"), (220, 260, 2, "B")]
    calls = [(1, 10, 20, 1000.0, 1.0), (2, 35, 65, 3000.0, 3.0), (3, 95, 120, 2000.0, 2.0), (4, 500, 510, 9.0, 9.0)]
    got = _votes(spark, windows, calls, period=(0, 400))
    assert [got[k].kind for k in (0, 100, 200, 300)] == ["A", "B", "uncertain", "no_detections"]
    first = got[0]
    assert (first.n_windows, first.n_assigned, first.n_contours, first.cluster_votes, first.block_end) == (3, 3, 3, "1:2;2:1", 100)
    assert (first.block_meanfreq_range_hz, first.block_median_contour_s, first.kind_vote_share) == (2000.0, 2.0, pytest.approx(2 / 3))
    assert (got[100].n_assigned, got[100].n_contours, got[300].n_windows, got[300].raw_kind) == (1, 1, 0, "no_detections")
    ruled = _votes(spark, windows, calls, rules=[("block_meanfreq_range_hz", ">", 1500.0, "B"), ("n_contours", "==", 1.0, "A")])
    assert [(ruled[k].kind, ruled[k].raw_kind, ruled[k].rule) for k in (0, 100, 200)] == [("B", "A", "block_meanfreq_range_hz > 1500"), ("A", "B", "n_contours == 1"), ("uncertain", "uncertain", None)]
    middle = _votes(spark, windows, calls, by="midpoint")
    assert middle[0].n_contours == 2 and middle[100].n_contours == 1
    assert _votes(spark, [], []) == {} and {r.kind for r in _votes(spark, [], [], period=(0, 150)).values()} == {"no_detections"}


def test_requires_reads_earlier_changes(spark):
    tasks = [A.Task("a", ("x", "y")), A.Task("b", ("x", "y")), A.Task("c", ("x", "y"))]
    w = spark.createDataFrame([(0, 10, 1, "y", "x", "x")], "w_start long, w_end long, cluster long, a_pred string, b_pred string, c_pred string")
    c = spark.createDataFrame([], "contour_id long, start long, end long, mean_freq_hz double, duration_s double")
    r = A.block_votes(w, c, tasks, 100, 50, requires={"b": ("a", "x"), "c": ("b", "x")}).head()
    assert (r.a, r.b, r.c, r.raw_c) == ("y", "n/a", "n/a", "x")


def _rows(seed):
    rng = random.Random(seed)
    out = []
    for k in range(900):
        c = rng.choice([-1, 0, 0, 0, 1, 1, 2, 3])
        label = rng.choice({0: "AAAAAAAAAAB", 1: "ABBB", 2: "ABC", 3: "BCC", -1: "AB"}[c] + ("" if k % 3 else "?"))
        out.append((k, c, f"2024010{rng.choice('1112234')}", None if label == "?" else label))
    return out + [(1000 + k, 4, "20240105", "AB"[k % 2]) for k in range(30)] + [(2000, 0, "20240106", None)]


def test_base_rate_caps_over_clusters(spark):
    rows = [(c, "d1", True) for c in (0, 1, 2) for _ in range(40)] + [(0, "d2", False)] * 30
    df = spark.createDataFrame(rows, "c int, u string, y boolean")
    got = clusters.binary_verdicts(df, "c", "u", "y", cap=50).collect()
    assert {r.base for r in got} == {50 / 80} and {(r.c, r.k) for r in got} == {(0, 40), (1, 40), (2, 40)}
    assert {(r.c, r.years_yes, r.years_no) for r in got} == {(0, 1, 1), (1, 1, 0), (2, 1, 0)}


def test_left_out_verdicts_are_those_without_the_unit(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "k long, c int, u string, y string").withColumn("yes", F.when(F.col("y").isin("A", "B"), F.col("y") == "A"))
    got = {r.k: r.predicted for r in A.left_out_predictions(df, "c", "u", "y", ("A", "B"), cap=20, min_units=2).collect()}
    want = {}
    for u in sorted({r[2] for r in rows}):
        rest = clusters.binary_verdicts(df.filter(F.col("u") != u), "c", "u", "yes", cap=20, min_units=2).collect()
        said = {r.c: {"yes": "A", "no": "B"}.get(r.verdict, r.verdict) for r in rest}
        want.update({k: said.get(c, "uncertain") for k, c, unit, y in rows if unit == u and y in ("A", "B")})
    assert got == want and {"A", "B", "uncertain"} == set(got.values())
    by = A.left_out_by_unit(A.left_out_predictions(df, "c", "u", "y", ("A", "B"), cap=20), "u", "y").collect()
    assert sum(r.n for r in by) == len(got) and all(";" in r.true_labels for r in by)
    lone = df.filter("u = '20240101' OR y = 'A'")  # B occurs on one day only
    assert {r.u for r in A.left_out_predictions(lone, "c", "u", "y", ("A", "B")).collect()} == {r[2] for r in rows if r[3] == "A"} - {"20240101"}


def test_left_out_probabilities(spark):
    """A plain version counts each unit's rest anew."""
    rows, cap, prior, classes = _rows(5), 15, 10.0, ["A", "B", "C"]
    df = spark.createDataFrame(rows, "k long, c int, u string, y string")
    got = {r.k: (r.p_A, r.p_B, r.p_C) for r in A.left_out_probabilities(df, "c", "u", "y", classes, cap).collect()}

    def capped(part):
        n = Counter((u, y) for _, _, u, y in part)
        return [sum(min(v, cap) for (_, y), v in n.items() if y == c) for c in classes]

    seen = 0
    for u in sorted({r[2] for r in rows}):
        rest = [r for r in rows if r[2] != u]
        lab = [r for r in rest if r[1] >= 0 and r[3] in classes]
        total = capped(lab)
        weight = [sum(total) / 3 / t for t in total]
        for k, c, _, _ in (r for r in rows if r[2] == u and r[3] in classes):
            if c < 0 or not any(r[1] == c for r in rest):
                assert got[k] == (None, None, None)
                continue
            a = [x * w + prior / 3 for x, w in zip(capped([r for r in lab if r[1] == c]), weight, strict=True)]
            assert got[k] == pytest.approx([x / sum(a) for x in a])
            seen += 1
    assert seen > 500 and len(got) == sum(r[3] in classes for r in rows)


def test_shares_across_clusters(spark):
    rows = [(c, "u1", "A") for c in (0, 1) for _ in range(10)] + [(0, f"u{k}", "B") for k in range(10)]
    df = spark.createDataFrame(rows, "c int, u string, y string")
    weights = {r.y: r.weight for r in discovery.class_shares(df, "c", "u", "y", 10, across=True).collect()}
    assert weights == {"A": 1.0, "B": 1.0}
    weights = {r.y: r.weight for r in discovery.class_shares(df, "c", "u", "y", 10).collect()}
    assert weights == {"A": 0.75, "B": 1.5}
