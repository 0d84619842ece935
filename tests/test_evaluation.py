"""Scores, folds, examples and merged detectors against computed cases."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.operators import detectors, evaluation


def test_adjusted_information_by_permutations():
    a, b = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 0, 1, 1, 1, 0])

    def mutual(x, y):
        t = np.zeros((3, 2))
        np.add.at(t, (x, y), 1)
        return evaluation.adjusted_information(t)

    m, chance, adjusted = mutual(a, b)
    every = [mutual(a, np.array(p))[0] for p in itertools.permutations(b)]
    assert chance == pytest.approx(np.mean(every))
    entropy = [-sum(c / 6 * math.log(c / 6) for c in np.bincount(x)) for x in (a, b)]
    assert adjusted == pytest.approx((m - chance) / (np.mean(entropy) - chance))
    assert evaluation.adjusted_information(np.diag([4.0, 3.0]))[2] == pytest.approx(1)
    assert evaluation.adjusted_information(np.array([[5.0]]))[2] == 1


def test_expected_information_of_many_rows():
    # the cut at 14 deviations changes nothing that doubles show
    whole = evaluation._expected(300, 400, 1000)
    c = np.arange(1, 301)
    p = [math.exp(math.lgamma(301) + math.lgamma(401) + math.lgamma(701) + math.lgamma(601) - math.lgamma(1001) - sum(math.lgamma(v + 1) for v in (k, 300 - k, 400 - k, 300 + k))) for k in c]
    assert whole == pytest.approx(float((np.array(p) * c / 1000 * np.log(1000 * c / 120_000)).sum()), abs=1e-12)
    assert abs(evaluation._expected(10**9, 10**9, 4 * 10**9)) < 1e-6


def test_mutual_information_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (1, "a")], "c int, l string")
    assert evaluation.mutual_information(df, "c", "l").collect()[0].adjusted is None
    assert evaluation.mutual_information(df.limit(0), "c", "l").collect() == []
    df = spark.createDataFrame([(k % 3, f"x{k % 3}") for k in range(12)], "c int, l string")
    assert evaluation.mutual_information(df, "c", "l").collect()[0].adjusted == pytest.approx(1)


def test_silhouettes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    x[7] = 0
    c = rng.integers(0, 3, 40)
    c[3] = 9
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    far = 1 - u @ u.T
    np.fill_diagonal(far, 0)

    def brute(far):
        out = []
        for i in range(40):
            own = [j for j in range(40) if c[j] == c[i] and j != i]
            a = far[i][own].mean() if own else 0
            b = min(far[i][c == k].mean() for k in set(c) if k != c[i])
            out.append((b - a) / max(a, b) if own else 0)
        return out

    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(40)], "id long, v array<double>, c int")
    got = {r.id: r.silhouette for r in evaluation.silhouettes(df, "id", "v", "c").collect()}
    assert [got[i] for i in range(40)] == pytest.approx(brute(far))
    one = evaluation.silhouettes(df.filter("c = 1"), "id", "v", "c")
    assert {r.silhouette for r in one.collect()} == {0.0}
    assert evaluation.silhouettes(df.limit(0), "id", "v", "c").collect() == []
    z = (x - x.mean(0)) / x.std(0)
    wide = df.selectExpr("c", *(f"v[{k}] AS f{k}" for k in range(5)))
    s = evaluation.label_silhouette(wide, [f"f{k}" for k in range(5)], "c").collect()[0]
    assert s.silhouette == pytest.approx(np.mean(brute(np.sqrt(((z[:, None] - z) ** 2).sum(2)))))


def test_class_scores_count_missing_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "a"), ("b", "b"), ("b", "z"), (None, "a")], "t string, p string")
    s = evaluation.class_scores(df, "t", "p")
    got = {r.label: (r.n, r.n_predicted, r.n_correct) for r in s.collect()}
    assert got == {"a": (2, 2, 1), "b": (3, 1, 1)}
    h = evaluation.headline(s).collect()[0]
    assert h.n == 5 and h.balanced_accuracy == pytest.approx((1 / 2 + 1 / 3) / 2) and h.skill == pytest.approx(2 * h.balanced_accuracy - 1)


def test_balanced_folds(spark):
    rows = [(f"g{g}", "a" if (g + k) % 3 else "b") for g in range(30) for k in range(g % 7 + 1)]
    df = spark.createDataFrame(rows, "g string, l string")
    folds = {r.g: r.fold for r in evaluation.balanced_folds(df, "l", "g", 3).collect()}
    assert set(folds) == {g for g, _ in rows} and set(folds.values()) == {0, 1, 2}
    for label in "ab":
        n = [sum(x == label and folds[g] == k for g, x in rows) for k in range(3)]
        assert max(n) - min(n) <= 3


def test_balanced_folds_of_any_number_of_groups(spark):
    df = spark.range(63_000).selectExpr("id % 21000 AS g", "IF(id % 5 = 0, 'a', 'b') AS l")
    got = df.join(evaluation.balanced_folds(df, "l", "g", 3), "g").groupBy("fold", "l").agg(F.count("*").alias("n"), F.countDistinct("g").alias("groups")).collect()
    for label in "ab":
        n = [r.n for r in got if r.l == label]
        assert len(n) == 3 and max(n) - min(n) <= 6
    assert sum(r.n for r in got) == 63_000
    small = spark.createDataFrame([(f"g{g}", "a" if (g + k) % 3 else "b") for g in range(30) for k in range(g % 7 + 1)], "g string, l string")
    folds = {r.g: r.fold for r in evaluation.balanced_folds(small, "l", "g", 3, 4).collect()}
    assert len(folds) == 30 and set(folds.values()) == {0, 1, 2}


def test_typical_units_do_not_overlap(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(-1, 3)), float(rng.integers(0, 9)), int(s := rng.integers(0, 40)), int(s) + 6) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, c int, d double, s long, e long")
    got = {}
    for r in evaluation.typical(df, "c", "id", "d", "s", "e", 4).orderBy("c", "rank").collect():
        got.setdefault(r.c, []).append(r.id)
    for c in (0, 1, 2):
        want = []
        for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0])):
            if len(want) < 4 and all(not (r[3] < p[4] and p[3] < r[4]) for p in want):
                want.append(r)
        assert got[c] == [r[0] for r in want]
    assert set(got) == {0, 1, 2}


def test_merged_detectors(spark):
    a = spark.createDataFrame([(1, 0.8, 0.2, 3, None, None), (2, 0.9, 0.1, 1, "x < 1", "q"), (3, 0.5, 0.5, 1, None, None)], "k int, A double, B double, n int, rule string, rule_decision string")
    w = spark.createDataFrame([(1, 0.6), (4, 0.9)], "k int, A double")
    out = {r.k: r for r in detectors.merge_blocks({"x": a, "y": w}, ["k"], ["A", "B"], {"x": {"A": 0.4, "B": 0.6}, "y": {"A": 0.5}}, min_score=0.01).collect()}
    p = 2.0 * 1.2 / (2.0 * 1.2 + 0.2 / 0.6)
    assert out[1].A == pytest.approx(p) and out[1].decision == "A" and (out[1].n_x, out[1].n_y) == (3, 1)
    assert out[2].decision == "q" and out[2].rule == "x: x < 1" and out[2].A is None and out[2].path == ""
    assert out[3].decision == "uncertain" and (out[4].A, out[4].B) == (0.9, 0.0) and out[4].n_x == 0
    child = spark.createDataFrame([(1, "A1", "A1"), (3, "B1", "B1"), (4, "uncertain", "")], "k int, decision string, path string")
    parent = detectors.merge_blocks({"x": a, "y": w}, ["k"], ["A", "B"], {"x": {"A": 0.4, "B": 0.6}, "y": {"A": 0.5}}, min_score=0.01)
    deep = {r.k: (r.decision, r.path) for r in detectors.deepen(parent, child, ["k"], "A").collect()}
    assert deep == {1: ("A1", "A > A1"), 2: ("q", ""), 3: ("uncertain", ""), 4: ("A", "A")}


def test_merged_held_out(spark):
    a = spark.createDataFrame([("u", 0, "A", 0.8, 0.2), ("u", 0, "B", 0.6, 0.4)], "u string, k int, t string, A double, B double")
    w = spark.createDataFrame([("u", 0, "B", 0.5, 0.5), ("v", 1, "B", None, None)], "u string, k int, t string, A double, B double")
    out = {r.u: r for r in detectors.merge_held_out({"x": a, "y": w}, "u", "k", "t", ["A", "B"], {"x": {"A": 0.5, "B": 0.5}, "y": {"A": 0.5, "B": 0.5}}).collect()}
    assert out["u"].truth == "B" and out["u"].A == pytest.approx(0.7) and out["u"].n_x == 2
    assert out["v"].A is None and out["v"].n_y == 0 and out["v"].decision == "no_detections"


def test_decision_windows_by_plain_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{k % 3}", int(t), str(y), str(p)) for k, (t, y, p) in enumerate(zip(rng.integers(0, 7_200_000_000, 300), rng.choice(["X", "Y", "Z"], 300), rng.choice(["X", "Y", "uncertain", "Z"], 300), strict=True))]
    df = spark.createDataFrame(rows, "d string, t long, y string, p string")
    got = {(r.decision_window, r["class"]): r for r in evaluation.decision_windows(df, "d", "t", "y", "p", ("X", "Y"), [10]).collect()}
    assert set(w for w, _ in got) == {"window", "10min"}
    held = [(d, t, y, p) for d, t, y, p in rows if y in "XY"]
    blocks = {}
    for d, t, y, p in held:
        blocks.setdefault((d, t // 600_000_000), []).append((y, p))
    voted = []
    for b in blocks.values():
        said = [p for _, p in b if p in ("X", "Y")]
        most = [v for v in ("X", "Y") if 2 * said.count(v) > len(said)]
        ys = [y for y, _ in b]
        voted.append(("X" if ys.count("X") >= ys.count("Y") else "Y", most[0] if most else None))
    for w, rs in (("window", [(y, p if p in ("X", "Y") else None) for *_, y, p in held]), ("10min", voted)):
        gains, recalls, f1s = [], [], []
        for v in ("X", "Y"):
            n, dec, right, said = sum(y == v for y, _ in rs), sum(y == v and p is not None for y, p in rs), sum(y == p == v for y, p in rs), sum(p == v for _, p in rs)
            r = got[w, v]
            assert (r.n_blocks, r.skill) == (n, None)
            assert (r.coverage, r.recall, r.precision, r.accuracy_when_predicted) == pytest.approx((dec / n, right / n, right / said, right / dec))
            f1s.append(2 * right / (n + said))
            assert r.f1 == pytest.approx(f1s[-1])
            recalls.append(right / n)
            gains.append(right / n + (1 - dec / n) / 2)
        o = got[w, "overall"]
        assert o.n_blocks == len(rs) and o.recall == pytest.approx(np.mean(recalls)) and o.f1 == pytest.approx(np.mean(f1s)) and o.skill == pytest.approx(2 * np.mean(gains) - 1)
    empty = {(r.decision_window, r["class"]): r for r in evaluation.decision_windows(df.filter("y = 'X' AND p = 'uncertain'"), "d", "t", "y", "p", ("X", "Y"), [10]).collect()}
    assert empty["window", "overall"].skill == 0 and empty["window", "Y"].recall is None and empty["10min", "X"].precision is None
