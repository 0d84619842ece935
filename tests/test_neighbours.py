"""Neighbour graphs against all pairs, and the map against two components."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.operators import neighbours as N


@pytest.fixture(scope="module")
def units(spark):
    """Groups around centres in eight dimensions, a vector that a third of all units share, and units without vectors."""
    r = np.random.default_rng(3)
    x = r.normal(0, 4, (15, 8))[np.arange(900) % 15] + np.einsum("ni,nij->nj", r.normal(0, 1, (900, 2)), r.normal(0, 1, (15, 2, 8))[np.arange(900) % 15]) + r.normal(0, 0.2, (900, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000 + k, x[7].tolist()) for k in range(450)]
    rows += [(5000, None), (5001, [float("nan")] * 8), (5002, []), (5003, [1.0, None, *[0.0] * 6])]
    return x, spark.createDataFrame(rows, "k long, v array<double>").repartition(5)


def _exact(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def test_recall_of_the_graph(spark, units):
    x, df = units
    got = N.neighbours(df, "k", "v", N.GraphParams(k=10)).collect()
    to, d = _exact(x, 10)
    found = {(r.node, r.neighbour) for r in got}
    assert {r.node for r in got} == set(range(900)) and len(got) == 9000
    assert sum((i, int(j)) in found for i in range(900) for j in to[i]) / 9000 >= 0.95
    assert all(abs(r.distance - d[r.node, r.neighbour]) < 1e-6 for r in got)
    assert all(r.rank <= 10 for r in got)


def test_start_alone_finds_less(spark, units):
    """The rounds of descent find what sorting along random directions does not."""
    x, df = units
    one, _ = N.nodes(df, "k", "v")
    p = N.GraphParams(k=10, directions=1, beside=16)
    to, _ = _exact(x, 10)
    share = lambda e: len({(r.a, r.b) for r in e.collect()} & {(i, int(j)) for i in range(900) for j in to[i]}) / 9000
    first = share(N.best(N._beside(one, p).filter("a <> b"), 10))
    assert first < 0.8 and share(N.graph(one, p)) >= 0.9 > first


def test_few_and_no_units(spark):
    schema = "k long, v array<double>"
    assert N.neighbours(spark.createDataFrame([], schema), "k", "v").collect() == []
    assert N.neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "k", "v").collect() == []
    three = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [3.0])], schema)
    want = [(1, 2, 1, 1.0), (1, 3, 2, 3.0), (2, 1, 1, 1.0), (2, 3, 2, 2.0), (3, 1, 2, 3.0), (3, 2, 1, 2.0)]
    assert sorted((r.node, r.neighbour, r.rank, r.distance) for r in N.neighbours(three, "k", "v").collect()) == want


def test_weights_by_their_definition(spark):
    """Memberships of a node sum to log2 of its neighbours; both directions join as probabilities."""
    d = np.array([[1.0, 2, 3, 4], [0.5, 0.5, 0.6, 9], [2, 2, 2, np.nan]])
    near, scale = N._sharpness(d)
    sums = np.nansum(np.exp(-(d - near[:, None]) / scale[:, None]), axis=1)
    assert sums[:1] == pytest.approx([2.0], abs=1e-6) and sums[1] == pytest.approx(2.0, abs=0.01)
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (3, 1, 2.0), (3, 2, 5.0)], "a long, b long, d double")
    got = {(r.a, r.b): r.w for r in N.fuzzy(edges).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == pytest.approx(1.0) and 0 < got[2, 3] < 1


def _kept(x, y, k=10):
    a, b = _exact(x, k)[0], _exact(y, k)[0]
    return np.mean([len(set(i) & set(j)) / k for i, j in zip(a.tolist(), b.tolist(), strict=True)])


@pytest.mark.parametrize("landmarks", [2000, 200])
def test_map_keeps_neighbours(spark, units, monkeypatch, landmarks):
    """Better than two components, also where most units are beyond the landmarks; equal vectors share a place."""
    monkeypatch.setattr(N, "LANDMARKS", landmarks)
    x, df = units
    got = {r.k: (r.x, r.y) for r in N.neighbour_map(df, "k", "v", N.GraphParams(k=10), N.MapParams(start=150, steps=12)).collect()}
    assert set(got) == {*range(900), *range(2000, 2450)} and all(got[k] == got[7] for k in range(2000, 2450))
    y = np.array([got[k] for k in range(900)])
    assert np.isfinite(y).all()
    z = x - x.mean(0)
    assert _kept(x, y) > _kept(x, z @ np.linalg.svd(z, full_matrices=False)[2][:2].T) + 0.02


def test_map_of_few(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k long, v array<double>")
    assert [(r.k, np.isfinite(r.x)) for r in N.neighbour_map(one, "k", "v").collect()] == [(1, True)]
    assert N.neighbour_map(one.filter(F.lit(False)), "k", "v").collect() == []


def test_one_shuffle_finds_the_nearest_and_the_new(spark):
    """Edges of a node meet once, where equal ones are one, are ranked, and keep whether they were known."""
    rows = [(1, 2, 0.5, True), (1, 2, 0.4, False), (1, 3, 0.4, False), (1, 4, 0.9, True), (2, 1, 0.5, True)]
    found = N.best(spark.createDataFrame(rows, "a long, b long, d double, known boolean"), 2)
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0.4, True), (1, 3, 0.4, False), (2, 1, 0.5, True)]
    plan = N.best(spark.range(9).selectExpr("id a", "id b", "0D d"), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_packed_vectors_and_pushes(spark):
    """Packed vectors are the vectors; pushes are those of the places drawn, added one by one."""
    r = np.random.default_rng(5)
    one = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r.normal(size=(40, 3)))], "node long, vector array<double>").repartition(3)
    along = r.normal(size=(3, 2))
    want = {x.node: np.array(x.vector) for x in one.collect()}
    for x in N._packed(one, along).collect():
        assert np.array_equal(np.frombuffer(x.vector), want[x.node]) and x.along == pytest.approx(list(want[x.node] @ along))
    y = one.select("node", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))
    some = y.orderBy(F.xxhash64("node", F.lit(9)), "node").limit(N.PUSHED).collect()
    draws = {x.node: x.d for x in y.select("node", F.array(*(F.pmod(F.xxhash64("node", F.lit(9), F.lit(k)), F.lit(40)) for k in range(N.PUSHES))).alias("d")).collect()}
    for x in N._pushed(y, 9).collect():
        q = np.zeros(2)
        for k in draws[x.node]:
            e = np.array([x.x - some[k].x, x.y - some[k].y])
            e2 = float(e @ e)
            q += np.clip(2 * N.CURVE_B / ((0.001 + e2) * (1 + N.CURVE_A * e2**N.CURVE_B)) * e, -4, 4) * 5 / N.PUSHES
        assert (x.qx, x.qy) == pytest.approx(tuple(q))
    assert N._pushed(y.filter("node < 0"), 9).collect() == []
