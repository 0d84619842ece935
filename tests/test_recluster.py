"""Weighted clusters and their test without each unit, on separable cases."""

from __future__ import annotations

import numpy as np
import pytest

from echolith.operators import models, recluster
from echolith.sources import sinks


def _blobs(units=4, per=12, seed=3):
    """Three classes told apart by two of six features; every unit has all of them."""
    rng = np.random.default_rng(seed)
    centres = np.array([[4, 0], [-4, 4], [-4, -4]])
    rows = []
    for u in range(units):
        for c in range(3):
            for k in range(per):
                rows.append((len(rows), f"u{u}", c * 4 + k // 3, np.concatenate([centres[c] + rng.normal(0, 0.5, 2), rng.normal(0, 1, 4)]), f"c{c}"))
    return rows


P = recluster.HybridParams(cut=0.5, least=10, trees=40)


def test_importance_is_of_the_splits():
    rng = np.random.default_rng(0)
    x = rng.random((200, 4)).astype(np.float32)
    y = (x[:, 2] > 0.5).astype(int)
    forest = [models.grow(x, y, 2, np.random.default_rng(k), 4, 2) for k in range(3)]
    assert models.importance(forest, 4) == pytest.approx([0, 0, 1, 0])
    assert models.importance([], 4) == pytest.approx([0.25] * 4)


def test_weighted_clusters():
    rows = _blobs()
    x, label = np.stack([r[3] for r in rows]), np.array([r[4] for r in rows], object)
    blocks = np.array([f"{r[1]}@{r[2]}" for r in rows])
    w = recluster.label_weights(x, label, P)
    assert w[:2].min() > w[2:].max()
    got, frozen = recluster.cluster(x, label, blocks, P)
    assert set(got) <= {-1, 0, 1, 2} and (got >= 0).mean() > 0.85
    for c in range(3):
        assert len(set(label[got == c])) == 1
    again = frozen.assign(x)
    assert (again[got >= 0] == got[got >= 0]).all()
    assert frozen.assign(np.full((1, 6), 90.0) * [1, -1, 1, -1, 1, -1]).tolist() == [-1]
    assert recluster.label_weights(x, np.full(len(x), None, object), P).tolist() == [1] * 6


def test_hybrid_clusters(spark):
    df = spark.createDataFrame([(i, u, b, v.tolist(), c if i % 3 else None) for i, u, b, v, c in _blobs()], "id long, u string, b int, v array<double>, c string")
    out = recluster.hybrid_clusters(df, "id", "v", "c", "u", P)
    assert out.count() == 144 and out.filter("cluster >= 0").select("cluster").distinct().count() == 3


def test_left_out_units_are_predicted(spark):
    rows = [("x" if i % 2 else "y", u, b, v.tolist(), c if i % 5 else None) for i, u, b, v, c in _blobs(per=24)]
    df = spark.createDataFrame(rows, "d string, u string, b int, v array<double>, c string")
    out = recluster.leave_out_reclustered(df, "d", "u", "b", "v", "c", P, trees=40).toPandas()
    assert sorted(out["unit"].unique()) == ["u0", "u1", "u2", "u3"] and not out.duplicated(["unit", "block"]).any()
    assert (out["truth"] == out["predicted"]).mean() > 0.9
    assert np.allclose([sum(p) for p in out["probs"]], 1)
    alone = df.filter("u = 'u0'")
    assert recluster.leave_out_reclustered(alone, "d", "u", "b", "v", "c", P, trees=5).count() == 0


def test_frozen_clustering_is_saved_and_assigns(spark, tmp_path):
    df = spark.createDataFrame([(i, u, b, v.tolist(), c) for i, u, b, v, c in _blobs()], "id long, u string, b int, v array<double>, c string")
    frozen = recluster.freeze(df, "id", "v", "c", "u", P)
    sinks.save_library(spark, str(tmp_path / "lib"), *recluster.frozen_tables(spark, frozen))
    again = recluster.frozen_from(*sinks.load_library(spark, str(tmp_path / "lib")))
    x = np.stack([r[3] for r in _blobs(seed=8)])
    assert (frozen.assign(x) == again.assign(x)).all() and (again.assign(x) >= 0).mean() > 0.5
    check = recluster.self_check(df, "id", "v", recluster.hybrid_clusters(df, "id", "v", "c", "u", P), again).collect()[0]
    assert check.n == 144 and check.share > 0.95
    gone = recluster.assign_frozen(df.selectExpr("id", "IF(id = 0, NULL, v) AS v"), "v", again).filter("id = 0").collect()
    assert gone[0].cluster == -1
    assert recluster.assign_frozen(df.limit(0), "v", again).count() == 0
