"""Networks, density clusters, pathways and writers against computed cases."""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.operators import acoustics, clusters, density, features, intervals, models, network, pathways
from echolith.sources import sinks


def test_network_gradients():
    p = network.NetworkParams(l2=1e-2)
    net = network.Network(9, 3, p, 1)
    net.w = [w.astype(float) for w in net.w]
    rng = np.random.default_rng(0)
    x, y = rng.random((5, 9)), rng.integers(0, 3, 5)
    for w, g in zip(net.w, net.gradients(x, y, False), strict=True):
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        w[at] += 1e-4
        high = net.loss(x, y)
        w[at] -= 2e-4
        low = net.loss(x, y)
        w[at] += 1e-4
        assert (high - low) / 2e-4 == pytest.approx(g[at], abs=1e-4)


def test_network_stops_and_restores():
    net = network.Network(12, 2, network.NetworkParams(epochs=30, patience=2, rate=0.05), 3)
    rng = np.random.default_rng(1)
    x, y = rng.random((40, 12)), rng.integers(0, 2, 40)
    history = net.train(x[:30], y[:30], x[30:], y[30:])
    assert len(history) < 30
    assert net.loss(x[30:], y[30:]) == pytest.approx(min(v for _, v in history), abs=1e-6)


def _spectra(spark, groups=4, per=12):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(3):
        for g in range(groups):
            for _ in range(per):
                x = rng.random(24) * 0.3
                x[c * 8 : c * 8 + 4] += 1
                rows.append((len(rows), f"c{c}", f"c{c}g{g}", (x / x.sum()).tolist()))
    return spark.createDataFrame(rows, "id long, label string, grp string, x array<double>")


def test_network_cross_validation(spark):
    f = _spectra(spark)
    f = f.join(network.group_folds(f, "label", "grp", 4), "grp")
    assert [r[0] for r in f.select("fold").distinct().orderBy("fold").collect()] == [0, 1, 2, 3]
    s = network.bootstraps(f, "id", "label", "grp", "fold", [0, 1, 2, 3], network.ResamplingParams(bootstraps=2))
    out, history = network.cross_validate(f, "id", "label", "fold", s, "x", network.NetworkParams(epochs=6, rate=5e-3))
    assert out.filter("predicted = label").count() / out.count() > 0.9
    assert history.count() == 4 * 2 * 6


def test_bootstraps_take_from_the_largest_groups(spark):
    sizes = {"a0": 100, "a1": 5, "b0": 10, "b1": 10, "b2": 10}
    rows = [(i, g[0], g, 9) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    d = spark.createDataFrame(rows, "id long, label string, grp string, fold int")
    s = network.bootstraps(d, "id", "label", "grp", "fold", [0], network.ResamplingParams(max_per_group=20, bootstraps=1)).collect()
    assert Counter(r.label for r in s) == {"a": 25, "b": 25}
    assert Counter(r.grp for r in s)["a1"] == 5 and sorted(Counter(r.grp for r in s if r.label == "b").values()) == [8, 8, 9]
    assert Counter((r.label, r.validation) for r in s)["a", True] == 8


def test_bootstraps_leave_out_folds_without_a_class(spark):
    d = spark.createDataFrame([(1, "a", "a0", 0), (2, "b", "b0", 1), (3, "b", "b1", 0)], "id long, label string, grp string, fold int")
    assert network.bootstraps(d, "id", "label", "grp", "fold", [0, 1], network.ResamplingParams(bootstraps=1)).filter("held_out = 0").count() == 0


def test_density_labels():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (m, 2)) for c, m in (((0, 0), 120), ((5, 5), 80), ((0, 6), 60))])
    for leaf in (True, False):
        got = density.density_labels(np.concatenate([x, rng.uniform(-10, 15, (20, 2))]), 25, None, leaf)
        assert [set(got[a:b]) for a, b in ((0, 120), (120, 200), (200, 260))] == [{0}, {1}, {2}]
    assert set(density.density_labels(np.zeros((3, 2)), 25)) == {-1}
    assert len(density.density_labels(np.zeros((40, 2)), 5)) == 40


def test_spanning_tree_is_least():
    x = np.random.default_rng(2).random((40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, 3]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    pairs, root, total = sorted((reach[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0
    for w, i, j in pairs:
        a, b = root[i], root[j]
        if a != b:
            root, total = [a if r == b else r for r in root], total + w
    assert sum(w for w, _, _ in density.spanning_tree(x, 4)) == pytest.approx(total)


def test_map_and_cluster(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *(rng.normal(8 * (i % 2), 1, 3).tolist()), 1.0, None if i == 7 else 2.0) for i in range(80)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, same double, gap double")
    got = {r.id: r.cluster for r in density.map_and_cluster(d, "id", ["a", "b", "c", "same", "gap"], least=15).collect()}
    assert len({got[i] for i in range(0, 80, 2)} - {-1}) == 1 and len({got[i] for i in range(1, 80, 2)} - {-1}) == 1
    assert set(got.values()) >= {0, 1}


def test_prune_outliers_as_by_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 4)) * [5, 3, 1, 0.5]
    rows = [(i, "ab"[i % 2], *map(float, v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, label string, p double, q double, r double, s double")
    c = x - x.mean(0)
    z = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    want = set()
    for k in (0, 1):
        at = np.arange(k, 200, 2)
        far = np.sqrt(((z[at] - z[at].mean(0)) ** 2).sum(1))
        want |= set(at[far < np.quantile(far, 0.85)].tolist())
    assert {r.id for r in density.prune_outliers(d, list("pqrs"), "label", 0.15).collect()} == want
    assert density.prune_outliers(d.limit(0), list("pqrs"), "label", 0.15).count() == 0


def test_binomial_chance(spark):
    rows = [(c, i < k, i % 4) for c, n, k in ((0, 40, 2), (1, 60, 50)) for i in range(n)]
    d = spark.createDataFrame(rows, "cluster int, labelled boolean, day int")
    got = {r.cluster: r for r in density.candidate_new(d, "cluster", "labelled", "day").collect()}
    q = 52 / 100
    assert got[0].p_underlabelled == pytest.approx(sum(math.comb(40, k) * q**k * (1 - q) ** (40 - k) for k in range(3)), rel=1e-9)
    assert got[0].candidate_new and not got[1].candidate_new
    assert clusters.beta_quantile(0.5, 1, 1) == pytest.approx(0.5)


def test_outlying_units(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, i % 4, rng.normal(0, 1, 2).tolist()) for i in range(40)] + [(40, 0, 1, [50.0, 50.0]), (41, 1, 0, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, cluster int, block int, x array<double>")
    got = {r.id: r.cluster for r in density.outlying(d, "cluster", "block", "id", "x").collect()}
    assert got[40] == -1 and got[41] == 1 and sum(v == -1 for v in got.values()) <= 3


TREE = pathways.Layer("l1", {"A": ("a",), "BCD": ("b", "c", "d")}, 0.0, {"BCD": pathways.Layer("l2", {"B": ("b",), "CD": ("c", "d")}, 0.0, {"CD": pathways.Layer("l3", {"C": ("c",), "D": ("d",)}, 0.2)})})


def test_pathway_of_three_layers(spark):
    d = spark.createDataFrame([(0.7, 0.1, 0.1, 0.1), (0.1, 0.1, 0.6, 0.2), (0.1, 0.1, 0.41, 0.39), (None,) * 4], "a double, b double, c double, d double")
    got = [(r.l1, r.l2, r.l3, r.path, r.decision) for r in pathways.descend(d, TREE, list("abcd")).collect()]
    assert got[0] == ("A", "n/a", "n/a", "A", "A")
    assert got[1] == ("BCD", "CD", "C", "BCD > CD > C", "C")
    assert got[2] == ("BCD", "CD", "uncertain", "BCD > CD", "CD")
    assert got[3][3:] == ("", "no_data")
    with pytest.raises(ValueError):
        pathways.check(pathways.Layer("x", {"A": ("a",), "B": ("a",)}), ["a"])


def test_best_overlap_takes_the_covered_call(spark):
    w = spark.createDataFrame([(1, 0, 100), (2, 1000, 1100)], "id long, s long, e long")
    c = spark.createDataFrame([(1, 60, 1000, "long"), (2, 10, 20, "short"), (3, 30, 40, "untyped")], "c long, u long, v long, l string")
    got = {r.id: r.label for r in intervals.best_overlap(w, c, "id", ("s", "e"), ("u", "v"), "c", "l", 64).collect()}
    assert got == {1: "mixed", 2: "none"}
    got = {r.id: r.label for r in intervals.best_overlap(w, c.filter("c <> 1"), "id", ("s", "e"), ("u", "v"), "c", "l", 64).collect()}
    assert got[1] == "short"


def test_period_labels_overwrite(spark):
    w = spark.createDataFrame([(1, 0, 10)], "id long, s long, e long")
    p = spark.createDataFrame([(0, 20, "x"), (2, 20, "y")], "u long, v long, label string")
    first = intervals.period_labels(w, p, "id", ("s", "e"), ("u", "v"), ["u"], ["label"], "one", 64)
    assert first.select("label", "label_source").head()[:] == ("x", "one")
    assert intervals.period_labels(first, p, "id", ("s", "e"), ("u", "v"), ["u"], ["label"], "two", 64, True).select("label", "label_source").head()[:] == ("y", "two")


def test_compiled_forest_scores_alike():
    """Masks of leaves give the walk's probabilities bit for bit: equal values, missing ones, trees of one leaf and of over 64."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(3000, 5)), 1)
    y = r.integers(0, 3, 3000)
    for size in (2, 25, 2000):
        trees = [models.grow(x.astype(np.float32), y, 3, np.random.default_rng(k), 2, size) for k in range(40)]
        assert (max(map(len, (t["left"] for t in trees))) > 200) == (size == 2)
        z = np.concatenate([x, r.normal(size=(500, 5)) * 3, np.full((1, 5), np.nan)])
        assert np.array_equal(models.score_compiled(models.compiled(trees), z), models.score(trees, z))


def test_forest_is_saved_and_read(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], float(rng.normal(3 * (i % 2))), float(rng.random())) for i in range(200)]
    d = spark.createDataFrame(rows, "id long, label string, u double, v double").withColumn("g", F.lit(0))
    fitted = models.fit_folds(d, ["u", "v"], "label", "g", [], models.ForestParams(trees=6, batch=3, node_size=5))
    sinks.save_forest(spark, str(tmp_path / "f"), fitted[None], ["u", "v"])
    read, features = sinks.load_forest(spark, str(tmp_path / "f"))
    a, b = (models.predict(d, m, features).select("id", "probs").orderBy("id").collect() for m in (fitted, read))
    assert a == b
    assert json.loads(json.dumps(sinks.plain({"x": np.array([1.0, np.nan])}))) == {"x": [1.0, None]}


def test_tables_are_written(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 2.0], 5.0)], "id long, x array<double>, prof_1 double")
    sinks.write_table(d, str(tmp_path / "c"), "csv", ("prof_",))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).head()[:] == ("1", "[1.0,2.0]")
    assert sinks.ragged_union([d, spark.createDataFrame([(2, "z")], "id long, y string")], ("x",)).columns == ["id", "prof_1", "y"]


def test_octave_bands():
    edges = acoustics.band_edges(10, 4000, 3)
    centres = np.sqrt(np.array(edges[1:]) * edges[:-1])
    assert len(centres) == 27 and centres[0] == pytest.approx(9.84, abs=0.01) and centres[-1] == pytest.approx(4000)


def test_click_frames_as_by_hand(spark):
    rng = np.random.default_rng(9)
    waves = [rng.normal(size=100) for _ in range(7)]
    starts = [0, 500_000, 1_900_000, 2_100_000, 2_500_000, 3_000_000, 9_000_000]
    d = spark.createDataFrame([("k", s, s + 1000, w.tolist()) for s, w in zip(starts, waves)], "event string, start_us long, end_us long, wave array<double>")
    got = {r.frame: r for r in features.click_frames(d, "event", 2_000_000, 2_000_000, 96_000.0, fft_len=512).collect()}
    assert set(got) == {0, 1} and got[0].n_detections == 3 and got[1].frame_start == 2_000_000
    level = np.mean([20 * np.log10(np.abs(np.fft.rfft(w, 512))[:256] ** 2) for w in waves[:3]], 0)
    level -= level.min()
    x = np.array([level[max(0, i - 2) : i + 1].mean() for i in range(256)])[53:213].reshape(-1, 2).mean(1)
    assert np.allclose(got[0].features, x / x.sum())
    silent = spark.createDataFrame([("k", 0, 10, [0.0] * 8)], "event string, start_us long, end_us long, wave array<double>")
    assert features.click_frames(silent, "event", 2_000_000, 2_000_000, 96_000.0, min_clicks=1).count() == 0


def test_click_measures(spark):
    t = np.arange(128) / 96_000
    d = spark.createDataFrame([(1, np.sin(2 * np.pi * 24_000 * t).tolist()), (2, [0.0] * 128), (3, None), (4, [1.0])], "id long, wave array<double>")
    got = {r.id: r for r in d.select("id", acoustics.click_measures_column("wave", 96_000.0).alias("m")).select("id", "m.*").collect()}
    assert got[1].peak_hz == 24_000 and got[1].centroid_hz == pytest.approx(24_000, rel=0.01) and 0 < got[1].bw3_hz <= got[1].bw10_hz
    assert sum(v for k, v in got[1].asDict().items() if k.startswith("csp_")) == pytest.approx(1)
    assert got[2].peak_hz is None and got[3].peak_hz is None and got[4].peak_hz is None


def test_whistle_frames_in_octaves(spark):
    row = ("k", 1, 0, 1_000_000, [i / 100 for i in range(100)], [float(f) for f in np.linspace(2500, 15_000, 100)])
    d = spark.createDataFrame([row], "event string, contour_id long, start_us long, end_us long, times array<double>, freqs array<double>")
    r = features.whistle_frames(d, "event", 4_000_000, 4_000_000, downsample=1, per_octave=3).head()
    want = np.histogram(row[5], acoustics.band_edges(2000, 20_000, 3))[0]
    assert np.allclose(r.features, want / want.sum()) and r.density == pytest.approx(0.25)
    assert len(features.whistle_frames(d, "event", 4_000_000, 4_000_000).head().features) == 90
