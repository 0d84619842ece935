"""Libraries of several detectors and layers, class statistics by plain Python, and numbers that are missing."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import libraries as L
from echolith.operators.clusters import beta_quantile
from echolith.operators.discovery import in_ranges
from echolith.operators.pathways import Layer
from echolith.operators.recluster import HybridParams

TREE = Layer("species", {"X": ("X1", "X2"), "Y": ("Y",)}, 0.05, {"X": Layer("type", {"X1": ("X1",), "X2": ("X2",)}, 0.05)})
NAN = float("nan")


def _plain_stats(rows, classes, cap, prior, balanced, ci, least):
    """The definition in plain Python; rows are (cluster, unit, label)."""

    def capped(some):
        n = defaultdict(int)
        for _, u, c in some:
            if u is not None:
                n[u, c] += 1
        return [float(sum(min(k, cap) if cap else k for (_, c), k in n.items() if c == x)) for x in classes]

    lab = [r for r in rows if r[0] is not None and r[0] >= 0 and r[2] in classes]
    total = capped(lab)
    if balanced and min(total) > 0:
        weight, base = [sum(total) / len(classes) / t for t in total], [1 / len(classes)] * len(classes)
    else:
        weight, base = [1.0] * len(classes), [t / sum(total) if sum(total) else 1 / len(classes) for t in total]
    out = {}
    for k in {r[0] for r in rows if r[0] is not None and r[0] >= 0}:
        g = [r for r in lab if r[0] == k]
        a = [x * w + prior * b for x, w, b in zip(capped(g), weight, base, strict=True)]
        p = [x / sum(a) for x in a]
        low = [beta_quantile((1 - ci) / 2, x, sum(a) - x) if 0 < x < sum(a) else None for x in a]
        units = [len({u for _, u, c in g if c == x and u is not None}) for x in classes]
        ok = [lo is not None and lo > b and u >= least for lo, b, u in zip(low, base, units, strict=True)]
        best = max((v for v, o in zip(p, ok, strict=True) if o), default=None)
        verdict = next((c for c, v, o in zip(classes, p, ok, strict=True) if o and v == best), "uncertain")
        out[k] = (len(g), p, [sum(c == x for _, _, c in g) for x in classes], units, verdict)
    return out


@pytest.mark.parametrize("classes, cap, balanced", [(["A", "B"], 5, True), (["A", "B"], 0, False), (["A", "B", "C"], 5, True), (["A", "B", "none there"], 3, False)])
def test_class_stats_by_plain_python(spark, classes, cap, balanced):
    """Clusters without labels keep the base rates, absent classes switch the balance off, null units and labels don't count."""
    r = np.random.default_rng(2)
    rows = [(int(k), f"u{int(u)}", "A" if k == 0 or r.random() < 0.2 else "B") for k, u in zip(r.integers(-1, 4, 300), r.integers(0, 7, 300), strict=True)]
    rows += [(7, "u1", None), (7, None, "A"), (0, None, "A"), (None, "u1", "A"), (8, "u2", "other")]
    p = L.Shares(cap=cap, prior=6.0, balanced=balanced)
    got = {x.cluster: x for x in L.class_stats(spark.createDataFrame(rows, "cluster long, unit string, label string"), "cluster", "unit", "label", classes, p).collect()}
    want = _plain_stats(rows, classes, cap, 6.0, balanced, p.ci, p.min_units)
    assert set(got) == set(want)
    for k, (n, probs, counts, units, verdict) in want.items():
        assert got[k].n_labelled == n and got[k].n == counts and got[k].units == units and got[k].verdict == verdict
        assert got[k].p == pytest.approx(probs)


def test_stats_of_no_rows(spark):
    empty = spark.createDataFrame([], "cluster long, unit string, label string")
    assert L.class_stats(empty, "cluster", "unit", "label", ["A", "B"]).collect() == []


@pytest.fixture(scope="module")
def windows(spark):
    """Two detectors' windows: types lie apart for whistles; clicks tell X from Y only."""
    r = np.random.default_rng(5)
    centre = {("whistle", "X1"): (0, 5, 0, 1), ("whistle", "X2"): (5, 0, 0, 1), ("whistle", "Y"): (0, 0, 6, -2), ("click", "X1"): (4, 4, 0, 0), ("click", "X2"): (4, 4, 0, 0), ("click", "Y"): (-4, 1, 3, 3)}
    rows, key = [], 0
    for block in range(48):
        value = ("X1", "X2", "Y")[block % 3]
        for d in ("whistle", "click"):
            if (d, block % 7) in (("whistle", 3), ("click", 5)):
                continue
            for j in range(6):
                v = np.array(centre[d, value]) + r.normal(0, 0.4, 4)
                rows.append((key, d, f"u{block % 8}", block // 3, None if j == 5 else value, block * 600 + j * 50, v.tolist(), float(j)))
                key += 1
    rows += [(key, "whistle", "u1", 1, "X1", 48 * 600, None, 1.0), (key + 1, "other", "u1", 1, "X1", 5, [1.0] * 4, 1.0)]
    return spark.createDataFrame(rows, "key long, detector string, unit string, block long, value string, start long, vector array<double>, level double")


def _key(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def test_build_save_load_and_classify(spark, windows, tmp_path):
    known = windows.filter("detector <> 'other'")
    lib = L.build(known, TREE, 600, HybridParams(least=5, cut=0.5, trees=30), least=20, measures=("level",))
    assert set(lib.nodes) == {(d, n) for d in ("click", "whistle") for n in ("species", "type")}
    got = L.classify(lib, windows).orderBy("block_start").collect()
    assert len(got) == 49
    for r in got[:48]:
        value = ("X1", "X2", "Y")[r.block_start // 600 % 3]
        assert r.species == value[0] and r.n_click + r.n_whistle in (6, 12)
        assert r.type_whistle == ("n/a" if value == "Y" else "no_detections" if not r.n_whistle else value)
        if value == "Y":
            assert (r.type, r.path, r.decision) == ("n/a", "Y", "Y")
        elif r.n_whistle:
            assert (r.type, r.path, r.decision) == (value, f"X > {value}", value)
        else:
            assert r.decision in ("X", "X1", "X2") and r.species_whistle == "no_detections"
    assert (got[48].species, got[48].decision, got[48].path, got[48].n_whistle) == ("no_detections", "no_detections", "", 1)
    L.save(spark, f"{tmp_path}/lib", lib)
    again = L.load(spark, f"{tmp_path}/lib")
    assert again.tree == lib.tree and again.bases == lib.bases and again.measures == ("level",)
    assert _key(L.classify(again, windows).collect()) == _key(got)


def test_rules_least_scores_and_periods(spark, windows):
    known = windows.filter("detector <> 'other' AND vector IS NOT NULL").withColumn("cluster_species", F.when(F.col("value") == "Y", 1).otherwise(0).cast("long"))
    known = known.withColumn("cluster_type", F.when(F.col("value") == "X1", 0).when(F.col("value") == "X2", 1).otherwise(-1).cast("long")).filter("value IS NOT NULL")
    lib = L.of_clusters(known, TREE, 600, measures=("level",))
    plain = {r.block_start: r for r in L.blocks(lib, known).collect()}
    assert {r.decision for r in plain.values()} == {"X1", "X2", "Y"}
    ruled = {r.block_start: r for r in L.blocks(L.with_rules(lib, {"whistle": [("median_level", ">=", 2, "noise")], "click": [("n_windows", ">", 99, "never")]}), known).collect()}
    for t, r in ruled.items():
        if r.n_whistle and r.n_click:  # the clicks still decide
            assert r.rule is None and r.species == plain[t].species and r.species_whistle == "noise"
        elif r.n_whistle:
            assert (r.rule, r.species, r.decision, r.path, r.type) == ("whistle: median_level >= 2", "noise", "noise", "", "n/a")
    strict = L.with_min_scores(lib, {"type": 1.0})
    assert {r.decision for r in L.blocks(strict, known).collect()} == {"X", "Y"}
    some = L.blocks(lib, known, period=(-1200, 1800)).orderBy("block_start").collect()
    assert [(r.block_start, r.decision) for r in some[:3]] == [(-1200, "no_detections"), (-600, "no_detections"), (0, plain[0].decision)] and len(some) == 5
    for bad in ([("loudness", ">", 1, "x")], [("n_windows", "~", 1, "x")], [("n_windows", ">", "1", "x")], [("n_windows", ">", 1, None)]):
        with pytest.raises(ValueError, match="not a rule"):
            L.with_rules(lib, {"click": bad})
    with pytest.raises(ValueError, match="no such layers"):
        L.with_min_scores(lib, {"nothing": 1})


def test_a_detector_without_a_layer(spark, windows):
    """Clicks have too few windows of X for the second layer; whistles decide it alone."""
    few = windows.filter("detector = 'whistle' OR (detector = 'click' AND (value = 'Y' OR start < 1500))")
    lib = L.build(few, TREE, 600, HybridParams(least=5, cut=0.5, trees=20), least=25)
    assert ("click", "type") not in lib.nodes and ("click", "species") in lib.nodes
    out = L.classify(lib, few)
    assert "type_click" not in out.columns
    assert {r.decision for r in out.filter("n_whistle >= 6").collect()} == {"X1", "X2", "Y"}


def test_missing_numbers(spark):
    """NaN is no probability, fires no rule and is out of no range; infinity fires no rule."""
    rows = [(0, NAN, 0.4, NAN), (1, 0.6, 0.4, 7.0), (2, None, NAN, None), (3, NAN, NAN, math.inf), (4, 0.3, None, 3.0)]
    df = spark.createDataFrame(rows, "k long, A double, B double, v double")
    probs = [F.col("A"), F.col("B")]
    got = {r.k: r for r in df.select("k", S.decide(probs, ["A", "B"], 0.0).alias("d"), S.decision_score(probs).alias("s"), S.rule_chain([("v", ">", 5.0, "r")], F.lit("-")).alias("r"), in_ranges({"v": (None, 5.0)}).alias("i")).collect()}
    assert [got[k].d for k in range(5)] == ["B", "A", "no_data", "no_data", "A"]
    assert got[0].s == pytest.approx(0.16) and got[1].s == pytest.approx(0.12) and got[2].s is None
    assert [got[k].r for k in range(5)] == ["-", "r", "-", "-", "-"] and [got[k].i for k in range(5)] == [True, False, True, False, True]
    merged = df.select("k", *(m.alias(f"m{k}") for k, m in enumerate(S.merge_evidence([probs, [F.lit(0.5), F.lit(NAN)]], [[0.5, 0.5], [0.5, 0.5]])))).collect()
    assert all(r.m0 is not None and not math.isnan(r.m0) for r in merged)
