"""Tables of rows, event classifiers, discovery as one call and checks of data, on hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.operators import clusters, tables, transfer, windows
from echolith.operators.models import ForestParams
from echolith.sources import checks

SMALL = ForestParams(trees=20, node_size=2, max_per_group=0, batch=5)


def test_ids(spark):
    df = spark.createDataFrame([("e", 12_500_000), ("e", 12_000_000), ("f", 1_704_067_200_123_400), ("f", 120_000), ("g", None)], "e string, t long")
    assert [r[0] for r in df.select(tables.detection_id("e", "t")).collect()] == ["e_12.5", "e_12.0", "f_1704067200.123", "f_0.12", None]
    b = spark.createDataFrame([("a@b@600",), ("600",), ("a@",)], "b string")
    assert [r[0] for r in b.select(tables.block_start(F.col("b"))).collect()] == [600.0, 600.0, None]


def test_event_constants(spark):
    df = spark.createDataFrame([("a", "x", 1, None), ("a", None, 2, None), ("b", "y", 3, [1]), ("b", "y", 3, [1])], "event_id string, l string, n int, v array<int>")
    assert {r.event_id: tuple(r)[1:] for r in tables.event_constants(df, "event_id").collect()} == {"a": ("x", None, None), "b": ("y", 3, [1])}
    assert tables.event_constants(df.select("event_id"), "event_id").count() == 2


def test_first_rows_do_not_depend_on_order(spark):
    rows = [(1, 5, "b", None), (1, 5, "a", 2.0), (2, 1, None, None), (1, 9, "0", 0.0)]
    for part in (rows, rows[::-1]):
        got = tables.first_rows(spark.createDataFrame(part, "k int, o int, s string, v double").repartition(3), ["k"], ["o"]).collect()
        assert sorted(map(tuple, got)) == [(1, 5, "a", 2.0), (2, 1, None, None)]


def test_feature_keys():
    assert "freq_profile" in tables.feature_keys("whistle") and len(tables.feature_keys("whistle_detection", True)) == 16
    assert "snr_db_mean" not in tables.feature_keys("whistle", True) and "n_clicks" not in tables.feature_keys("click", True)
    assert tables.feature_columns(["n", "prof_1_2", "occupancy", "csp_1_2", "prof_2_3"], ["occupancy", "freq_profile"]) == ["prof_1_2", "occupancy", "prof_2_3"]
    with pytest.raises(ValueError):
        tables.feature_keys("other")


def test_spec_of_bad_numbers(spark):
    spec = tables.FeatureSpec(("a",), medians={"a": 3.0}, log=("a",))
    got = tables.apply_spec(spark.createDataFrame([(None,), (float("nan"),), (7.0,)], "a double"), spec).collect()
    assert [r.a for r in got] == pytest.approx([np.log1p(3), np.log1p(3), np.log1p(7)])


def test_groups_chosen(spark):
    df = spark.createDataFrame([("A", "d1", 0.0), ("A", "d2", 700.0), ("B", "d1", 5.0), ("B", "d3", 5.0)], "l string, d string, s double")
    assert tables.cv_groups(df, "l", "d", "s", 10)[1] == "day"
    out, how = tables.cv_groups(df.filter("d <> 'd3'"), "l", "d", "s", 10)
    assert how == "block" and sorted(r.cv_group for r in out.collect()) == ["d1_0", "d1_0", "d2_600"]


def test_contour_from_bins(spark):
    t, f, s = tables.contour_from_bins(F.col("a"), F.col("b"), 96_000, 1024, 512)
    r = spark.createDataFrame([([3, 4, 6], [100, 101, 99])], "a array<long>, b array<long>").select(t.alias("t"), f.alias("f"), s.alias("s")).head()
    assert r.t == pytest.approx([0, 512 / 96_000, 3 * 512 / 96_000]) and r.f[0] == 9375 and r.s == pytest.approx(512 / 96_000)


def test_utc_text(spark):
    df = spark.createDataFrame([(1_704_067_199_999_000,), (0,)], "t long")
    assert [r[0] for r in df.select(tables.utc_text(F.col("t"))).collect()] == ["2023-12-31T23:59:59.999Z", "1970-01-01T00:00:00.000Z"]


def _events(spark, n=120):
    rng = np.random.default_rng(2)
    rows = [(k, k % 6, "XY"[k % 2], float(k % 2 + rng.normal(0, 0.1)), float(rng.normal())) for k in range(n)]
    return spark.createDataFrame(rows, "id long, g long, y string, a double, b double")


def test_event_classifier(spark):
    df = _events(spark)
    held = transfer.event_table(transfer.cross_validate(df, ["a", "b"], "y", "g", "id", SMALL), ["X", "Y"])
    r = transfer.summarise(held).head()
    assert r.n == 120 and r.event_accuracy > 0.95 and r.events_discarded == 0
    assert transfer.summarise(held, 2.0).head()[1:] == (None, None, 1.0)
    curve = {r.threshold: tuple(r)[1:] for r in transfer.summary_curve(held, [0.0, 0.5, 2.0]).collect()}
    for t, got in curve.items():
        s = transfer.summarise(held, t).head()
        assert got == pytest.approx((s.event_accuracy, s.mean_class_accuracy, 1 - s.events_discarded))
    model = transfer.fit(df, ["a", "b"], "y", "g", SMALL, prune=0.1)
    new = transfer.predict(df.drop("b", "y"), model, ["a", "b"])
    assert new.columns == ["id", "g", "predicted", "X", "Y", "score"]
    assert new.filter((F.col("id") % 2 == 1) & (F.col("predicted") == "Y")).count() > 50
    blocks = df.select((F.col("id") * 600).alias("block_start"), F.lit(3).alias("n_click"), "a", "b")
    out = transfer.decide_blocks(blocks, model, ["a", "b"], 600, 0.3).collect()
    assert all(r.block_end == r.block_start + 600 and r.n_click == 3 and r.decision == (r.predicted if r.score >= 0.3 else "uncertain") for r in out)


def test_rows_to_learn_from(spark):
    df = _events(spark).unionByName(spark.createDataFrame([(999, 0, None, 0.0, 0.0)], "id long, g long, y string, a double, b double"))
    p = ForestParams(max_per_group=3)
    one = sorted(r.id for r in transfer.training_rows(df, ["a", "b"], "y", "g", p).collect())
    assert len(one) == 18 and one == sorted(r.id for r in transfer.training_rows(df.repartition(5), ["a", "b"], "y", "g", p).collect())


def test_discovery_as_one_call(spark):
    rng = np.random.default_rng(0)
    rows = [(k, f"2024010{k % 5}", "A" if k % 2 == 0 and k % 3 else "B" if k % 3 else None, [float(k % 2 * 9 + rng.normal(0, 0.1)), float(rng.normal(0, 0.1)) + 3 * (k % 2 == 0)]) for k in range(240)]
    units = spark.createDataFrame(rows, "k long, day string, y string, v array<double>")
    out = transfer.discover(units, "k", "day", lambda u: clusters.cluster_units(u, "k", "v", least=5), "y", ("A", "B"), "v")
    assert {r.verdict for r in out["clusters"].collect()} == {"A", "B"}
    held = out["held_out"].collect()
    assert len(held) == 160 and all(r.predicted == r.y for r in held) and out["held_out_skill"].head().skill == 1
    assert out["scorecard"].head().n == 160 and out["by_unit"].count() == 5


def test_checks(spark):
    df = spark.createDataFrame([("A", 1, 0.5), ("A", 2, 0.5), ("B", 3, 0.1)], "label string, g int, f double")
    c = checks.feature_table(df, "label", "g", ["f"])
    assert c.ok and c.info["classes"] == ["A", "B"] and [m for m in c.messages if m[0] == "warn"][0][1].startswith("'B' has 1")
    assert not checks.feature_table(df, "label", "g", ["f"], ["A"]).ok and not checks.feature_table(df, "nope", "g", []).ok
    f = spark.createDataFrame([("a", 1_704_067_200.0), ("b", 1_704_153_600.0)], "path string, start double")
    assert checks.files(f, "whistle").messages == [("ok", "2 whistle files, 2024-01-01 00:00 to 2024-01-02 00:00 UTC.")]
    assert not checks.files(f.limit(0), "click", others=4).ok
    d = checks.days(f, "clicks")
    assert d.ok and {r.day: r.n for r in d.table.collect()} == {"2024-01-01": 1, "2024-01-02": 1}
    assert not checks.days(f, "contours", need=["freqs"]).ok and not checks.days(f.limit(0), "clicks").ok
    frames = spark.createDataFrame([("A", "e1", 0.1, 0.2), ("B", "e2", 0.1, 0.2)], "label string, event_id string, f1 double, f2 double")
    assert checks.frame_inputs(frames, 2).ok and not checks.frame_inputs(frames, 90).ok
    p = spark.createDataFrame([("A", "e1", 0.0, 3600.0), ("B", "e2", 0.0, 1800.0), ("B", "e3", 0.0, 1800.0)], "label string, event_id string, start double, end double")
    got = checks.periods(p)
    assert got.ok and {r.label: (r.n_groups, r.hours) for r in got.table.collect()} == {"A": (1, 1.0), "B": (2, 1.0)}
    one = checks.calls(p.withColumn("eco", F.lit("x")), others=["eco"])
    assert one.ok and one.info == {"label": ["A", "B"], "eco": ["x"]} and any(level == "warn" for level, _ in one.messages)


def test_click_windows(spark):
    """Windows of 10 s every 5 s from the first click's minute; missing measures are left out, a lone click gives no window."""
    s = 1_000_000
    rows = [(1, "d", 1 * s, 10.0), (2, "d", 2 * s, None), (3, "d", 4 * s, float("nan")), (4, "d", 7 * s, 30.0), (5, "e", 3 * s, 1.0)]
    df = spark.createDataFrame(rows, "detection_id long, day string, t long, peak_hz double")
    got = {r.w_start // s: r for r in windows.click_windows(df, "day", "t", 10 * s, 5 * s, 5 * s, measures=["peak_hz"]).collect()}
    assert set(got) == {0}
    r = got[0]
    assert (r.day, r.w_end, r.n_clicks, r.n_intervals, r.ici_mean_s, r.click_peak_hz_median, r.click_peak_hz_iqr) == ("d", 10 * s, 4, 3, 2.0, 20.0, 10.0)
    assert windows.click_windows(df, "day", "t", 10 * s, 5 * s, 5 * s, min_clicks=5).count() == 0
