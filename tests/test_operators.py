"""Hand-computed cases of single operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import acoustics, clusters, discovery, intervals, models, predictions, quantiles, windows
from echolith.plans import learned, signals
from echolith.sources import tables
from echolith.streaming import blocks


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).head()[0]


def test_decide(spark):
    rows = spark.createDataFrame([(0.6, 0.4), (0.5, 0.5), (None, None)], "a double, b double")
    got = rows.select(S.decide([F.col("a"), F.col("b")], ["A", "B"], 0.05).alias("d"), S.decision_score([F.col("a"), F.col("b")]).alias("s")).collect()
    assert [r.d for r in got] == ["A", "uncertain", "no_data"]
    assert got[0].s == pytest.approx(0.12)


def test_array_transforms(spark):
    x = F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    assert one(spark, S.smooth(x, 3)) == [1, 1.5, 2, 3]
    assert one(spark, S.downsample(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 5.0))), 2)) == [1.5, 3.5, 5]
    assert one(spark, S.normalise_sum(F.array(F.lit(0.0)))) is None


def test_merge_evidence_one_detector(spark):
    none = F.lit(None).cast("double")
    a, b = S.merge_evidence([[F.lit(0.7), F.lit(0.3)], [none, none]], [[0.1, 0.9]] * 2, [0.5, 1])
    assert (one(spark, a), one(spark, b)) == (0.7, 0.3)
    a, b = S.merge_evidence([[none, none]], [[0.5, 0.5]])
    assert one(spark, b) is None


def test_merge_evidence_of_two_detectors(spark):
    """Whistles know X and Y, clicks X and Z; unequal bases leave the base rate out of the product."""
    none = F.lit(None).cast("double")
    whistle, click = [F.lit(0.8), F.lit(0.2), none], [F.lit(0.6), none, F.lit(0.4)]
    bases = [[0.5, 0.5, None], [0.5, None, 0.5]]
    got = [one(spark, c) for c in S.merge_evidence([whistle, click], bases)]
    e = np.array([1.6 * 1.2, 0.4, 0.8])
    assert got == pytest.approx(list(e / e.sum()))
    got = [one(spark, c) for c in S.merge_evidence([whistle, click], bases, [1, 0])]
    assert got == pytest.approx([1.6 / 3, 0.4 / 3, 1 / 3])
    got = [one(spark, c) for c in S.merge_evidence([[none] * 3, click], bases)]
    assert got == [0.6, 0, 0.4]
    p, q = [F.lit(0.6), F.lit(0.3), F.lit(0.1)], [F.lit(0.5), F.lit(0.3), F.lit(0.2)]
    got = [one(spark, c) for c in S.merge_evidence([p, q], [[0.3, 0.3, 0.4]] * 2)]
    assert got == pytest.approx([0.748, 0.224, 0.028], abs=5e-4)


def test_frames(spark):
    d = spark.createDataFrame([("k", 0, 100), ("k", 3900, 4200)], "key string, s long, e long")
    got = sorted((r.s, r.frame) for r in windows.frames(d, "key", "s", "e", 4000, 4000).collect())
    assert got == [(0, 0), (3900, 0), (3900, 1)]


def test_unit_ids(spark):
    d = spark.createDataFrame([(1, 1_000_000), (2, 1_000_000), (3, 2_000_000), (4, 1_000_400)], "id long, t long")
    got = {r.id: r.unit_id for r in windows.unit_ids(d, "t", "id").collect()}
    assert got == {1: "1.000", 2: "1.000_1", 3: "2.000", 4: "1.000_2"}


def test_sessions(spark):
    d = spark.createDataFrame([("a", 0, 10), ("a", 50, 60), ("a", 55, 200), ("a", 250, 260), ("a", 400, 410)], "k string, s long, e long")
    got = [r.session for r in intervals.sessions(d, ["k"], "s", "e", 60).orderBy("s").collect()]
    assert got == [1, 1, 1, 1, 2]


def test_overlapping_pairs_once(spark):
    rng = np.random.default_rng(1)
    a = [(k, int(s), int(s) + int(n)) for k, (s, n) in enumerate(zip(rng.integers(0, 1000, 40), rng.integers(1, 300, 40), strict=True))]
    left = spark.createDataFrame(a, "i long, s long, e long")
    right = spark.createDataFrame(a, "j long, u long, v long")
    got = sorted((r.i, r.j, r.overlap) for r in intervals.overlapping(left, right, ("s", "e"), ("u", "v"), 50).collect())
    want = sorted((i, j, min(e, v) - max(s, u)) for i, s, e in a for j, u, v in a if u < e and v > s)
    assert got == want


def test_interval_features_of_clicks(spark):
    t = [k * 100 for k in range(20)] + [1900 + 3100 + k * 200 for k in range(10)]
    d = spark.createDataFrame(list(enumerate(t)), "detection_id long, t long").withColumn("k", F.lit(1))
    r = windows.interval_features(windows.intervals_between(d, ["k"], "t", 1000), ["k"]).head()
    assert (r.n, r.n_intervals, r.ici_median, r.ici_p95) == (30, 28, 100, 200)


def test_validate_counts_faults(spark):
    d = spark.createDataFrame([("1", "click", "A", 0.9), ("1", "click", "B", 0.3), ("2", "bat", "A", 1.0), ("2", "bat", "A", None)], "id string, voc_type string, class string, probability double")
    r = predictions.validate(d, ["id"]).head()
    assert (r.n_bad_sum, r.n_bad_type, r.n_duplicate_keys, r.n_null) == (1, 2, 1, 1)


def test_left_out_equals_recount(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 3, (200, 3))]
    d = spark.createDataFrame(rows, "g int, u int, l int")
    for r in predictions.left_out(d, "g", "u", "l", 4).collect():
        rest = [x for x in rows if x[0] == r.g and x[1] != r.u]
        want = sum(min(4, sum(1 for x in rest if x[1] == u and x[2] == r.l)) for u in range(3))
        assert r.n_rest == want


def test_forest_separates(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.normal(c * 4)), float(rng.normal()), "AB"[c], g) for c in (0, 1) for g in range(4) for _ in range(30)]
    d = spark.createDataFrame(rows, "x double, y double, label string, g int")
    m = models.fit_folds(d, ["x", "y"], "label", "g", [0, 1, 2, 3], models.ForestParams(trees=20, batch=10, node_size=5))
    got = models.predict(d, m, ["x", "y"], "g").select(F.avg((F.col("predicted") == F.col("label")).cast("int"))).head()[0]
    assert got > 0.9


def test_beta_quantile_and_linkage():
    assert clusters.beta_quantile(0.5, 2, 2) == pytest.approx(0.5, abs=1e-9)
    assert clusters.beta_quantile(0.95, 1, 1) == pytest.approx(0.95, abs=1e-9)
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1])
    assert clusters.average_linkage(np.abs(x[:, None] - x), 1.0).tolist() == [0, 0, 0, 1, 1]


def test_contour_measures():
    t = np.arange(5) * 0.1
    m = dict(zip(acoustics.CONTOUR, acoustics.contour_measures(t, 1000 + 100 * t, 0.1), strict=True))
    assert m["duration_s"] == pytest.approx(0.5) and m["linreg_slope_hz_s"] == pytest.approx(100) and m["frac_up"] == 1
    assert m["overall_slope_hz_s"] == pytest.approx(40 / 0.5)  # over the duration, which includes one slice


def test_verdicts_need_units_and_leave_out_unassigned(spark):
    rows = [(0, "d1", True)] * 38 + [(0, "d1", False)] * 2 + [(1, "d1", False)] * 38 + [(1, "d1", True)] * 2
    rows += [(-1, "d2", True)] * 50 + [(0, "d3", None)] * 20 + [(2, "d1", None)]
    df = spark.createDataFrame(rows, "c int, u string, y boolean")
    out = {r.c: r for r in clusters.binary_verdicts(df, "c", "u", "y", min_units=2).collect()}
    assert set(out) == {0, 1, 2} and all(r.verdict == "uncertain" and r.base == 0.5 for r in out.values())
    out = {r.c: r for r in clusters.binary_verdicts(df, "c", "u", "y", min_units=1).collect()}
    assert (out[0].verdict, out[1].verdict, out[2].verdict) == ("yes", "no", "uncertain")
    assert out[0].raw == pytest.approx(0.95) and out[0].p == pytest.approx(43 / 50) and out[0].enrichment == pytest.approx(43 / 25)
    assert out[2].raw is None and out[2].p == pytest.approx(0.5) and out[2].n == 0


def test_class_verdict_of_those_that_pass(spark):
    """The greatest share lacks units; the next passes the bound and has them."""
    rows = [(0, f"u{k}", "B") for k in range(2) for _ in range(45)] + [(0, "u9", "A")] * 50
    rows += [(1, f"v{k}", c) for k in range(4) for c in "CD" for _ in range(40)] + [(1, "v1", "A")] * 10 + [(1, "v1", "B")] * 50
    rows += [(-1, "u1", "A")] * 30 + [(0, "u1", None)] * 30
    df = spark.createDataFrame(rows, "c int, u string, y string")
    shares = discovery.class_shares(df, "c", "u", "y", 100)
    p = {(r.c, r.y): r.p for r in shares.collect()}
    assert set(y for _, y in p) == set("ABCD") and p[0, "A"] > p[0, "B"] > 0.25
    out = {r.c: r for r in discovery.class_verdicts(shares, "c", "y").collect()}
    assert out[0].verdict == "B" and out[0].p == pytest.approx(p[0, "B"])
    assert {r.verdict for r in discovery.class_verdicts(shares, "c", "y", min_units=9).collect()} == {"uncertain"}


def test_annotations(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(" event_id,label,start,end\n1,A,2024-01-01 00:00:00,2024-01-01 00:01:00\n2,B,1704067200,1704067230\n")
    got = sorted((r.event_id, r.start, r.end) for r in tables.annotations(spark, str(p)).collect())
    assert got == [("1", 1704067200.0, 1704067260.0), ("2", 1704067200.0, 1704067230.0)]
    p.write_text("event_id,start,end\n1,5,4\n")
    with pytest.raises(Exception, match="bad period"):
        tables.annotations(spark, str(p), require_label=False).collect()


def test_file_time(spark):
    assert one(spark, tables.file_time(F.lit("x_20240101_000010.pgdf"))) == 1704067210
    assert one(spark, tables.file_time(F.lit("x.pgdf"))) is None


def test_stream_blocks(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(k, f"2024-01-01 00:{k:02d}:00", 0.8, 0.2) for k in range(30)], "detection_id long, t string, A double, B double").select("*", F.to_timestamp("t").alias("ts")).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = blocks.block_decisions(s, "ts", "10 minutes", ["A", "B"], 0.1).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("live").collect()
    assert rows and all(r.decision == "A" and r.n == 10 for r in rows)


def test_project_reruns_only_what_changed(spark, tmp_path):
    from echolith.plans.project import Project, Stage

    ran = []

    def stage(name):
        def run(s, config, inputs):
            ran.append(name)
            return s.range(config.get(name, 1))

        return run

    stages = [Stage("a", stage("a"), settings=("a",)), Stage("b", stage("b"), ("a",), ("b",)), Stage("c", stage("c"))]
    path = str(tmp_path)
    Project(path, stages, {"a": 2}).run(spark, ["b"])
    Project(path, stages, {"a": 2}).run(spark, ["b"])
    assert ran == ["a", "b"]
    Project(path, stages, {"a": 2, "b": 5}).run(spark, ["b"])
    assert ran == ["a", "b", "b"]
    assert Project(path, stages, {"a": 3}).status(spark) == {"a": "outdated", "b": "outdated", "c": "pending"}


def test_settings(spark):
    from echolith.sources import settings

    assert one(spark, settings.snap_rate(F.lit(96001.0))) == 96000
    assert one(spark, settings.fft_length(F.lit(1024.0))) == 2048


def test_filled_blocks(spark):
    p = spark.createDataFrame([(0, 86_400)], "a long, b long")
    n = spark.createDataFrame([(300, 2)], "block long, n long")
    got = windows.filled_blocks(p, n, "a", "b", "block", 300)
    assert got.count() == 288 and got.filter("n IS NULL").count() == 287


def test_project_states(spark, tmp_path):
    from echolith.plans.project import Project, Stage

    source = tmp_path / "in" / "x.csv"
    source.parent.mkdir()
    source.write_text("a\n1\n")

    def broken(s, c, up):
        raise ValueError("no")

    ran = []

    def load(s, c, up):
        ran.append(1)
        return s.read.csv(c["file"], header=True)

    stages = [Stage("load", load, settings=("file",)), Stage("maybe", load, ("load",), ("file",), enabled=lambda c: c.get("on", False)), Stage("bad", broken, ("load",))]
    p = Project(str(tmp_path / "p"), stages, {"file": str(source)})
    assert set(p.status(spark).values()) == {"pending", "skipped"}
    with pytest.raises(ValueError):
        p.run(spark)
    assert p.status(spark) == {"load": "done", "maybe": "skipped", "bad": "failed"} and len(ran) == 1
    p.run(spark, ["load"])
    assert len(ran) == 1
    source.write_text("a\n1\n2\n")
    assert p.status(spark) == {"load": "outdated", "maybe": "skipped", "bad": "pending"}
    assert p.run(spark, ["load"])["load"].count() == 2


def test_split_sessions(spark):
    """One hot key over many buckets, long intervals over bucket borders, ties, repeated rows and null keys: as sessions() numbers them."""
    r = random.Random(4)
    rows = [("hot", s := r.randrange(20_000), s + r.choice([1, 5, 30, 2000])) for _ in range(900)] + [(k, s, s + 3) for k in ("a", None) for s in (0, 0, 10, 500, 500, 503, 4000)]
    d = spark.createDataFrame(rows, "k string, s long, e long")
    key = lambda df: sorted(map(str, df.collect()))
    for bucket in (7, 400, 10**6):
        assert key(intervals.split_sessions(d, ["k"], "s", "e", 12, bucket)) == key(intervals.sessions(d, ["k"], "s", "e", 12))
    assert intervals.split_sessions(d.limit(0), ["k"], "s", "e", 12, 5).collect() == []


def test_labelled_periods(spark):
    """Ids in order of starts over all periods; short periods and windows without a label go."""
    rows = [("click", "B", 100, 104), ("click", "B", 106, 110), ("click", "", 107, 111), ("click", None, 0, 4), ("whistle", "A", 5, 9), ("whistle", "A", 8, 30), ("whistle", "A", 300, 304), ("click", "A", 100, 104), ("click", "A", 110, 114)]
    d = spark.createDataFrame(rows, "det string, l string, s long, e long")
    got = intervals.labelled_periods(d, "det", "l", "s", "e", 6, 50, 2).orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [("A_click_0002", "A", 100, 114, "click", 2), ("A_whistle_0001", "A", 5, 30, "whistle", 2), ("B_click_0003", "B", 100, 110, "click", 2)]
    assert intervals.labelled_periods(d, "det", "l", "s", "e", 6, 50).count() == 4


def test_overlaps_of_any_length(spark):
    """Moments, years and all between, repeated and empty ones: the pairs of overlapping(), and few rows more than there are intervals."""
    r = random.Random(9)
    spans = lambda n, k: [(i, s := r.randrange(-40_000_000, 40_000_000), s + r.choice([0, 1, 60, 4096, 100_000, 31_536_000][:k])) for i in range(n)]
    a = spark.createDataFrame([*spans(300, 6), (1, 5, 6), (1, 5, 6)], "i long, s long, e long")
    b = spark.createDataFrame([*spans(200, 5), (7, 0, 4096)], "j long, u long, v long")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = sorted((i, s, e, j, u, v, min(e, v) - max(s, u)) for i, s, e in map(tuple, a.collect()) for j, u, v in map(tuple, b.collect()) if u < e and v > s)
    got = intervals.overlapping_any_length(a, b, ("s", "e"), ("u", "v"))
    assert key(got) == want and len(want) > 1000
    assert key(intervals.overlapping_any_length(b, a, ("u", "v"), ("s", "e")).select("i", "s", "e", "j", "u", "v", "overlap")) == want
    assert intervals.overlapping_any_length(a.limit(0), b, ("s", "e"), ("u", "v")).collect() == []
    year = spark.createDataFrame([(0, 0, 31_536_000)], "j long, u long, v long")
    assert intervals.overlapping_any_length(a, year, ("s", "e"), ("u", "v")).count() == sum(0 < e and s < 31_536_000 for _, s, e in map(tuple, a.collect()))


def test_exact_quantiles(spark):
    """Equal to percentile(): a hot group of many values, one of ties, one row, null keys; NaN and null don't count."""
    r = np.random.default_rng(6)
    rows = [("hot", float(v)) for v in r.lognormal(0, 3, 20_000)] + [("ties", float(v)) for v in r.integers(0, 4, 3000)] + [("one", 5.0), (None, 1.0), (None, 4.0), ("none", None), ("none", float("nan")), ("hot", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.005, 0.3, 0.5, 0.9999, 1.0]
    want = {}
    for x in d.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"), F.count("*").alias("n")).collect():
        want |= {(x.k, s): (pytest.approx(q, rel=1e-12), x.n) for s, q in zip(shares, x.q, strict=True)}
    for parts in (2, 100):
        got = {(x.k, x.share): (x.quantile, x.n) for x in quantiles.exact_quantiles(d, ["k"], "v", shares, parts).collect()}
        assert got == want
    counted = d.groupBy("k", "v").agg(F.count("*").alias("m"))
    assert {(x.k, x.share): (x.quantile, x.n) for x in quantiles.exact_quantiles(counted, ["k"], "v", shares, times="m").collect()} == want
    assert [x.quantile for x in quantiles.exact_quantiles(d.filter("k = 'one'"), [], "v", [0.5]).collect()] == [5.0]
    assert quantiles.exact_quantiles(d.limit(0), ["k"], "v", [0.5]).collect() == []


def test_no_task_merges_all_values(spark):
    """Maps of all values of a class grow with the table; cuts of runs do not."""
    d = "/root/testdata/sf0.001"
    for q in (signals.distinctive_features, learned.pruned_rows):
        out = q(spark, d)
        assert "percentile(" not in out._jdf.queryExecution().toString()
        assert out.count()


def test_first_period_makes_no_pairs(spark):
    rng = random.Random(7)
    periods = [(k, (s := rng.randrange(-50, 400)), s + rng.choice([0, 1, 7, 60, 300]), f"L{k % 5}") for k in range(120)]
    points = [(k, rng.randrange(-60, 700)) for k in range(300)] + [(300, None)]
    p = spark.createDataFrame(periods, "c long, u long, v long, l string")
    x = spark.createDataFrame(points, "id long, t long")
    want = {i: min(((u, c) for c, u, v, _ in periods if t is not None and u < t < v), default=(None, None))[1] for i, t in points}
    out = intervals.first_period(x, p, "id", "t", "u", "v", ["u", "c"], 50)
    assert {r.id: r.c for r in out.collect()} == want and out.count() == len(points)
    closed = {i: min(((u, c) for c, u, v, _ in periods if t is not None and u <= t < v), default=(None, None))[1] for i, t in points}
    w = x.selectExpr("id", "t - 3 AS s", "t + 3 AS e")
    got = {r.id: r.c for r in intervals.period_labels(w, p.selectExpr("CAST(c AS string) AS c", "u", "v", "c AS k"), "id", ("s", "e"), ("u", "v"), ["u", "k"], ["c"], "one", 50).collect()}
    assert got == {i: "none" if c is None else str(c) for i, c in closed.items()}
    copies = spark.range(4000).selectExpr("id AS c", "id % 2 AS u", "100L AS v", "'a' AS l")
    plan = intervals.first_period(spark.range(4000).selectExpr("id", "50L AS t"), copies, "id", "t", "u", "v", ["u", "c"], 50)
    assert {r.c for r in plan.collect()} == {0}
    assert "_bucket" not in "".join(x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_periods_without_points(spark):
    rng = random.Random(8)
    periods = [(k, (s := rng.randrange(-50, 400)), s + rng.choice([0, 1, 7, 60, 300])) for k in range(120)]
    times = [rng.randrange(-60, 700) for _ in range(25)] + [None]
    p, x = spark.createDataFrame(periods, "c long, u long, v long"), spark.createDataFrame([(t,) for t in times], "t long")
    out = intervals.without_points(p, x, "c", "t", "u", "v", 50)
    assert sorted(r.c for r in out.collect()) == [c for c, u, v in periods if not any(t is not None and u <= t < v for t in times)]
    assert "t#" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
