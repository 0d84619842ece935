"""Queries on time, intervals and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import intervals as I
from echolith.operators import library as LB
from echolith.operators import quantiles as Q
from echolith.operators import windows as W
from echolith.sources import tables as T
from echolith.sources.durable import cut
from echolith.sources.sqlite import recording_events

from . import mapping as M
from .decisions import r6

BUCKET = 600 * S.US


def label_by_interval(spark, d):
    det = M.detections(spark, d).filter("event_type <> 'purchase'").select("detection_id", "t_us")
    return I.containing(det, M.calls(spark, d), "t_us", "c_start", "c_end", BUCKET).select("detection_id", "call_id", "call_label")


def label_first_period(spark, d):
    det = M.detections(spark, d).select("detection_id", "t_us")
    return I.first_period(det, M.calls(spark, d), "detection_id", "t_us", "c_start", "c_end", ["c_start", "call_id"], BUCKET).select("detection_id", F.coalesce("call_id", F.lit(-1)).alias("call_id"), F.coalesce("call_label", F.lit("none")).alias("label"))


def _windows(spark, d):
    return M.detections(spark, d).filter("voc_type = 'whistle'").select("detection_id", "t_us", (F.col("t_us") + 120 * S.US).alias("w_end"))


def label_windows_best_overlap(spark, d):
    out = I.best_overlap(_windows(spark, d), M.calls(spark, d), "detection_id", ("t_us", "w_end"), ("c_start", "c_end"), "call_id", "call_label", BUCKET, 0.3)
    return r6(out, "cover")


def label_by_overlap_mixed(spark, d):
    out = I.best_overlap(_windows(spark, d), M.calls(spark, d), "detection_id", ("t_us", "w_end"), ("c_start", "c_end"), "call_id", "call_label", BUCKET, 0.5, of="window")
    return r6(out, "cover")


def label_by_overlap_values(spark, d):
    """Labels renamed by a map; one of them is weak and gives way to any other."""
    names = {"L0": "A", "L1": "A", "L2": "B"}
    return I.overlap_labels(_windows(spark, d), M.calls(spark, d), "detection_id", ("t_us", "w_end"), ("c_start", "c_end"), "call_label", BUCKET, names, "weak", ("weak",))


def label_by_periods(spark, d):
    """Two sources in turn: the first covers even calls and stays, the second all calls."""
    w, c = _windows(spark, d), M.calls(spark, d)
    for source, part in (("first", c.filter("call_id % 2 = 0")), ("second", c)):
        w = I.period_labels(w, part, "detection_id", ("t_us", "w_end"), ("c_start", "c_end"), ["c_start", "call_id"], ["call_label"], source, BUCKET)
    return w.select("detection_id", "call_label", "label_source")


def events_without_detections(spark, d):
    det = M.detections(spark, d).filter("event_type <> 'purchase'").select("t_us")
    return I.without_points(M.calls(spark, d), det, "call_id", "t_us", "c_start", "c_end", BUCKET).select("call_id", "call_label")


def sliding_windows(spark, d):
    det = M.detections(spark, d).withColumn("day", S.floor_to(F.col("t_us"), 86_400 * S.US))
    w = W.sliding(det, ["day"], "t_us", "end_us", 240 * S.US, 120 * S.US, 60 * S.US)
    return r6(w.groupBy("day", "w_start").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")), "mean_value")


def frames_membership(spark, d):
    det = M.detections(spark, d).withColumn("day", S.floor_to(F.col("t_us"), 86_400 * S.US)).withColumn("key", F.concat_ws("@", "grp", "day"))
    return W.frames(det, "key", "t_us", "end_us", 4 * S.US, 2 * S.US).select("key", "detection_id", "frame", "frame_start")


def period_filled_blocks(spark, d):
    w = 300 * S.US
    det = M.detections(spark, d).groupBy(S.floor_to(F.col("t_us"), w).alias("block_us")).agg(F.count("*").alias("n"))
    p = M.detections(spark, d).agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    out = W.filled_blocks(p, det, "a", "b", "block_us", w)
    return out.select("block_us", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), "no_detections").otherwise("some").alias("decision"))


def ici_lag(spark, d):
    c = M.detections(spark, d).filter("voc_type = 'click'")
    return W.intervals_between(c, ["grp"], "t_us", 86_400 * S.US).select("detection_id", "grp", F.coalesce("ici", F.lit(-1)).alias("ici"))


def click_window_features(spark, d):
    c = M.detections(spark, d).filter("voc_type = 'click'").withColumn("w_start", S.floor_to(F.col("t_us"), 21_600 * S.US))
    out = W.interval_features(W.intervals_between(c, ["w_start"], "t_us", 3600 * S.US), ["w_start"])
    return r6(out, "ici_mean", "ici_std", "ici_median", "ici_p05", "ici_p95").withColumn("ici_std", F.round("ici_std", 2)).withColumn("ici_mean", F.round("ici_mean", 2)).withColumn("ici_p05", F.round("ici_p05", 2)).withColumn("ici_p95", F.round("ici_p95", 2)).withColumn("ici_median", F.round("ici_median", 2))


def sessionise_labels(spark, d):
    s = I.sessions(M.detections(spark, d), ["voc_type"], "t_us", "end_us", 1200 * S.US)
    return s.groupBy("voc_type", "session").agg(F.min("t_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).filter("n >= 3")


def unit_ids(spark, d):
    det = M.detections(spark, d).withColumn("t_us", S.floor_to(F.col("t_us"), 600 * S.US))
    return W.unit_ids(det, "t_us", "detection_id").select("detection_id", "unit_id")


def snr_top_fraction(spark, d):
    e = M.detections(spark, d)
    q = e.groupBy("grp").agg(F.percentile("value", F.lit(0.8)).alias("q"))
    return e.join(q, "grp").filter("value >= q").select("detection_id", "grp", "value")


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def standardise(spark, d):
    li = M.read(spark, d, "lineitem")
    s = li.groupBy("l_returnflag").agg(*(F.avg(c).alias(f"m_{c}") for c in _FEATURES), *(F.stddev_pop(c).alias(f"s_{c}") for c in _FEATURES))
    z = li.join(F.broadcast(s), "l_returnflag").select("l_orderkey", "l_linenumber", *(F.round((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"), 4).alias(c) for c in _FEATURES))
    return z.withColumns({c: F.col(c) + F.lit(0.0) for c in _FEATURES})


def feature_spec_stats(spark, d):
    e = M.detections(spark, d)
    n, s = F.count("value"), F.skewness("value")
    out = e.groupBy("voc_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), (s * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    return r6(out.withColumn("log1p", (F.col("skew") > 2) & (F.col("low") >= 0)), "median", "std", "low", "skew")


def nearest_centroid(spark, d):
    """Nearest class centroid by cosine."""
    e = M.clustered(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = e.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    cent = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("c")).select(F.col("label").alias("nearest"), F.transform("c", lambda x: x["m"]).alias("c"))
    near = LB.assign(e, "vec_id", "v", cent, "nearest", "c", carry=["label"])
    return near.select("vec_id", "label", F.col("cluster").alias("nearest"), (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def _spectra(spark, d):
    return M.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x"))


def _long(df, col="x"):
    return df.select("vec_id", F.posexplode(col).alias("bin", "v")).withColumn("v", F.round("v", 6))


def spectrum_smooth(spark, d):
    return _long(_spectra(spark, d).select("vec_id", S.smooth(F.col("x"), 3).alias("x")))


def spectrum_downsample(spark, d):
    return _long(_spectra(spark, d).select("vec_id", S.downsample(F.col("x"), 5).alias("x")))


def spectrum_normalise(spark, d):
    return _long(_spectra(spark, d).select("vec_id", S.normalise_sum(S.trim(F.col("x"), 8, 40)).alias("x")))


def spectrum_peak_span(spark, d):
    x = F.col("x")
    top = F.array_max(x)
    on = F.filter(F.transform(x, lambda v, i: F.when(v > top / 2, i)), lambda i: i.isNotNull())
    s = _spectra(spark, d).select("vec_id", (F.array_position(x, top) - 1).cast("long").alias("peak"), F.array_min(on).cast("long").alias("first"), F.array_max(on).cast("long").alias("last"))
    return s.withColumn("span", F.col("last") - F.col("first") + 1)


def whistle_histogram(spark, d):
    e = M.detections(spark, d).filter("voc_type = 'whistle'").withColumn("bin", F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("long"))
    h = e.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    return r6(h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).drop("n"), "share")


def recordings_as_events(spark, d):
    """Per recorder the last signup is the start; the last row within 24 hours the end."""
    e = M.detections(spark, d)
    out = recording_events(e, "grp", "t_us", "event_type = 'signup'", 86_400 * S.US)
    return out.select("grp", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def json_predictions(spark, d):
    e = M.detections(spark, d)
    return T.json_probabilities(e.withColumn("json", F.format_string('{"predictions": [[%s, 10]]}', F.get_json_object("props", "$.k"))), "detection_id", "json", ["A", "B"]).withColumn("probability", F.round("probability", 6))


def distinctive_features(spark, d):
    """Of each flag the two features whose median is farthest from the overall median, in interquartile ranges."""
    li = M.read(spark, d, "lineitem").select("l_returnflag", *_FEATURES)
    long = cut(li.unpivot(["l_returnflag"], _FEATURES, "feature", "x").groupBy("l_returnflag", "feature", "x").agg(F.count("*").alias("n")))
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("quantile")))
    q = Q.exact_quantiles(long, ["feature"], "x", [0.25, 0.5, 0.75], times="n").groupBy("feature").agg(at(0.25).alias("a"), at(0.5).alias("b"), at(0.75).alias("c"))
    m = Q.exact_quantiles(long, ["l_returnflag", "feature"], "x", [0.5], times="n").join(F.broadcast(q), "feature")
    far = m.withColumn("distance", F.round(F.abs(F.col("quantile") - F.col("b")) / (F.col("c") - F.col("a")), 6))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("distance"), "feature")
    return far.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("l_returnflag", "feature", "distance", F.col("k").cast("long").alias("k"))


def file_pruning_lead(spark, d):
    """Files (signups of a group) run until the next one starts; those that a call period touches are kept."""
    f = M.detections(spark, d).filter("event_type = 'signup'").select("detection_id", "grp", F.col("t_us").alias("f_start"))
    f = T.file_spans(f, ["grp"], "f_start", "f_end", 3600 * S.US)
    c = M.detections(spark, d).filter("event_type = 'purchase'").select(F.col("grp").alias("g"), F.col("t_us").alias("c_start"), (F.col("t_us") + M.CALL_US).alias("c_end"))
    return f.join(c, (F.col("grp") == F.col("g")) & (F.col("c_start") < F.col("f_end")) & (F.col("c_end") > F.col("f_start")), "left_semi").select("detection_id", "grp")


_OVER = M.CALLS + """, win AS (SELECT detection_id, t_us, t_us + 120000000 AS w_end FROM ev WHERE voc_type = 'whistle'),
pairs AS (SELECT detection_id, call_id, call_label, least(w_end, c_end) - greatest(t_us, c_start) AS o, w_end - t_us AS ws, c_end - c_start AS cs FROM win JOIN calls ON c_start < w_end AND c_end > t_us)"""


def _best(den: str, least: float, counted: str) -> str:
    return f"""WITH {_OVER}, r AS (SELECT *, o / {den} AS cover FROM pairs), t AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY cover >= {least} DESC, o DESC, call_id) AS k FROM r),
g AS (SELECT detection_id, count(DISTINCT call_label) FILTER ({counted}) AS n, max(call_label) FILTER (k = 1) AS label, max(cover) FILTER (k = 1) AS cover FROM t GROUP BY detection_id)
SELECT win.detection_id, CASE WHEN g.label IS NULL THEN 'none' WHEN n > 1 THEN 'mixed' WHEN cover < {least} THEN 'partial' ELSE g.label END AS label, coalesce(round(cover, 6), 0) AS cover FROM win LEFT JOIN g USING (detection_id)"""


_SPEC = "s AS (SELECT vec_id, [abs(CAST(v AS DOUBLE)) for v in embedding] AS x FROM embeddings), p AS (SELECT vec_id, unnest(range(0, len(x))) AS bin, unnest(x) AS v FROM s)"
_UNP = "li AS (" + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, {c} AS x FROM lineitem" for c in _FEATURES) + ")"

SQL = {
    "label_by_interval": f"WITH {M.CALLS} SELECT detection_id, call_id, call_label FROM ev JOIN calls ON t_us >= c_start AND t_us < c_end WHERE event_type <> 'purchase'",
    "label_first_period": f"""WITH {M.CALLS}, r AS (SELECT detection_id, call_id, call_label, row_number() OVER (PARTITION BY detection_id ORDER BY c_start, call_id) AS k FROM ev JOIN calls ON t_us > c_start AND t_us < c_end)
SELECT ev.detection_id, coalesce(call_id, -1) AS call_id, coalesce(call_label, 'none') AS label FROM ev LEFT JOIN r ON r.detection_id = ev.detection_id AND k = 1""",
    "label_windows_best_overlap": _best("cs", 0.3, "true"),
    "label_by_overlap_mixed": _best("ws", 0.5, "cover >= 0.5"),
    "label_by_overlap_values": f"""WITH {_OVER}, v AS (SELECT detection_id, CASE WHEN call_label IN ('L0', 'L1') THEN 'A' WHEN call_label = 'L2' THEN 'B' ELSE 'weak' END AS v FROM pairs),
g AS (SELECT detection_id, count(DISTINCT v) FILTER (v <> 'weak') AS n, min(v) FILTER (v <> 'weak') AS s FROM v GROUP BY 1)
SELECT win.detection_id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'mixed' WHEN n = 1 THEN s ELSE 'weak' END AS label FROM win LEFT JOIN g USING (detection_id)""",
    "label_by_periods": f"""WITH {M.CALLS}, w AS (SELECT detection_id, t_us + 60000000 AS mid FROM ev WHERE voc_type = 'whistle'),
h AS (SELECT detection_id, call_label, call_id % 2 AS odd, c_start, call_id FROM w JOIN calls ON mid >= c_start AND mid < c_end),
f AS (SELECT detection_id, arg_min(call_label, (c_start, call_id)) AS l FROM h WHERE odd = 0 GROUP BY 1), s AS (SELECT detection_id, arg_min(call_label, (c_start, call_id)) AS l FROM h GROUP BY 1)
SELECT detection_id, coalesce(f.l, s.l, 'none') AS call_label, CASE WHEN f.l IS NOT NULL THEN 'first' WHEN s.l IS NOT NULL THEN 'second' ELSE 'unannotated' END AS label_source FROM w LEFT JOIN f USING (detection_id) LEFT JOIN s USING (detection_id)""",
    "events_without_detections": f"WITH {M.CALLS} SELECT call_id, call_label FROM calls WHERE NOT EXISTS (SELECT 1 FROM ev WHERE event_type <> 'purchase' AND t_us >= c_start AND t_us < c_end)",
    "sliding_windows": f"""WITH {M.EV}, g AS (SELECT *, t_us // 86400000000 * 86400000000 AS day, min(t_us) OVER (PARTITION BY t_us // 86400000000) // 60000000 * 60000000 AS g FROM ev),
w AS (SELECT day, value, g + 120000000 * unnest(range(CAST(greatest(ceil((t_us - g - 240000000 + 1) / 120000000), 0) AS BIGINT), (end_us - 1 - g) // 120000000 + 1)) AS w_start FROM g)
SELECT day, w_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY ALL""",
    "frames_membership": f"""WITH {M.EV}, k AS (SELECT grp || '@' || (t_us // 86400000000 * 86400000000) AS key, detection_id, t_us, end_us FROM ev),
b AS (SELECT *, min(t_us) OVER (PARTITION BY key) AS t0, max(end_us) OVER (PARTITION BY key) AS t1 FROM k),
x AS (SELECT key, detection_id, t0, t1, unnest([t_us, end_us]) AS t FROM b), f AS (SELECT key, detection_id, t0, t1, t, (t - t0) // 2000000 - unnest([0, 1]) AS frame FROM x)
SELECT DISTINCT key, detection_id, frame, t0 + frame * 2000000 AS frame_start FROM f WHERE frame >= 0 AND t0 + frame * 2000000 < t1 AND t >= t0 + frame * 2000000 AND t < t0 + frame * 2000000 + 4000000""",
    "period_filled_blocks": f"""WITH {M.EV}, g AS (SELECT unnest(range((SELECT min(t_us) FROM ev) // 300000000 * 300000000, (SELECT max(t_us) FROM ev), 300000000)) AS block_us), c AS (SELECT t_us // 300000000 * 300000000 AS block_us, count(*) AS n FROM ev GROUP BY 1)
SELECT block_us, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_detections' ELSE 'some' END AS decision FROM g LEFT JOIN c USING (block_us)""",
    "ici_lag": f"WITH {M.EV}, l AS (SELECT detection_id, grp, t_us - lag(t_us) OVER (PARTITION BY grp ORDER BY t_us, detection_id) AS g FROM ev WHERE voc_type = 'click') SELECT detection_id, grp, CASE WHEN g <= 86400000000 AND g > 0 THEN g ELSE -1 END AS ici FROM l",
    "click_window_features": f"""WITH {M.EV}, w AS (SELECT t_us // 21600000000 * 21600000000 AS w_start, t_us, detection_id FROM ev WHERE voc_type = 'click'), l AS (SELECT w_start, t_us - lag(t_us) OVER (PARTITION BY w_start ORDER BY t_us, detection_id) AS g FROM w),
i AS (SELECT w_start, CASE WHEN g <= 3600000000 AND g > 0 THEN g END AS ici FROM l)
SELECT w_start, count(*) AS n, count(ici) AS n_intervals, round(avg(ici), 2) AS ici_mean, round(CASE WHEN count(ici) = 1 THEN 0 ELSE stddev_samp(ici) END, 2) AS ici_std,
round(quantile_cont(CAST(ici AS DOUBLE), 0.5), 2) AS ici_median, round(quantile_cont(CAST(ici AS DOUBLE), 0.05), 2) AS ici_p05, round(quantile_cont(CAST(ici AS DOUBLE), 0.95), 2) AS ici_p95 FROM i GROUP BY w_start""",
    "sessionise_labels": f"""WITH {M.EV}, r AS (SELECT *, max(end_us) OVER (PARTITION BY voc_type ORDER BY t_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ev),
s AS (SELECT voc_type, t_us, end_us, CAST(sum(CASE WHEN p IS NULL OR t_us - p > 1200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY voc_type ORDER BY t_us, end_us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM r)
SELECT voc_type, session, min(t_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3""",
    "unit_ids": f"""WITH {M.EV}, u AS (SELECT detection_id, CAST(t_us // 600000000 * 600 AS VARCHAR) || '.000' AS u, row_number() OVER (PARTITION BY t_us // 600000000 ORDER BY detection_id) - 1 AS k FROM ev) SELECT detection_id, CASE WHEN k = 0 THEN u ELSE u || '_' || k END AS unit_id FROM u""",
    "snr_top_fraction": f"WITH {M.EV}, q AS (SELECT grp, quantile_cont(value, 0.8) AS q FROM ev GROUP BY grp) SELECT detection_id, grp, value FROM ev JOIN q USING (grp) WHERE value >= q",
    "standardise": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w, 4) + 0.0 AS {c}" for c in _FEATURES) + " FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)",
    "feature_spec_stats": f"WITH {M.EV}, x AS (SELECT voc_type, median(value) AS median, stddev_samp(value) AS std, min(value) AS low, skewness(value) AS skew FROM ev GROUP BY 1) SELECT voc_type, round(median, 6) AS median, round(std, 6) AS std, round(low, 6) AS low, round(skew, 6) AS skew, skew > 2 AND low >= 0 AS log1p FROM x",
    "nearest_centroid": f"""WITH {M.CL}, p AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM cl), c AS (SELECT label AS nearest, k, avg(x) AS m FROM p GROUP BY ALL),
d AS (SELECT vec_id, label, nearest, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS distance FROM p JOIN c USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS n FROM d)
SELECT vec_id, label, nearest, distance FROM r WHERE n = 1""",
    "spectrum_smooth": f"WITH {_SPEC} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(avg(v) OVER (PARTITION BY vec_id ORDER BY bin ROWS 2 PRECEDING), 6) AS v FROM p",
    "spectrum_downsample": f"WITH {_SPEC} SELECT vec_id, CAST(bin // 5 AS INTEGER) AS bin, round(avg(v), 6) AS v FROM p GROUP BY ALL",
    "spectrum_normalise": f"WITH {_SPEC} SELECT vec_id, CAST(bin - 8 AS INTEGER) AS bin, round(v / sum(v) OVER (PARTITION BY vec_id), 6) AS v FROM p WHERE bin >= 8 AND bin < 40",
    "spectrum_peak_span": f"""WITH {_SPEC}, m AS (SELECT vec_id, bin, v, max(v) OVER (PARTITION BY vec_id) AS t FROM p)
SELECT vec_id, min(bin) FILTER (v = t) AS peak, min(bin) FILTER (v > t / 2) AS first, max(bin) FILTER (v > t / 2) AS last, max(bin) FILTER (v > t / 2) - min(bin) FILTER (v > t / 2) + 1 AS span FROM m GROUP BY vec_id""",
    "whistle_histogram": f"WITH {M.EV}, h AS (SELECT grp, CAST(least(floor(value / 10), 20) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE voc_type = 'whistle' GROUP BY ALL) SELECT grp, bin, round(n / sum(n) OVER (PARTITION BY grp), 6) AS share FROM h",
    "recordings_as_events": f"WITH {M.EV}, s AS (SELECT grp, max(t_us) AS start_us FROM ev WHERE event_type = 'signup' GROUP BY grp) SELECT grp, start_us, max(t_us) AS end_us FROM ev JOIN s USING (grp) WHERE t_us >= start_us AND t_us <= start_us + 86400000000 GROUP BY ALL HAVING max(t_us) > start_us",
    "json_predictions": f"WITH {M.EV}, k AS (SELECT detection_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM ev) SELECT detection_id, 'A' AS class, round(k / (k + 10), 6) AS probability FROM k UNION ALL SELECT detection_id, 'B', round(10 / (k + 10), 6) FROM k",
    "distinctive_features": f"""WITH {_UNP}, q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM li GROUP BY 1), m AS (SELECT l_returnflag, feature, quantile_cont(x, 0.5) AS m FROM li GROUP BY ALL),
f AS (SELECT l_returnflag, feature, round(abs(m - b) / (c - a), 6) AS distance FROM m JOIN q USING (feature)), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY distance DESC, feature) AS k FROM f) SELECT l_returnflag, feature, distance, k FROM r WHERE k <= 2""",
    "file_pruning_lead": f"""WITH {M.EV}, f AS (SELECT detection_id, grp, t_us AS f_start, coalesce(lead(t_us) OVER (PARTITION BY grp ORDER BY t_us), t_us + 3600000000) AS f_end FROM ev WHERE event_type = 'signup')
SELECT detection_id, grp FROM f WHERE EXISTS (SELECT 1 FROM ev WHERE event_type = 'purchase' AND ev.grp = f.grp AND t_us < f_end AND t_us + 300000000 > f_start)""",
}

QUERIES = {name: globals()[name] for name in SQL}
