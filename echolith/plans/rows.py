"""Queries on tables of rows between stages and on event classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import predictions as P
from echolith.operators import tables as T
from echolith.operators import transfer as TL
from echolith.operators import windows as W
from echolith.operators.models import ForestParams

from . import mapping as M
from .decisions import r6

C = M.CLASSES
_SPEC = T.FeatureSpec(("value", "extra", "absent"), ("extra",), {"value": 50.0, "absent": 2.0}, ("value",), {"value": 3.0, "absent": 1.0}, {"value": 0.5, "extra": 2.0})


def event_constants(spark, d):
    """The type and the day are constants of few events, the remainder of all."""
    e = M.detections(spark, d).select("grp", "voc_type", S.day_of(F.col("t_us")).alias("day"), (F.col("grp") % 7).alias("rest"), F.when(F.col("detection_id") % 50 == 0, F.col("grp") % 3).alias("rare"))
    return T.event_constants(e, "grp")


def detection_rows(spark, d):
    w = M.wide(spark, d)
    return r6(T.detection_rows(w, "detection_id", "grp", C, "forest", "click", "t_us", "true_class"), "probability", "score")


def detection_ids(spark, d):
    return M.detections(spark, d).select("detection_id", T.detection_id("grp", "t_us").alias("frame_id"), T.block_id(F.col("grp"), F.floor(F.col("t_us") / 600_000_000) * 600).alias("block_id"))


def first_rows(spark, d):
    """The earliest detection of each group and type."""
    return T.first_rows(M.detections(spark, d).select("grp", "voc_type", "t_us", "detection_id", "value"), ["grp", "voc_type"], ["t_us", "detection_id"])


def _blocks(spark, d):
    p = M.predictions(spark, d).withColumn("block_start", F.floor(F.col("t_us") / (3600 * S.US)) * 3600)
    keys = [F.col("grp").alias("event_id"), F.col("block_start"), T.block_id(F.col("grp"), F.col("block_start")).alias("block_id"), F.col("true_class")]
    return P.block_vectors(p, keys, M.TYPES, C)


def type_rows(spark, d):
    return r6(T.type_rows(_blocks(spark, d), "click", C), *(f"p_{c}" for c in C))


def held_out_rows(spark, d):
    p = M.predictions(spark, d).filter("voc_type = 'click'").withColumn("s", F.floor(F.col("t_us") / (3600 * S.US)) * 3600)
    p = p.select(T.block_id(F.col("grp"), F.col("s")).alias("detection_id"), F.col("grp").alias("event_id"), "true_class", "class", "probability")
    return r6(T.held_out_rows(p, [*C, "C4"]), *(f"p_{c}" for c in C))


def feature_spec_rows(spark, d):
    """A frozen spec: a column with gaps, one whose gaps are 0, one that is absent."""
    e = M.detections(spark, d).select("detection_id", F.when(F.col("detection_id") % 9 > 0, F.col("value")).alias("value"), F.when(F.col("detection_id") % 4 > 0, F.col("value") / 10).alias("extra"))
    return r6(T.apply_spec(e, _SPEC), "value", "extra", "absent")


def annotation_windows(spark, d):
    calls = M.calls(spark, d).select("call_id", F.col("c_start").alias("s"), F.col("c_end").alias("e"), F.col("call_label").alias("label"))
    heard = M.detections(spark, d).filter("voc_type = 'whistle' AND value > 20").select(F.col("t_us").alias("s"), F.col("end_us").alias("e"))
    return T.annotation_labels(T.annotation_windows(calls, heard, "call_id", "s", "e", 2 * S.US, 60 * S.US), calls, "call_id")


def cross_validation_groups(spark, d):
    e = M.detections(spark, d).select("detection_id", "voc_type", S.day_of(F.col("t_us")).alias("day"), (F.col("t_us") / S.US).alias("s"))
    return T.cv_groups(e, "voc_type", "day", "s", 10, "block")[0].select("detection_id", "cv_group")


def frame_predictions(spark, d):
    return r6(T.frame_predictions(M.wide(spark, d), "t_us", 4 * S.US, C, ["voc_type"]), *(f"p_{c}" for c in C), "confidence", "score")


def frame_table(spark, d):
    """Held-out predictions with the measures of their frame; frames of purchases have none."""
    p = M.predictions(spark, d).withColumn("detection_id", T.detection_id("grp", "t_us")).withColumn("event_id", F.col("grp"))
    f = M.detections(spark, d).filter("event_type <> 'purchase'").groupBy("grp", "t_us").agg(F.max("value").alias("density"))
    return r6(T.frame_table(p, f, C, "grp", "t_us").drop("t_us"), *(f"p_{c}" for c in C), "confidence", "score")


def events_without_frames(spark, d):
    e = M.detections(spark, d).withColumnRenamed("grp", "event_id")
    return T.events_without_frames(e, e.filter("event_type = 'purchase'"))


def _events(spark, d):
    p = M.predictions(spark, d)
    return TL.event_table(p.withColumn("event_id", F.col("voc_type")).withColumn("detection_id", F.col("grp")), C)


def event_table(spark, d):
    return r6(_events(spark, d), *C, "score")


def transfer_summary(spark, d):
    return r6(TL.summarise(_events(spark, d), 0.002), "event_accuracy", "mean_class_accuracy", "events_discarded")


def transfer_curve(spark, d):
    return r6(TL.summary_curve(_events(spark, d), [k * 0.002 for k in range(11)]), "threshold", "event_accuracy", "mean_class_accuracy", "events_kept")


def click_spectral_windows(spark, d):
    """Windows of six hours every three; a click's measures are made of its value."""
    e = M.detections(spark, d).filter("voc_type = 'click'").select("detection_id", S.day_of(F.col("t_us")).alias("day"), "t_us", F.when(F.col("detection_id") % 11 > 0, F.col("value") * 100).alias("peak_hz"), (F.col("value") + 7).alias("bw3_hz"), (F.col("value") / 1000).alias("csp_0_1"))
    out = W.click_windows(e, "day", "t_us", 21_600 * S.US, 10_800 * S.US, 600 * S.US, 0, 3, ["peak_hz", "bw3_hz"], ["csp_0_1"])
    exact = ["ici_mean_s", "ici_median_s", "ici_p05_s", "ici_p95_s"]  # 6 digits would round halves either way
    return r6(out, *(c for c, t in out.dtypes if t == "double" and c not in exact)).withColumns({c: F.round(c, 9) for c in exact})


_S = "list_reverse_sort([C1, C2, C3])"
_SCORED = f"{_S}[1] * ({_S}[1] - {_S}[2])"
_ARGMAX = "CASE WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END"
_ROUND = ", ".join(f"round({c}, 6) AS p_{c}" for c in C)
# Seconds of one to three decimals.
_TEXT = "grp || '_' || regexp_replace(printf('%d.%03d', round_even(t_us / 1000.0, 0)::BIGINT // 1000, round_even(t_us / 1000.0, 0)::BIGINT % 1000), '(\\.\\d+?)0+$', '\\1')"
_MEANS = f"tm AS (SELECT grp, avg(C1) AS C1, avg(C2) AS C2, avg(C3) AS C3, min(voc_type) AS g, min(true_class) AS true_class FROM wide GROUP BY grp), te AS (SELECT grp AS event, C1, C2, C3, g, true_class, {_ARGMAX} AS predicted, {_SCORED} AS score FROM tm)"

SQL = {
    "event_constants": f"""WITH {M.EV}, x AS (SELECT grp, voc_type, strftime(make_timestamp(t_us), '%Y%m%d') AS day, grp % 7 AS rest, CASE WHEN detection_id % 50 = 0 THEN grp % 3 END AS rare FROM ev)
SELECT grp, CASE WHEN count(DISTINCT voc_type) = 1 THEN max(voc_type) END AS voc_type, CASE WHEN count(DISTINCT day) = 1 THEN max(day) END AS day, max(rest) AS rest, max(rare) AS rare FROM x GROUP BY grp""",
    "detection_rows": f"WITH {M.PRED}, s AS (SELECT detection_id, {_SCORED} AS score FROM wide) SELECT CAST(detection_id AS VARCHAR) AS detection_id, CAST(grp AS VARCHAR) AS event_id, t_us AS time, 'forest' AS classifier, 'click' AS voc_type, class, round(probability, 6) AS probability, round(score, 6) AS score, true_class FROM pred JOIN s USING (detection_id)",
    "detection_ids": f"WITH {M.EV} SELECT detection_id, {_TEXT} AS frame_id, grp || '@' || (t_us // 600000000 * 600) AS block_id FROM ev",
    "first_rows": f"WITH {M.EV} SELECT grp, voc_type, t_us, detection_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY grp, voc_type ORDER BY t_us, detection_id) = 1",
    "type_rows": f"""WITH {M.PRED}, b AS (SELECT grp, t_us // 3600000000 * 3600 AS s, true_class, avg(C1) FILTER (voc_type = 'click') AS a, avg(C2) FILTER (voc_type = 'click') AS b, avg(C3) FILTER (voc_type = 'click') AS c FROM wide GROUP BY ALL)
SELECT true_class AS "true", grp AS unit, grp || '@' || s AS block, CAST(s AS DOUBLE) AS w_start, round(a / (a + b + c), 6) AS p_C1, round(b / (a + b + c), 6) AS p_C2, round(c / (a + b + c), 6) AS p_C3 FROM b""",
    "held_out_rows": f"""WITH {M.PRED} SELECT true_class AS "true", grp AS unit, grp || '@' || (t_us // 3600000000 * 3600) AS block, CAST(t_us // 3600000000 * 3600 AS DOUBLE) AS w_start, round(avg(C1), 6) AS p_C1, round(avg(C2), 6) AS p_C2, round(avg(C3), 6) AS p_C3, CAST(0 AS DOUBLE) AS p_C4
FROM wide WHERE voc_type = 'click' GROUP BY ALL""",
    "feature_spec_rows": f"WITH {M.EV} SELECT detection_id, round((ln(1 + coalesce(CASE WHEN detection_id % 9 > 0 THEN value END, 50)) - 3) / 0.5, 6) + 0.0 AS value, round(coalesce(CASE WHEN detection_id % 4 > 0 THEN value / 10 END, 0) / 2, 6) AS extra, CAST(1 AS DOUBLE) AS absent FROM ev",
    "annotation_windows": f"""WITH {M.CALLS}, h AS (SELECT min(t_us) AS a, max(end_us) AS z FROM ev WHERE voc_type = 'whistle' AND value > 20)
SELECT call_id, c_start - 2000000 AS w_start, c_end + 2000000 AS w_end, call_label AS label FROM calls, h WHERE c_start >= a - 60000000 AND c_end <= z + 60000000""",
    "cross_validation_groups": f"WITH {M.EV} SELECT detection_id, strftime(make_timestamp(t_us), '%Y%m%d') || '_' || (t_us // 600000000 * 600) AS cv_group FROM ev",
    "frame_predictions": f"""WITH {M.PRED} SELECT t_us AS frame_start, t_us + 4000000 AS frame_end, strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS start_utc, strftime(make_timestamp(t_us + 4000000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS end_utc, strftime(make_timestamp(t_us), '%Y%m%d') AS day, voc_type,
{_ROUND}, {_ARGMAX} AS predicted, round(greatest(C1, C2, C3), 6) AS confidence, round({_SCORED}, 6) AS score FROM wide""",
    "frame_table": f"""WITH {M.PRED}, i AS (SELECT {_TEXT} AS id, grp, true_class, avg(C1) AS C1, avg(C2) AS C2, avg(C3) AS C3 FROM wide GROUP BY ALL), g AS (SELECT grp, t_us, max(value) AS density FROM ev WHERE event_type <> 'purchase' GROUP BY ALL),
f AS (SELECT {_TEXT} AS id, density FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY t_us) = 1), p AS (SELECT *, {_ARGMAX} AS predicted FROM i)
SELECT p.id AS detection_id, grp AS event_id, true_class, {_ROUND}, predicted, predicted = true_class AS correct, round(greatest(C1, C2, C3), 6) AS confidence, round({_SCORED}, 6) AS score, density FROM p LEFT JOIN f ON f.id = p.id""",
    "click_spectral_windows": f"""WITH {M.EV}, c AS (SELECT detection_id, strftime(make_timestamp(t_us), '%Y%m%d') AS day, t_us, CASE WHEN detection_id % 11 > 0 THEN value * 100 END AS peak, value + 7 AS bw, value / 1000 AS p FROM ev WHERE voc_type = 'click'),
g AS (SELECT *, min(t_us) OVER (PARTITION BY day) // 60000000 * 60000000 AS g FROM c), k AS (SELECT *, unnest([0, 1]) AS j FROM g), w AS (SELECT *, g + ((t_us - g) // 10800000000 - j) * 10800000000 AS w_start FROM k WHERE (t_us - g) // 10800000000 >= j),
l AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY day, w_start ORDER BY t_us, detection_id) AS d FROM w), i AS (SELECT *, CASE WHEN d <= 600000000 AND d > 0 THEN d / 1000000.0 END AS ici FROM l)
SELECT day, w_start, w_start + 21600000000 AS w_end, count(*) AS n_clicks, count(ici) AS n_intervals, round(avg(ici), 9) AS ici_mean_s, round(CASE WHEN count(ici) = 1 THEN 0 ELSE stddev_samp(ici) END, 6) AS ici_std_s, round(median(ici), 9) AS ici_median_s, round(quantile_cont(ici, 0.05), 9) AS ici_p05_s, round(quantile_cont(ici, 0.95), 9) AS ici_p95_s,
round(median(peak), 6) AS click_peak_hz_median, round(median(bw), 6) AS click_bw3_hz_median, round(quantile_cont(peak, 0.75) - quantile_cont(peak, 0.25), 6) AS click_peak_hz_iqr, round(avg(p), 6) AS csp_0_1 FROM i GROUP BY day, w_start HAVING count(*) >= 3 AND count(ici) > 0""",
    "events_without_frames": f"WITH {M.EV} SELECT grp AS event_id FROM ev GROUP BY grp HAVING count(*) FILTER (event_type = 'purchase') = 0",
    "event_table": f'WITH {M.PRED}, {_MEANS} SELECT event, round(C1, 6) AS C1, round(C2, 6) AS C2, round(C3, 6) AS C3, g AS "group", true_class, predicted, round(score, 6) AS score FROM te',
    "transfer_summary": f"""WITH {M.PRED}, {_MEANS}, p AS (SELECT true_class, count(*) AS n, count(*) FILTER (score >= 0.002) AS k, count(*) FILTER (score >= 0.002 AND predicted = true_class) AS r FROM te GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(r) / sum(k), 6) AS event_accuracy, round(avg(r / nullif(k, 0)), 6) AS mean_class_accuracy, round(1 - sum(k) / sum(n), 6) AS events_discarded FROM p""",
    "transfer_curve": f"""WITH {M.PRED}, {_MEANS}, t AS (SELECT i * CAST(0.002 AS DOUBLE) AS t FROM range(0, 11) r(i)), p AS (SELECT t, true_class, count(*) AS n, count(*) FILTER (score >= t) AS k, count(*) FILTER (score >= t AND predicted = true_class) AS r FROM te, t GROUP BY ALL)
SELECT round(t, 6) AS threshold, round(sum(r) / nullif(sum(k), 0), 6) AS event_accuracy, round(avg(r / nullif(k, 0)), 6) AS mean_class_accuracy, round(sum(k) / sum(n), 6) AS events_kept FROM p GROUP BY t""",
}

QUERIES = {name: globals()[name] for name in SQL}


def transfer_cross_validation(spark, d):
    """Forests of events without each of five groups; random streams have no SQL form."""
    e = P.event_features(M.predictions(spark, d).withColumn("grp", F.col("grp") % 200), "grp", ["click", "whistle"], C)
    e = e.withColumn("truth", F.concat(F.lit("C"), 1 + F.col("grp") % 3)).withColumn("part", F.col("grp") % 5)
    features = [f"{t}|{c}" for t in ("click", "whistle") for c in C]
    e = e.withColumnsRenamed({f: f.replace("|", "_") for f in features})
    out = TL.cross_validate(e, [f.replace("|", "_") for f in features], "truth", "part", "grp", ForestParams(trees=20, node_size=5, max_per_group=0))
    return TL.event_table(out, C).groupBy("true_class").agg(F.count("*").alias("n"))


QUERIES["transfer_cross_validation"] = transfer_cross_validation
