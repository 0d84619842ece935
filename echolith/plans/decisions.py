"""Queries on predictions, decisions and counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import evaluation as E
from echolith.operators import pathways as PW
from echolith.operators import predictions as P

from . import mapping as M

C = M.CLASSES
MIN_SCORE = 0.05


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def _events(spark: SparkSession, d: str) -> DataFrame:
    return P.event_predictions(M.predictions(spark, d), "grp", C)


def block_decisions(spark, d):
    out = P.block_decisions(M.predictions(spark, d), "grp", 6 * 3600 * S.US, C, MIN_SCORE)
    return r6(out.select("grp", "block_us", *C, "n_detections", "score", "decision"), *C, "score")


def validate_output_report(spark, d):
    return P.validate(M.predictions(spark, d), ["detection_id"])


def to_wide(spark, d):
    return r6(P.to_wide(M.predictions(spark, d), ["detection_id", "voc_type"], C), *C)


def event_predictions(spark, d):
    return r6(_events(spark, d).select("grp", *C, "n_detections", "true_class", "predicted", "score"), *C, "score")


def group_predictions_min_score(spark, d):
    return r6(P.group_predictions(M.wide(spark, d), "grp", C, 0.2).select("grp", *C, "n", "n_total", "true_class"), *C)


def threshold_curve(spark, d):
    return r6(P.threshold_curve(_events(spark, d), 51, 0.0002), "threshold", "coverage", "accuracy")


def confusion_matrix(spark, d):
    return P.confusion(_events(spark, d), C)


def performance_by_class(spark, d):
    return r6(P.performance(_events(spark, d), 0.002), "coverage", "recall")


def event_features_pivot(spark, d):
    out = P.event_features(M.predictions(spark, d), "grp", M.TYPES, C)
    return r6(out, *(f"{t}|{c}" for t in M.TYPES for c in C))


def _counts(spark, d):
    e = M.detections(spark, d)
    return e.groupBy("grp").agg(*(F.count_if(F.col("voc_type") == t).alias(f"n_{t}") for t in M.TYPES))


def filter_events_and(spark, d):
    return P.filter_events(_counts(spark, d), {"click": 14, "whistle": 14}, "and")


def filter_events_or(spark, d):
    return P.filter_events(_counts(spark, d), {"click": 18, "whistle": 18, "burst": 1}, "or")


def time_bin_events(spark, d):
    e = M.detections(spark, d).withColumn("bin_us", S.floor_to(F.col("t_us"), 1800 * S.US))
    return e.groupBy("bin_us").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def dl_blocks(spark, d):
    w = M.wide(spark, d).filter("voc_type <> 'other'").withColumn("block_us", S.floor_to(F.col("t_us"), 3600 * S.US))
    b = w.groupBy("block_us").agg(*(F.avg(c).alias(c) for c in C), F.count("*").alias("n"))
    probs = [F.col(c) for c in C]
    return r6(b.withColumn("decision", F.when(F.col("n") < 2, "uncertain").otherwise(S.decide(probs, C, 0.02))), *C)


def type_rows(spark, d):
    out = P.block_vectors(M.predictions(spark, d), [F.col("grp"), S.floor_to(F.col("t_us"), 86_400 * S.US).alias("block_us")], ["click"], C)
    return r6(out.select("grp", "block_us", "n_click", *(F.when(F.col("has_click") > 0, F.col(f"click|{c}")).alias(c) for c in C)), *C)


def capped_counts(spark, d):
    return P.capped_counts(M.clustered(spark, d), "cluster", "unit", "label", 2)


def cluster_shares(spark, d):
    c = M.clustered(spark, d)
    out = c.groupBy("unit").pivot("cluster", list(range(8))).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(str(k)) for k in range(1, 8)), F.col("0"))
    return r6(out.select("unit", *((F.col(str(k)) / total).alias(f"c{k}") for k in range(8)), total.alias("n")), *(f"c{k}" for k in range(8)))


def loo_subtraction(spark, d):
    out = P.left_out(M.clustered(spark, d), "cluster", "unit", "label", 2)
    return r6(out.withColumn("share", (F.col("n_rest") + 1.0) / (F.col("total_rest") + 10.0)), "share")


def majority_truth(spark, d):
    return P.majority(M.clustered(spark, d), ["cluster"], "label")


def strict_majority_vote(spark, d):
    e = M.detections(spark, d).withColumn("block_us", S.floor_to(F.col("t_us"), 3600 * S.US))
    m = P.majority(e, ["block_us"], "voc_type")
    return m.select("block_us", "n_all", F.when(2 * F.col("n") > F.col("n_all"), F.col("majority")).otherwise("uncertain").alias("decision"))


RULES = [("n_click", ">=", 5.0, "clicks"), ("mean_value", "<", 30.0, "faint"), ("n_all", "==", 1.0, "single")]


def _block_stats(spark, d):
    e = M.detections(spark, d).withColumn("block_us", S.floor_to(F.col("t_us"), 3600 * S.US))
    return e.groupBy("block_us").agg(F.count("*").alias("n_all"), F.count_if(F.col("voc_type") == "click").alias("n_click"), F.avg("value").alias("mean_value"))


def rules_case_when(spark, d):
    return r6(_block_stats(spark, d).withColumn("decision", S.rule_chain(RULES, F.lit("uncertain"))), "mean_value")


def requires_na(spark, d):
    b = _block_stats(spark, d).withColumn("species", F.when(F.col("n_click") >= 3, "toothed").otherwise("baleen"))
    return b.select("block_us", "species", F.when(F.col("species") != "toothed", "n/a").when(F.col("mean_value") > 50, "A").otherwise("B").alias("ecotype"))


def merge_evidence(spark, d):
    v = P.block_vectors(M.predictions(spark, d), [F.col("grp"), S.floor_to(F.col("t_us"), 86_400 * S.US).alias("block_us")], ["click", "whistle"], C)
    click = [F.when(F.col("has_click") > 0, F.col(f"click|{c}")) for c in C]
    two = F.col("whistle|C1") + F.col("whistle|C2")  # whistles do not know the third class
    whistle = [*(F.when(F.col("has_whistle") > 0, F.col(f"whistle|{c}") / two) for c in C[:2]), F.lit(None).cast("double")]
    merged = S.merge_evidence([click, whistle], [[0.3, 0.3, 0.4], [0.45, 0.55, None]], [1.0, 0.5])
    return v.select("grp", "block_us", *(F.round(m, 9).alias(c) for m, c in zip(merged, C, strict=True)))


def cap_per_group(spark, d):
    return P.cap_per_group(M.detections(spark, d), "grp", [(F.col("detection_id") * 7919) % 10007, F.col("detection_id")], 5).select("grp", "detection_id")


def top_labels(spark, d):
    per = M.clustered(spark, d).groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return P.cap_per_group(per, "cluster", [F.desc("n"), F.col("label")], 5)


def year_share(spark, d):
    o = M.read(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))
    total = o.groupBy("o_orderpriority").agg(F.sum("n").alias("t"))
    return r6(o.join(total, "o_orderpriority").select("o_orderpriority", "year", (F.col("n") / F.col("t")).alias("share")), "share")


def decision_window_metrics(spark, d):
    """Detections of the first two classes; a third class or a low score is undecided."""
    x = M.wide(spark, d).withColumns({"predicted": S.decide([F.col(c) for c in C], C, 0.1), "day": S.day_of(F.col("t_us"))})
    out = E.decision_windows(x, "day", "t_us", "true_class", "predicted", ("C1", "C2"), [5, 60, 720])
    return r6(out, "coverage", "recall", "precision", "accuracy_when_predicted", "f1", "skill")


def pathway_two_layers(spark, d):
    """Layer 1 decides C1 or the group of C2 and C3; layer 2 divides that group; the deepest confident decision holds."""
    e = _events(spark, d)
    group = F.col("C2") + F.col("C3")
    first = F.when(F.abs(F.col("C1") - group) < 0.3, "uncertain").when(F.col("C1") > group, "C1").otherwise("C2+C3")
    second = F.when(F.abs(F.col("C2") - F.col("C3")) / group < 0.02, "uncertain").when(F.col("C2") > F.col("C3"), "C2").otherwise("C3")
    x = e.withColumn("layer1", first).withColumn("layer2", F.when(F.col("layer1") == "C2+C3", second).otherwise("n/a"))
    return x.select("grp", "layer1", "layer2", F.when(F.col("layer2").isin("n/a", "uncertain"), F.col("layer1")).otherwise(F.col("layer2")).alias("decision"))


_TREE = PW.Layer(
    "top", {"C1": ("C1",), "rest": ("C2", "C3")}, 0.02,
    {"rest": PW.Layer("rest_layer", {"C2": ("C2",), "C3": ("C3",)}, 0.01)},
)


def pathway_descent(spark, d):
    """Layers with groups of classes and least scores, to the deepest confident decision."""
    return PW.descend(_events(spark, d), _TREE, C).select("grp", "top", "rest_layer", "path", "decision")


def pathway_summaries(spark, d):
    return PW.summaries(PW.descend(_events(spark, d), _TREE, C), _TREE, "true_class")


def label_mapping(spark, d):
    groups = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "low", "5-LOW": "low"}
    lookup = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    o = M.read(spark, d, "orders").withColumn("grp", F.coalesce(F.try_element_at(lookup, F.col("o_orderpriority")), F.lit("none")))
    return o.groupBy("grp").agg(F.count("*").alias("n"))


_P6 = "round(C1, 6) AS C1, round(C2, 6) AS C2, round(C3, 6) AS C3"
_TOP = "list_reverse_sort([C1, C2, C3])"
_SCORE = f"({_TOP}[1] * ({_TOP}[1] - {_TOP}[2]))"
_ARG = "CASE WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END"
_TYPES = ", ".join(
    f'coalesce(round("a_{t}_{c}" / nullif("a_{t}_C1" + "a_{t}_C2" + "a_{t}_C3", 0), 6), 0) AS "{t}|{c}"' for t in M.TYPES for c in C
)
_AVGS = ", ".join(f"""coalesce(avg({c}) FILTER (voc_type = '{t}'), 0) AS "a_{t}_{c}" """ for t in M.TYPES for c in C)
_NS = ", ".join(f"count(*) FILTER (voc_type = '{t}') AS n_{t}" for t in M.TYPES)
_DAY = "t_us // 86400000000 * 86400000000"
_ML = """CASE WHEN n_click > 0 THEN ln(greatest(ck1, 1e-9) / 0.3) ELSE 0 END + CASE WHEN n_whistle > 0 THEN 0.5 * ln(greatest(wh1, 1e-9) / 0.45) ELSE 0 END AS l1,
CASE WHEN n_click > 0 THEN ln(greatest(ck2, 1e-9) / 0.3) ELSE 0 END + CASE WHEN n_whistle > 0 THEN 0.5 * ln(greatest(wh2, 1e-9) / 0.55) ELSE 0 END AS l2, CASE WHEN n_click > 0 THEN ln(greatest(ck3, 1e-9) / 0.4) ELSE 0 END AS l3"""

_DESC = f"""{M.EVENTS_PRED}, l1 AS (SELECT grp, true_class, C1 AS a, C2 + C3 AS b, C2 / (C2 + C3) AS c, C3 / (C2 + C3) AS d FROM e),
l2 AS (SELECT grp, true_class, CASE WHEN greatest(a, b) * abs(a - b) < 0.02 THEN 'uncertain' WHEN a >= b THEN 'C1' ELSE 'rest' END AS top, CASE WHEN greatest(c, d) * abs(c - d) < 0.01 THEN 'uncertain' WHEN c >= d THEN 'C2' ELSE 'C3' END AS low FROM l1),
dec AS (SELECT grp, true_class, top, CASE WHEN top = 'rest' THEN low ELSE 'n/a' END AS rest_layer FROM l2)"""

SQL = {
    "block_decisions": f"""WITH {M.PRED},
t AS (SELECT grp, t_us // 21600000000 * 21600000000 AS block_us, voc_type, avg(C1) AS a, avg(C2) AS b, avg(C3) AS c, count(*) AS n FROM wide GROUP BY ALL),
x AS (SELECT grp, block_us, avg(a / (a + b + c)) AS C1, avg(b / (a + b + c)) AS C2, avg(c / (a + b + c)) AS C3, CAST(sum(n) AS BIGINT) AS n_detections FROM t GROUP BY ALL)
SELECT grp, block_us, {_P6}, n_detections, round({_SCORE}, 6) AS score, CASE WHEN {_SCORE} < {MIN_SCORE} THEN 'uncertain' ELSE {_ARG} END AS decision FROM x""",
    "validate_output_report": f"""WITH {M.PRED},
k AS (SELECT detection_id, class, count(*) AS n FROM pred GROUP BY ALL), s AS (SELECT detection_id, sum(probability) AS s FROM pred GROUP BY ALL)
SELECT count(*) AS n_rows, count(*) FILTER (class IS NULL OR probability IS NULL) AS n_null, count(*) FILTER (voc_type NOT IN ('whistle', 'click', 'other')) AS n_bad_type,
count(*) FILTER (probability < 0 OR probability > 1) AS n_out_of_range, (SELECT count(*) FROM k WHERE n > 1) AS n_duplicate_keys, (SELECT count(*) FROM s WHERE abs(s - 1) > 0.01) AS n_bad_sum FROM pred""",
    "to_wide": f"WITH {M.PRED} SELECT detection_id, voc_type, {_P6} FROM wide",
    "event_predictions": f"WITH {M.EVENTS_PRED} SELECT grp, {_P6}, n_detections, true_class, predicted, round(score, 6) AS score FROM e",
    "group_predictions_min_score": f"""WITH {M.PRED}, s AS (SELECT *, {_SCORE} >= 0.2 AS ok FROM wide)
SELECT grp, round(avg(C1) FILTER (ok), 6) AS C1, round(avg(C2) FILTER (ok), 6) AS C2, round(avg(C3) FILTER (ok), 6) AS C3, count(*) FILTER (ok) AS n, count(*) AS n_total, min(true_class) AS true_class FROM s GROUP BY grp""",
    "threshold_curve": f"""WITH {M.EVENTS_PRED}, t AS (SELECT unnest(range(51)) AS k),
b AS (SELECT k, count(*) FILTER (least(floor(score / 0.0002 + 1e-9), 50) >= k) AS n_decided, count(*) FILTER (least(floor(score / 0.0002 + 1e-9), 50) >= k AND predicted = true_class) AS ok, count(*) AS n FROM t, e GROUP BY k)
SELECT round(CAST(k AS DOUBLE) * CAST(0.0002 AS DOUBLE), 6) AS threshold, n_decided, round(n_decided / n, 6) AS coverage, round(ok / nullif(n_decided, 0), 6) AS accuracy FROM b""",
    "confusion_matrix": f"""WITH {M.EVENTS_PRED} SELECT true_class, count(*) FILTER (predicted = 'C1') AS C1, count(*) FILTER (predicted = 'C2') AS C2, count(*) FILTER (predicted = 'C3') AS C3 FROM e GROUP BY true_class""",
    "performance_by_class": f"""WITH {M.EVENTS_PRED} SELECT true_class, count(*) AS n, count(*) FILTER (score >= 0.002) AS n_decided, round(count(*) FILTER (score >= 0.002) / count(*), 6) AS coverage,
round(count(*) FILTER (score >= 0.002 AND predicted = true_class) / nullif(count(*) FILTER (score >= 0.002), 0), 6) AS recall FROM e GROUP BY true_class""",
    "event_features_pivot": f"""WITH {M.PRED}, a AS (SELECT grp, {_AVGS}, {_NS}, min(t_us) AS first_us, max(t_us) AS last_us FROM wide GROUP BY grp)
SELECT grp, {_TYPES}, n_click, n_whistle, n_other, first_us, last_us FROM a""",
    "filter_events_and": f"WITH {M.EV} SELECT grp, {_NS} FROM ev GROUP BY grp HAVING count(*) FILTER (voc_type = 'click') >= 14 AND count(*) FILTER (voc_type = 'whistle') >= 14",
    "filter_events_or": f"WITH {M.EV} SELECT grp, {_NS} FROM ev GROUP BY grp HAVING count(*) FILTER (voc_type = 'click') >= 18 OR count(*) FILTER (voc_type = 'whistle') >= 18",
    "time_bin_events": f"WITH {M.EV} SELECT t_us // 1800000000 * 1800000000 AS bin_us, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us FROM ev GROUP BY 1",
    "dl_blocks": f"""WITH {M.PRED}, b AS (SELECT t_us // 3600000000 * 3600000000 AS block_us, avg(C1) AS C1, avg(C2) AS C2, avg(C3) AS C3, count(*) AS n FROM wide WHERE voc_type <> 'other' GROUP BY 1)
SELECT block_us, {_P6}, n, CASE WHEN n < 2 OR {_SCORE} < 0.02 THEN 'uncertain' ELSE {_ARG} END AS decision FROM b""",
    "type_rows": f"""WITH {M.PRED}, b AS (SELECT grp, {_DAY} AS block_us, count(*) FILTER (voc_type = 'click') AS n_click, avg(C1) FILTER (voc_type = 'click') AS a, avg(C2) FILTER (voc_type = 'click') AS b, avg(C3) FILTER (voc_type = 'click') AS c FROM wide GROUP BY ALL)
SELECT grp, block_us, n_click, round(a / (a + b + c), 6) AS C1, round(b / (a + b + c), 6) AS C2, round(c / (a + b + c), 6) AS C3 FROM b""",
    "capped_counts": f"WITH {M.CL}, p AS (SELECT cluster, unit, label, count(*) AS c FROM cl GROUP BY ALL) SELECT cluster, label, CAST(sum(least(c, 2)) AS BIGINT) AS n, count(*) AS n_units FROM p GROUP BY ALL",
    "cluster_shares": f"WITH {M.CL} SELECT unit, {', '.join(f'round(count(*) FILTER (cluster = {k}) / count(*), 6) AS c{k}' for k in range(8))}, count(*) AS n FROM cl GROUP BY unit",
    "loo_subtraction": f"""WITH {M.CL}, p AS (SELECT cluster, unit, label, least(count(*), 2) AS c FROM cl GROUP BY ALL),
g AS (SELECT u.cluster, u.unit, l.label, l.n - coalesce(p.c, 0) AS n_rest, t.t - u.u AS total_rest FROM (SELECT cluster, unit, sum(c) AS u FROM p GROUP BY ALL) u
JOIN (SELECT cluster, label, sum(c) AS n FROM p GROUP BY ALL) l USING (cluster) JOIN (SELECT cluster, sum(c) AS t FROM p GROUP BY ALL) t USING (cluster) LEFT JOIN p ON p.cluster = u.cluster AND p.unit = u.unit AND p.label = l.label)
SELECT cluster, unit, label, CAST(n_rest AS BIGINT) AS n_rest, CAST(total_rest AS BIGINT) AS total_rest, round((n_rest + 1.0) / (total_rest + 10.0), 6) AS share FROM g""",
    "majority_truth": f"""WITH {M.CL}, p AS (SELECT cluster, label, count(*) AS c FROM cl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, label) AS k, sum(c) OVER (PARTITION BY cluster) AS n_all FROM p)
SELECT cluster, label AS majority, c AS n, CAST(n_all AS BIGINT) AS n_all FROM r WHERE k = 1""",
    "strict_majority_vote": f"""WITH {M.EV}, p AS (SELECT t_us // 3600000000 * 3600000000 AS block_us, voc_type, count(*) AS c FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY block_us ORDER BY c DESC, voc_type) AS k, sum(c) OVER (PARTITION BY block_us) AS n_all FROM p)
SELECT block_us, CAST(n_all AS BIGINT) AS n_all, CASE WHEN 2 * c > n_all THEN voc_type ELSE 'uncertain' END AS decision FROM r WHERE k = 1""",
    "rules_case_when": f"""WITH {M.EV}, b AS (SELECT t_us // 3600000000 * 3600000000 AS block_us, count(*) AS n_all, count(*) FILTER (voc_type = 'click') AS n_click, avg(value) AS m FROM ev GROUP BY 1)
SELECT block_us, n_all, n_click, round(m, 6) AS mean_value, CASE WHEN n_click >= 5 THEN 'clicks' WHEN m < 30 THEN 'faint' WHEN n_all = 1 THEN 'single' ELSE 'uncertain' END AS decision FROM b""",
    "requires_na": f"""WITH {M.EV}, b AS (SELECT t_us // 3600000000 * 3600000000 AS block_us, count(*) FILTER (voc_type = 'click') AS n_click, avg(value) AS m FROM ev GROUP BY 1)
SELECT block_us, CASE WHEN n_click >= 3 THEN 'toothed' ELSE 'baleen' END AS species, CASE WHEN n_click < 3 THEN 'n/a' WHEN m > 50 THEN 'A' ELSE 'B' END AS ecotype FROM b""",
    "merge_evidence": f"""WITH {M.PRED}, a0 AS (SELECT grp, {_DAY} AS block_us, {_AVGS}, {_NS} FROM wide GROUP BY grp, 2),
a AS (SELECT grp, block_us, n_click, n_whistle, {', '.join(f'"a_click_{c}" / nullif("a_click_C1" + "a_click_C2" + "a_click_C3", 0) AS ck{c[1]}' for c in C)}, {', '.join(f'"a_whistle_{c}" / nullif("a_whistle_C1" + "a_whistle_C2", 0) AS wh{c[1]}' for c in C[:2])} FROM a0),
l AS (SELECT *, {_ML} FROM a), x AS (SELECT *, exp(l1 - greatest(l1, l2, l3)) AS a, exp(l2 - greatest(l1, l2, l3)) AS b, exp(l3 - greatest(l1, l2, l3)) AS c FROM l)
SELECT grp, block_us, CASE WHEN n_click > 0 AND n_whistle > 0 THEN round(a / (a + b + c), 9) WHEN n_click > 0 THEN round(ck1, 9) WHEN n_whistle > 0 THEN round(wh1, 9) END AS C1,
CASE WHEN n_click > 0 AND n_whistle > 0 THEN round(b / (a + b + c), 9) WHEN n_click > 0 THEN round(ck2, 9) WHEN n_whistle > 0 THEN round(wh2, 9) END AS C2, CASE WHEN n_click > 0 AND n_whistle > 0 THEN round(c / (a + b + c), 9) WHEN n_click > 0 THEN round(ck3, 9) WHEN n_whistle > 0 THEN 0 END AS C3 FROM x""",
    "cap_per_group": f"WITH {M.EV}, r AS (SELECT grp, detection_id, row_number() OVER (PARTITION BY grp ORDER BY detection_id * 7919 % 10007, detection_id) AS k FROM ev) SELECT grp, detection_id FROM r WHERE k <= 5",
    "top_labels": f"WITH {M.CL}, p AS (SELECT cluster, label, count(*) AS n FROM cl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k FROM p) SELECT cluster, label, n FROM r WHERE k <= 5",
    "year_share": "WITH o AS (SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, CAST(year AS BIGINT) AS year, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM o",
    "decision_window_metrics": f"""WITH {M.PRED}, x AS (SELECT t_us // 86400000000 AS day, t_us, true_class AS y, CASE WHEN {_SCORE} < 0.1 OR {_ARG} = 'C3' THEN 'uncertain' ELSE {_ARG} END AS p FROM wide WHERE true_class IN ('C1', 'C2')),
k AS (SELECT m.m, day, t_us // (CAST(m.m AS BIGINT) * 60000000) AS blk, CASE WHEN count(*) FILTER (y = 'C2') > count(*) FILTER (y = 'C1') THEN 'C2' ELSE 'C1' END AS y,
CASE WHEN 2 * count(*) FILTER (p = 'C1') > count(*) FILTER (p <> 'uncertain') THEN 'C1' WHEN 2 * count(*) FILTER (p = 'C2') > count(*) FILTER (p <> 'uncertain') THEN 'C2' ELSE 'uncertain' END AS p FROM x, (VALUES (5), (60), (720)) m(m) GROUP BY ALL),
b AS (SELECT 'window' AS w, y, p FROM x UNION ALL SELECT m || 'min', y, p FROM k), l AS (SELECT DISTINCT w, c FROM b, (VALUES ('C1'), ('C2')) v(c)),
q AS (SELECT l.w, l.c, count(*) FILTER (y = c) AS n, count(*) FILTER (y = c AND p <> 'uncertain') / nullif(count(*) FILTER (y = c), 0) AS cov, count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (y = c), 0) AS rec,
count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (p = c), 0) AS prec, count(*) FILTER (y = c AND p = c) / nullif(count(*) FILTER (y = c AND p <> 'uncertain'), 0) AS acc FROM l JOIN b ON l.w = b.w GROUP BY ALL),
f AS (SELECT *, CASE WHEN prec > 0 AND rec > 0 THEN 2 * prec * rec / (prec + rec) END AS f1, cov * coalesce(acc, 0.5) + (1 - cov) * 0.5 AS eff FROM q)
SELECT w AS decision_window, c AS "class", n AS n_blocks, round(cov, 6) AS coverage, round(rec, 6) AS recall, round(prec, 6) AS precision, round(acc, 6) AS accuracy_when_predicted, round(f1, 6) AS f1, CAST(NULL AS DOUBLE) AS skill FROM f
UNION ALL SELECT w, 'overall', n, round(cov, 6), round(rec, 6), NULL, round(acc, 6), round(f1, 6), round((eff - 0.5) / 0.5, 6) + 0.0 FROM (SELECT w, count(*) AS n, count(*) FILTER (p <> 'uncertain') / count(*) AS cov, count(*) FILTER (p = y) / nullif(count(*) FILTER (p <> 'uncertain'), 0) AS acc FROM b GROUP BY w)
JOIN (SELECT w, avg(rec) AS rec, avg(f1) AS f1, avg(eff) AS eff FROM f GROUP BY w) USING (w)""",
    "pathway_two_layers": f"""WITH {M.EVENTS_PRED}, x AS (SELECT grp, C2, C3, CASE WHEN abs(C1 - (C2 + C3)) < 0.3 THEN 'uncertain' WHEN C1 > C2 + C3 THEN 'C1' ELSE 'C2+C3' END AS layer1 FROM e),
y AS (SELECT grp, layer1, CASE WHEN layer1 <> 'C2+C3' THEN 'n/a' WHEN abs(C2 - C3) / (C2 + C3) < 0.02 THEN 'uncertain' WHEN C2 > C3 THEN 'C2' ELSE 'C3' END AS layer2 FROM x)
SELECT grp, layer1, layer2, CASE WHEN layer2 IN ('n/a', 'uncertain') THEN layer1 ELSE layer2 END AS decision FROM y""",
    "pathway_descent": f"""WITH {_DESC} SELECT grp, top, rest_layer, CASE WHEN top = 'uncertain' THEN '' WHEN rest_layer IN ('C2', 'C3') THEN 'rest > ' || rest_layer ELSE top END AS path,
CASE WHEN rest_layer IN ('C2', 'C3') THEN rest_layer ELSE top END AS decision FROM dec""",
    "pathway_summaries": f"""WITH {_DESC}, x AS (SELECT 'top' AS layer, top AS d, CASE true_class WHEN 'C1' THEN 'C1' ELSE 'rest' END AS t FROM dec UNION ALL SELECT 'rest_layer', rest_layer, true_class FROM dec WHERE true_class <> 'C1' AND rest_layer <> 'n/a')
SELECT layer, count(*) AS n, count(*) FILTER (d <> 'uncertain') AS n_decided, count(*) FILTER (d = t) AS n_correct FROM x GROUP BY layer""",
    "label_mapping": "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'low' ELSE 'none' END AS grp, count(*) AS n FROM orders GROUP BY 1",
}

QUERIES = {name: globals()[name] for name in SQL}
