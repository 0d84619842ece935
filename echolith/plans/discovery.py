"""Queries on discovery, libraries, contours and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import contours as K
from echolith.operators import discovery as D
from echolith.operators import library as L
from echolith.sources import settings as T

from . import mapping as M
from .decisions import r6


def _labelled(spark, d):
    e = M.detections(spark, d)
    label = F.when(F.col("detection_id") % 5 == 0, "none").when(F.col("detection_id") % 5 == 1, "mixed").when(F.col("detection_id") % 5 == 2, None).otherwise(F.concat(F.lit("L"), F.col("grp") % 3))
    return e.select("detection_id", "grp", S.day_of(F.col("t_us")).alias("day"), label.alias("label"), "value", "t_us", "end_us")


def discovery_pool(spark, d):
    u = _labelled(spark, d)
    return D.pool(u, "label", "day", u.filter("value > 400"), include_none=True).groupBy("pool", "day").agg(F.count("*").alias("n"))


def range_filters(spark, d):
    e = _labelled(spark, d).withColumn("v", F.when(F.col("label") != "none", F.col("value")))
    return e.filter(D.in_ranges({"v": (10.0, 90.0), "grp": (5, None)})).select("detection_id", F.coalesce("v", F.lit(-1.0)).alias("v"))


def labels_with_groups(spark, d):
    li = M.read(spark, d, "customer").withColumn("g", F.col("c_nationkey"))
    return D.with_enough_groups(li, "c_mktsegment", "g", 3).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def label_checks(spark, d):
    out = D.label_checks(_labelled(spark, d).fillna("unlabelled", ["label"]), "label", "grp", "t_us", "end_us")
    return out.select("label", "n_groups", "n", F.col("span").alias("span_us"))


def event_spans(spark, d):
    return D.spans(M.detections(spark, d), "grp", "t_us", "end_us", "voc_type")


def class_shares(spark, d):
    return r6(D.class_shares(M.clustered(spark, d), "cluster", "unit", "label", 3), "weight", "p")


def cluster_summary(spark, d):
    return r6(D.summary(M.clustered(spark, d), "cluster", "label", "unit"), "label_share", "unit_share")


def library_assign(spark, d):
    """The library's centroids are the first vector of each label; units beyond the gate are -1."""
    e = M.read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    out = L.assign(e, "vec_id", "v", c, "label", "c", 0.9)
    return out.select("vec_id", F.col("cluster").cast("long").alias("cluster"), F.round("distance", 6).alias("distance"))


def _contours(spark, d):
    x = F.transform("embedding", lambda v: 8000 + 20_000 * v.cast("double"))
    return M.read(spark, d, "embeddings").select("vec_id", x.alias("freqs"), F.transform("embedding", lambda v, i: i * 0.01).alias("times"), F.lit(0.01).alias("s"))


def prepared_contours(spark, d):
    out = K.prepare(_contours(spark, d), "times", "freqs", "s", 5000.0, 11_000.0, 0.5)
    return out.select("vec_id", F.col("n_points").cast("long").alias("n_points"), F.round("duration_s", 6).alias("duration_s"))


def contour_histogram(spark, d):
    p = _contours(spark, d).select("vec_id", F.explode("freqs").alias("f"))
    return r6(K.histogram(p, ["vec_id"], "f", 2000.0, 500.0, 24), "share")


def sample_rate_consensus(spark, d):
    e = M.detections(spark, d).select("grp", (F.col("t_us") / 1e6 - 1_704_000_000).alias("sec"))
    e = e.withColumn("sample", F.col("sec") * (96_000 + F.col("grp") % 3) + 5)
    return T.consensus(T.sample_rates(e, "grp", "sample", "sec"), "rate")


def timeline_cells(spark, d):
    hour = F.floor(F.pmod(F.col("t_us"), F.lit(86_400 * S.US)) / (3600 * S.US)).cast("long")
    return M.detections(spark, d).groupBy(S.day_of(F.col("t_us")).alias("day"), hour.alias("hour"), "voc_type").agg(F.count("*").alias("n"))


def feature_stats(spark, d):
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    e = M.detections(spark, d).groupBy("event_type").agg(q.alias("q"))
    return r6(e.select("event_type", *(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q05", "q50", "q95")))), "q05", "q50", "q95")


def value_histogram(spark, d):
    b = F.greatest(F.lit(0), F.least(F.lit(38), F.floor(F.col("value") / 5))).cast("long")
    return M.detections(spark, d).groupBy("voc_type", b.alias("bin")).agg(F.count("*").alias("n"))


_LAB = M.EV + """, lab AS (SELECT detection_id, grp, strftime(make_timestamp(t_us), '%Y%m%d') AS day, CASE detection_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'mixed' WHEN 2 THEN NULL ELSE 'L' || (grp % 3) END AS label, value, t_us, end_us FROM ev)"""
_CON = "con AS (SELECT vec_id, unnest(range(0, len(embedding))) * CAST(0.01 AS DOUBLE) AS t, 8000 + 20000 * CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings)"

SQL = {
    "discovery_pool": f"""WITH {_LAB}, a AS (SELECT DISTINCT day FROM lab WHERE value > 400), p AS (SELECT lab.day, CASE WHEN label IS NOT NULL AND label NOT IN ('none', 'mixed') THEN 'typed' WHEN a.day IS NULL THEN 'unannotated' WHEN coalesce(label, 'none') = 'none' THEN 'none' ELSE 'other' END AS pool FROM lab LEFT JOIN a ON a.day = lab.day)
SELECT pool, day, count(*) AS n FROM p WHERE pool <> 'other' GROUP BY ALL""",
    "range_filters": f"WITH {_LAB}, x AS (SELECT detection_id, grp, CASE WHEN label <> 'none' THEN value END AS v FROM lab) SELECT detection_id, coalesce(v, -1) AS v FROM x WHERE NOT coalesce(v < 10, false) AND NOT coalesce(v > 90, false) AND grp >= 5",
    "labels_with_groups": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) >= 3",
    "label_checks": f"WITH {_LAB} SELECT coalesce(label, 'unlabelled') AS label, count(DISTINCT grp) AS n_groups, count(*) AS n, CAST(sum(end_us - t_us) AS BIGINT) AS span_us FROM lab GROUP BY 1",
    "event_spans": f"""WITH {M.EV}, p AS (SELECT grp, voc_type, count(*) AS c FROM ev GROUP BY ALL), r AS (SELECT grp, voc_type, row_number() OVER (PARTITION BY grp ORDER BY c DESC, voc_type) AS k FROM p)
SELECT ev.grp, min(t_us) AS start, max(end_us) AS "end", min(r.voc_type) AS label FROM ev JOIN r ON r.grp = ev.grp AND k = 1 GROUP BY ev.grp""",
    "class_shares": f"""WITH {M.CL}, p AS (SELECT cluster, unit, label, least(count(*), 3) AS c FROM cl GROUP BY ALL), n AS (SELECT cluster, label, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_units FROM p GROUP BY ALL),
t AS (SELECT label, sum(n) AS t FROM n GROUP BY 1), w AS (SELECT label, sum(t) OVER () / count(*) OVER () / t AS weight, count(*) OVER () AS k FROM t), x AS (SELECT n.*, weight, k, n * weight AS wn FROM n JOIN w USING (label))
SELECT cluster, label, n, n_units, round(weight, 6) AS weight, round((wn + 10.0 / k) / (sum(wn) OVER (PARTITION BY cluster) + 10), 6) AS p FROM x""",
    "cluster_summary": f"""WITH {M.CL}, l AS (SELECT cluster, label, count(*) AS c FROM cl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, label) AS k FROM l), u AS (SELECT cluster, unit, count(*) AS c FROM cl GROUP BY ALL), v AS (SELECT cluster, count(*) AS n_units, max(c) AS m FROM u GROUP BY 1)
SELECT r.cluster, CAST(sum(c) AS BIGINT) AS n, max(n_units) AS n_units, string_agg(label || ':' || c, ';' ORDER BY k) FILTER (k <= 3) AS top_labels, round(max(c) / sum(c), 6) AS label_share, round(max(m) / sum(c), 6) AS unit_share FROM r JOIN v ON v.cluster = r.cluster GROUP BY r.cluster""",
    "library_assign": f"""WITH {M.CL}, f AS (SELECT label, min(vec_id) AS vec_id FROM cl GROUP BY 1), p AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM cl), c AS (SELECT p.label AS c, k, x AS m FROM p JOIN f ON f.vec_id = p.vec_id AND f.label = p.label),
d AS (SELECT vec_id, c, round(1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS d FROM p JOIN c USING (k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS n FROM d)
SELECT vec_id, CASE WHEN d > 0.9 THEN -1 ELSE c END AS cluster, round(d, 6) + 0.0 AS distance FROM r WHERE n = 1""",
    "prepared_contours": f"WITH {_CON} SELECT vec_id, count(*) AS n_points, round(max(t) - min(t) + 0.01, 6) AS duration_s FROM con WHERE f >= 5000 AND f <= 11000 GROUP BY vec_id HAVING count(*) >= 3 AND max(t) - min(t) + CAST(0.01 AS DOUBLE) >= 0.5",
    "contour_histogram": f"WITH {_CON}, h AS (SELECT vec_id, CAST(floor((f - 2000) / 500) AS INTEGER) AS bin, count(*) AS c FROM con WHERE floor((f - 2000) / 500) BETWEEN 0 AND 23 GROUP BY ALL) SELECT vec_id, bin, round(c / sum(c) OVER (PARTITION BY vec_id), 6) AS share FROM h",
    "sample_rate_consensus": f"""WITH {M.EV}, x AS (SELECT grp, t_us / 1e6 - 1704000000 AS sec FROM ev), s AS (SELECT grp, regr_slope(sec * (96000 + grp % 3) + 5, sec) AS s FROM x GROUP BY 1), p AS (SELECT CASE WHEN abs(s - 96000) <= 480 THEN 96000.0 ELSE round(s) END AS v, count(*) AS c FROM s GROUP BY 1)
SELECT (SELECT CAST(v AS DOUBLE) FROM p ORDER BY c DESC, v LIMIT 1) AS value, count(*) AS n_values FROM p""",
    "timeline_cells": f"WITH {M.EV} SELECT strftime(make_timestamp(t_us), '%Y%m%d') AS day, t_us % 86400000000 // 3600000000 AS hour, voc_type, count(*) AS n FROM ev GROUP BY ALL",
    "feature_stats": "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1",
    "value_histogram": f"WITH {M.EV} SELECT voc_type, CAST(greatest(0, least(38, floor(value / 5))) AS BIGINT) AS bin, count(*) AS n FROM ev GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in SQL}


def class_verdicts(spark, d):
    """Beta bounds have no SQL form."""
    return D.class_verdicts(D.class_shares(M.clustered(spark, d), "cluster", "unit", "label", 50, across=True), "cluster", "label")


QUERIES["class_verdicts"] = class_verdicts
