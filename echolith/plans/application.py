"""Queries on the application of libraries, held-out verdicts and tables of rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.operators import application as A
from echolith.operators import discovery as D

from . import mapping as M
from .decisions import r6

_TASKS = [A.Task("kind", ("A", "B")), A.Task("eco", classes=("E1", "E2"), min_score=0.02)]
_WIDTH = 60_000_000
_RULES = [("block_meanfreq_range_hz", ">", 4200.0, "B"), ("n_contours", "<", 20.0, "A")]


def _windows(spark, d):
    """A window of 4 s every 3 s, its cluster from the vector's number; the last of the clusters says nothing."""
    e = M.read(spark, d, "embeddings")
    return e.select("vec_id", (F.col("vec_id") * 3_000_000).alias("w_start"), (F.col("vec_id") * 3_000_000 + 4_000_000).alias("w_end"), (F.col("label") % 7 - 1).cast("long").alias("cluster"), F.get("embedding", F.lit(1)).cast("double").alias("abs_slope"))


def _verdicts(spark):
    rows = [(0, "A", 0.9, 0.1), (1, "B", 0.2, 0.8), (2, "uncertain", 0.5, 0.5), (3, "A", 0.6, 0.4), (4, "B", 0.3, 0.7)]
    return spark.createDataFrame(rows, "cluster long, kind_pred string, eco_p_E1 double, eco_p_E2 double")


def classified_windows(spark, d):
    return A.classify_windows(_windows(spark, d), _verdicts(spark), _TASKS).select("vec_id", "cluster", "kind_pred", "eco_p_E1", "eco_p_E2")


def block_votes(spark, d):
    e = M.read(spark, d, "embeddings")
    start = F.col("vec_id") * 2_900_000
    calls = e.select(F.col("vec_id").alias("contour_id"), start.alias("start"), (start + 500_000 + F.col("vec_id") % 5 * 300_000).alias("end"), (8000 + 4000 * F.get("embedding", F.lit(0)).cast("double")).alias("mean_freq_hz"), (0.5 + F.col("vec_id") % 5 * 0.3).alias("duration_s"))
    w = A.classify_windows(_windows(spark, d).filter("vec_id % 90 < 60"), _verdicts(spark), _TASKS)
    out = A.block_votes(w, calls, _TASKS, _WIDTH, 10_000_000, _RULES, {"eco": ("kind", "A")}, (30_000_000, 900_000_000))
    return r6(out.drop("block_median_freq_hz"), *(c for c, t in out.dtypes if t == "double" and c != "block_median_freq_hz"))


def class_probabilities(spark, d):
    """Shares whose weights cap a unit's rows over its clusters together."""
    return r6(D.class_shares(M.clustered(spark, d), "cluster", "unit", "label", 3, across=True), "weight", "p")


def left_out_probabilities(spark, d):
    c = M.clustered(spark, d).withColumn("label", F.concat(F.lit("L"), F.col("label") % 3)).drop("embedding")
    out = A.left_out_probabilities(c, "cluster", "unit", "label", ["L0", "L1", "L2"], 20)
    return r6(out.select("vec_id", "unit", "cluster", "label", "p_L0", "p_L1", "p_L2"), "p_L0", "p_L1", "p_L2")


_VERDICTS = "v AS (SELECT * FROM (VALUES (0, 'A', 0.9, 0.1), (1, 'B', 0.2, 0.8), (2, 'uncertain', 0.5, 0.5), (3, 'A', 0.6, 0.4), (4, 'B', 0.3, 0.7)) t(cluster, kind, e1, e2))"
_W = f"""{_VERDICTS}, cw AS (SELECT vec_id, vec_id * 3000000 AS s, vec_id * 3000000 + 4000000 AS e, label % 7 - 1 AS cluster, CAST(embedding[2] AS DOUBLE) AS slope FROM embeddings),
w AS (SELECT cw.*, coalesce(kind, 'uncertain') AS kind, CAST(e1 AS DOUBLE) AS e1, CAST(e2 AS DOUBLE) AS e2 FROM cw LEFT JOIN v ON v.cluster = cw.cluster)"""

SQL = {
    "classified_windows": f"WITH {_W} SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, kind AS kind_pred, e1 AS eco_p_E1, e2 AS eco_p_E2 FROM w",
    "block_votes": f"""WITH {_W}, k AS (SELECT *, s - s % 60000000 AS b FROM w WHERE vec_id % 90 < 60),
c AS (SELECT vec_id AS id, vec_id * 2900000 AS s, vec_id * 2900000 + 500000 + vec_id % 5 * 300000 AS e, 8000 + 4000 * CAST(embedding[1] AS DOUBLE) AS f, 0.5 + vec_id % 5 * CAST(0.3 AS DOUBLE) AS d FROM embeddings),
h AS (SELECT DISTINCT b, id, f, d FROM k JOIN c ON c.s < k.e AND c.e > k.s), hb AS (SELECT b, count(*) AS nc, max(f) - min(f) AS r, median(d) AS md FROM h GROUP BY b),
q AS (SELECT b, cluster, count(*) AS n FROM k GROUP BY ALL), vt AS (SELECT b, string_agg(cluster || ':' || n, ';' ORDER BY n DESC, cluster) AS cv FROM q GROUP BY b),
a AS (SELECT b, count(*) AS n, count(*) FILTER (cluster >= 0) AS na, avg(e1) AS e1, avg(e2) AS e2, count(*) FILTER (kind = 'A') AS a, count(*) FILTER (kind = 'B') AS bb, median(slope) AS ms FROM k GROUP BY b),
g AS (SELECT unnest(range(0, 900000000, 60000000)) AS b),
x AS (SELECT g.b, coalesce(n, 0) AS n, coalesce(na, 0) AS na, coalesce(nc, 0) AS nc, e1, e2, greatest(e1, e2) * abs(e1 - e2) AS sc, coalesce(a, 0) AS a, coalesce(bb, 0) AS bb, ms, r, md, coalesce(cv, '') AS cv FROM g LEFT JOIN a ON a.b = g.b LEFT JOIN hb ON hb.b = g.b LEFT JOIN vt ON vt.b = g.b),
y AS (SELECT *, CASE WHEN n = 0 THEN 'no_detections' WHEN a > bb THEN 'A' WHEN bb > a THEN 'B' ELSE 'uncertain' END AS rk, CASE WHEN n = 0 THEN 'no_detections' WHEN sc IS NULL OR sc < 0.02 THEN 'uncertain' WHEN e1 >= e2 THEN 'E1' ELSE 'E2' END AS re,
  CASE WHEN n = 0 THEN NULL WHEN r > 4200 THEN 'block_meanfreq_range_hz > 4200' WHEN nc < 20 THEN 'n_contours < 20' END AS rule, CASE WHEN n = 0 THEN NULL WHEN r > 4200 THEN 'B' WHEN nc < 20 THEN 'A' END AS t FROM x),
z AS (SELECT *, coalesce(t, rk) AS kd FROM y)
SELECT CAST(b AS BIGINT) AS block_start, CAST(b + 60000000 AS BIGINT) AS block_end, n AS n_windows, na AS n_assigned, nc AS n_contours, kd AS kind, CASE WHEN n > 0 AND rule IS NULL AND kd <> 'A' THEN 'n/a' ELSE coalesce(t, re) END AS eco, rule, rk AS raw_kind, re AS raw_eco,
a AS kind_n_A, bb AS kind_n_B, round(greatest(a, bb) / nullif(a + bb, 0), 6) AS kind_vote_share, round(e1, 6) AS eco_p_E1, round(e2, 6) AS eco_p_E2, round(sc, 6) AS eco_score, round(ms, 6) + 0.0 AS block_median_abs_slope_hz_s, cv AS cluster_votes, round(r, 6) AS block_meanfreq_range_hz, round(md, 6) AS block_median_contour_s FROM z""",
    "class_probabilities": f"""WITH {M.CL}, p AS (SELECT cluster, unit, label, least(count(*), 3) AS c FROM cl GROUP BY ALL), n AS (SELECT cluster, label, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_units FROM p GROUP BY ALL),
u AS (SELECT unit, label, least(count(*), 3) AS c FROM cl GROUP BY ALL), t AS (SELECT label, sum(c) AS t FROM u GROUP BY 1), w AS (SELECT label, sum(t) OVER () / count(*) OVER () / t AS weight, count(*) OVER () AS k FROM t), x AS (SELECT n.*, weight, k, n * weight AS wn FROM n JOIN w USING (label))
SELECT cluster, label, n, n_units, round(weight, 6) AS weight, round((wn + 10.0 / k) / (sum(wn) OVER (PARTITION BY cluster) + 10), 6) AS p FROM x""",
    "left_out_probabilities": """WITH cl AS (SELECT vec_id, vec_id % 8 AS cluster, vec_id % 5 AS unit, 'L' || (label % 3) AS label FROM embeddings), un AS (SELECT DISTINCT unit AS o FROM cl),
r AS (SELECT o, cl.* FROM un JOIN cl ON cl.unit <> o), per AS (SELECT o, cluster, unit, label, least(count(*), 20) AS c FROM r GROUP BY ALL), n AS (SELECT o, cluster, label, sum(c) AS c FROM per GROUP BY ALL),
all_ AS (SELECT o, unit, label, least(count(*), 20) AS c FROM r GROUP BY ALL), t AS (SELECT o, label, sum(c) AS t FROM all_ GROUP BY ALL), w AS (SELECT o, label, sum(t) OVER (PARTITION BY o) / 3 / t AS w FROM t),
g AS (SELECT DISTINCT o, cluster, l AS label FROM r, (SELECT unnest(['L0', 'L1', 'L2']) AS l)), a AS (SELECT g.o, g.cluster, g.label, coalesce(c, 0) * w.w + 10.0 / 3 AS a FROM g JOIN w ON w.o = g.o AND w.label = g.label LEFT JOIN n ON n.o = g.o AND n.cluster = g.cluster AND n.label = g.label),
p AS (SELECT o, cluster, max(a) FILTER (label = 'L0') / sum(a) AS p0, max(a) FILTER (label = 'L1') / sum(a) AS p1, max(a) FILTER (label = 'L2') / sum(a) AS p2 FROM a GROUP BY ALL)
SELECT vec_id, unit, cl.cluster, label, round(p0, 6) AS p_L0, round(p1, 6) AS p_L1, round(p2, 6) AS p_L2 FROM cl LEFT JOIN p ON p.o = cl.unit AND p.cluster = cl.cluster""",
}

QUERIES = {name: globals()[name] for name in SQL}


def left_out_verdicts(spark, d):
    """Beta bounds have no SQL form."""
    c = M.clustered(spark, d).withColumn("kind", F.when(F.col("label") % 4 == 0, "A").otherwise("B")).drop("embedding")
    return A.left_out_by_unit(A.left_out_predictions(c, "cluster", "unit", "kind", ("A", "B")), "unit", "kind")


QUERIES["left_out_verdicts"] = left_out_verdicts
