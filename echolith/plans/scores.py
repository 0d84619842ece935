"""Queries on scores of predictions and clusters, and on merged detectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import detectors as D
from echolith.operators import evaluation as E

from . import mapping as M
from .decisions import r6

C = M.CLASSES
_BASES = {"click": {"C1": 0.3, "C2": 0.3, "C3": 0.4}, "whistle": {"C1": 0.45, "C2": 0.55}}
_DAY_US = 86_400 * S.US


def _decided(spark, d):
    return M.wide(spark, d).withColumn("predicted", S.argmax_class([F.col(c) for c in C], C))


def class_scores(spark, d):
    return r6(E.class_scores(_decided(spark, d), "true_class", "predicted"), "recall", "precision", "f1")


def score_headline(spark, d):
    return r6(E.headline(E.class_scores(_decided(spark, d), "true_class", "predicted")), "balanced_accuracy", "macro_f1", "chance", "skill")


def cluster_information(spark, d):
    return r6(E.mutual_information(M.clustered(spark, d), "cluster", "label"), "mutual_information", "by_chance", "adjusted")


def cosine_silhouettes(spark, d):
    return r6(E.silhouettes(M.clustered(spark, d), "vec_id", "embedding", "label"), "silhouette").withColumnRenamed("label", "cluster")


def typical_units(spark, d):
    """Three purchases of each label that do not overlap, the nearest by a distance made of the number."""
    x = M.calls(spark, d).select("call_id", "call_label", "c_start", "c_end", ((F.col("call_id") * 7919) % 1009).alias("far"))
    x = x.withColumn("cluster", F.substring("call_label", 2, 9).cast("int"))
    return E.typical(x, "cluster", "call_id", "far", "c_start", "c_end", 3)


def leave_out_skill(spark, d):
    """Verdicts of two labels, undecided where the greatest probability is low."""
    p = _decided(spark, d).filter("true_class <> 'C3'")
    verdict = F.when(F.greatest(*C) < 0.5, "uncertain").when(F.col("C1") >= F.col("C2"), "C1").otherwise("C2")
    return r6(E.leave_out_summary(p.withColumn("verdict", verdict), "true_class", "verdict"), "coverage", "balanced_accuracy", "skill")


def _detector(spark, d, kind, classes):
    """Mean probabilities of a day's detections of one kind; a day of one detection is decided by a rule."""
    w = M.predictions(spark, d).filter(F.col("voc_type") == kind).groupBy("grp", S.floor_to(F.col("t_us"), _DAY_US).alias("block_us"))
    of = lambda c: F.when(F.col("class") == c, F.col("probability"))
    x = w.agg(*(F.avg(of(c)).alias(c) for c in classes), F.count(of(C[0])).alias("n"), F.min("detection_id").alias("least"))
    ruled = F.col("least") % 11 == 0
    return x.withColumns({"rule": F.when(ruled, "least % 11 == 0"), "rule_decision": F.when(ruled, "C9")}).drop("least")


def merged_detectors(spark, d):
    """The whistle detector does not know the third class."""
    tables = {"click": _detector(spark, d, "click", C), "whistle": _detector(spark, d, "whistle", C[:2])}
    out = D.merge_blocks(tables, ["grp", "block_us"], C, _BASES, {"whistle": 0.5}, 0.05)
    # shares of small whole numbers lie on halves of the last digit; both engines round these up
    return out.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in (*C, "score")})


def discovery_scorecard(spark, d):
    c = M.clustered(spark, d).withColumn("cluster", F.when(F.col("cluster") == 7, -1).otherwise(F.col("cluster")))
    return r6(E.scorecard(c, "vec_id", "unit", "cluster", "embedding", "label"), "unassigned", "silhouette", "adjusted")


def balanced_folds(spark, d):
    li = M.read(spark, d, "lineitem")
    f = E.balanced_folds(li, "l_returnflag", "l_suppkey", 5)
    return li.join(f, "l_suppkey").groupBy("fold", "l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_groups"))


def means_clusters(spark, d):
    """Clusters of all rows by k-means, scored against the labels."""
    names = [f"f{k}" for k in range(16)]
    e = M.read(spark, d, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(k)).alias(n) for k, n in enumerate(names)))
    c = E.means_clusters(e, "vec_id", names, 10, 2)
    return r6(E.mutual_information(c.join(e.select("vec_id", "label"), "vec_id"), "cluster", "label"), "mutual_information", "by_chance", "adjusted")



_DEC = M.PRED + ", x AS (SELECT true_class AS t, CASE WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END AS p, C1, C2, C3 FROM wide)"
_CS = _DEC + """, l AS (SELECT DISTINCT t AS label FROM x), s AS (SELECT label, count(*) FILTER (t = label) AS n, count(*) FILTER (p = label) AS n_predicted, count(*) FILTER (t = label AND p = label) AS n_correct FROM l, x GROUP BY label),
cs AS (SELECT *, n_correct / n AS recall, coalesce(n_correct / nullif(n_predicted, 0), 0) AS precision, 2 * n_correct / (n + n_predicted) AS f1 FROM s)"""
_INFO = """ct AS (SELECT cluster AS a, label AS b, count(*) AS c FROM cl {where} GROUP BY ALL), ra AS (SELECT a, CAST(sum(c) AS DOUBLE) AS n FROM ct GROUP BY a), rb AS (SELECT b, CAST(sum(c) AS DOUBLE) AS n FROM ct GROUP BY b), nn AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM ct),
mi AS (SELECT sum(c / nn.n * ln(nn.n * c / (ra.n * rb.n))) AS mi FROM ct JOIN ra USING (a) JOIN rb USING (b), nn),
em AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS em
  FROM (SELECT ra.n AS a, rb.n AS b, nn.n AS n, CAST(unnest(range(CAST(greatest(1, ra.n + rb.n - nn.n) AS BIGINT), CAST(least(ra.n, rb.n) AS BIGINT) + 1)) AS DOUBLE) AS k FROM ra, rb, nn)),
h AS (SELECT ((SELECT -sum(ra.n / nn.n * ln(ra.n / nn.n)) FROM ra, nn) + (SELECT -sum(rb.n / nn.n * ln(rb.n / nn.n)) FROM rb, nn)) / 2 AS h),
info AS (SELECT CAST(n AS BIGINT) AS n, mi, em, (mi - em) / (h - em) AS ami FROM nn, mi, em, h)"""
_SIL = """p AS (SELECT vec_id, {c} AS c, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM cl {where}), u AS (SELECT vec_id, c, k, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM p), s AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM u GROUP BY ALL),
f AS (SELECT u.vec_id, u.c AS own, s.c, max(n) AS n, max(n) - sum(u.x * s.s) AS far FROM u JOIN s USING (k) GROUP BY ALL),
v AS (SELECT vec_id, own, max(n) FILTER (c = own) AS n, max(far) FILTER (c = own) / nullif(max(n) FILTER (c = own) - 1, 0) AS a, min(far / n) FILTER (c <> own) AS b FROM f GROUP BY ALL),
sil AS (SELECT vec_id, own AS cluster, CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS silhouette FROM v)"""


def _picks(most: int) -> str:
    """Rounds of the greedy choice as one CTE each."""
    out = "c AS (SELECT call_id, CAST(substr(call_label, 2) AS INTEGER) AS cluster, c_start AS s, c_end AS e, call_id * 7919 % 1009 AS far FROM calls), t1 AS (SELECT *, 1 AS rank FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY far, call_id) = 1)"
    for k in range(2, most + 1):
        out += f", t{k} AS (SELECT * FROM t{k - 1} UNION ALL (SELECT *, {k} FROM c WHERE NOT EXISTS (SELECT 1 FROM t{k - 1} t WHERE t.cluster = c.cluster AND (t.call_id = c.call_id OR c.s < t.e AND t.s < c.e)) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY far, call_id) = 1))"
    return out


def _side(kind: str, classes: list[str]) -> str:
    means = ", ".join(f"avg({c}) AS {c}" for c in classes)
    return f"SELECT grp, t_us - t_us % {_DAY_US} AS block_us, {means}, count(*) AS n, min(detection_id) % 11 = 0 AS ruled FROM wide WHERE voc_type = '{kind}' GROUP BY ALL"


_LOGS = """CASE WHEN sa THEN ln(greatest(a0, 1e-9) / 0.3) ELSE 0 END + CASE WHEN sb THEN 0.5 * ln(greatest(b0, 1e-9) / 0.45) ELSE 0 END AS l0,
CASE WHEN sa THEN ln(greatest(a1, 1e-9) / 0.3) ELSE 0 END + CASE WHEN sb THEN 0.5 * ln(greatest(b1, 1e-9) / 0.55) ELSE 0 END AS l1, CASE WHEN sa THEN ln(greatest(a2, 1e-9) / 0.4) ELSE 0 END AS l2"""

SQL = {
    "class_scores": f"WITH {_CS} SELECT label, n, n_predicted, n_correct, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM cs",
    "score_headline": f"WITH {_CS}, o AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_classes, avg(recall) AS b, avg(f1) AS f FROM cs) SELECT n, n_classes, round(b, 6) AS balanced_accuracy, round(f, 6) AS macro_f1, round(1 / n_classes, 6) AS chance, round((b - 1 / n_classes) / (1 - 1 / n_classes), 6) AS skill FROM o",
    "cluster_information": f"WITH {M.CL}, {_INFO.format(where='')} SELECT n, round(mi, 6) AS mutual_information, round(em, 6) AS by_chance, round(ami, 6) + 0.0 AS adjusted FROM info",
    "cosine_silhouettes": f"WITH {M.CL}, {_SIL.format(c='label', where='')} SELECT vec_id, cluster, round(silhouette, 6) + 0.0 AS silhouette FROM sil",
    "typical_units": f"WITH {M.CALLS}, {_picks(3)} SELECT cluster, rank, call_id FROM t3",
    "leave_out_skill": f"""WITH {_DEC}, v AS (SELECT t, CASE WHEN greatest(C1, C2, C3) < 0.5 THEN 'uncertain' WHEN C1 >= C2 THEN 'C1' ELSE 'C2' END AS v FROM x WHERE t <> 'C3'), y AS (SELECT t, count(*) AS n, count(*) FILTER (v <> 'uncertain') AS d, count(*) FILTER (v = t) AS c FROM v GROUP BY t),
z AS (SELECT *, c / nullif(d, 0) AS r, d / n * coalesce(c / nullif(d, 0), 0.5) + (1 - d / n) * 0.5 AS gain FROM y) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(d) / sum(n), 6) AS coverage, round(avg(r), 6) AS balanced_accuracy, round((avg(gain) - 0.5) / 0.5, 6) + 0.0 AS skill FROM z""",
    "merged_detectors": f"""WITH {M.PRED}, a0 AS ({_side('click', C)}), b0 AS ({_side('whistle', C[:2])}),
j AS (SELECT coalesce(a.grp, b.grp) AS grp, coalesce(a.block_us, b.block_us) AS block_us, coalesce(a.n, 0) AS n_click, coalesce(b.n, 0) AS n_whistle, a.ruled AS ar, coalesce(NOT a.ruled, false) AS sa, coalesce(NOT b.ruled, false) AS sb, sa OR sb AS seen,
a.C1 AS a0, a.C2 AS a1, a.C3 AS a2, b.C1 AS b0, b.C2 AS b1 FROM a0 a FULL JOIN b0 b ON a.grp = b.grp AND a.block_us = b.block_us), lg AS (SELECT *, {_LOGS} FROM j),
e AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lg),
m AS (SELECT *, CASE WHEN sa AND sb THEN e0 / (e0 + e1 + e2) WHEN sa THEN a0 WHEN sb THEN b0 END AS C1, CASE WHEN sa AND sb THEN e1 / (e0 + e1 + e2) WHEN sa THEN a1 WHEN sb THEN b1 END AS C2, CASE WHEN sa AND sb THEN e2 / (e0 + e1 + e2) WHEN sa THEN a2 WHEN sb THEN 0 END AS C3 FROM e),
g AS (SELECT *, list_reverse_sort([C1, C2, C3])[1] * (list_reverse_sort([C1, C2, C3])[1] - list_reverse_sort([C1, C2, C3])[2]) AS score FROM m),
k AS (SELECT *, CASE WHEN NOT seen THEN 'C9' WHEN score < 0.05 THEN 'uncertain' WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END AS decision FROM g)
SELECT grp, block_us, n_click, n_whistle, round(C1 + 1e-10, 6) AS C1, round(C2 + 1e-10, 6) AS C2, round(C3 + 1e-10, 6) AS C3, CASE WHEN seen THEN round(score + 1e-10, 6) END AS score, CASE WHEN NOT seen THEN CASE WHEN ar THEN 'click' ELSE 'whistle' END || ': least % 11 == 0' END AS rule, decision,
CASE WHEN NOT seen OR decision = 'uncertain' THEN '' ELSE decision END AS path FROM k""",
    "discovery_scorecard": f"""WITH {M.CL}, {_INFO.format(where='WHERE cluster <> 7')}, {_SIL.format(c='cluster', where='WHERE cluster <> 7')}
SELECT count(*) AS n, count(DISTINCT unit) AS n_units, count(DISTINCT cluster) FILTER (cluster <> 7) AS n_clusters, round(count(*) FILTER (cluster = 7) / count(*), 6) AS unassigned, round((SELECT avg(silhouette) FROM sil), 6) + 0.0 AS silhouette, round((SELECT ami FROM info), 6) + 0.0 AS adjusted FROM cl""",
}

QUERIES = {name: globals()[name] for name in (*SQL, "balanced_folds", "means_clusters")}
