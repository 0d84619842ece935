"""Queries on libraries of several detectors, missing numbers and neighbour graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import discovery as D
from echolith.operators import held_out as H
from echolith.operators import intervals as I
from echolith.operators import libraries as L
from echolith.operators import neighbours as N
from echolith.operators import quantiles as Q
from echolith.operators.pathways import Layer

from . import mapping as M
from .decisions import r6

_TREE = Layer("kind", {"AB": ("C1", "C2"), "C": ("C3",)}, 0.02, {"AB": Layer("sub", {"C1": ("C1",), "C2": ("C2",)}, 0.01)})
_WIDTH = 12 * 3600 * S.US
_SHARES = L.Shares(cap=20)
_RULES = {"click": [("n_windows", ">", 5, "noise")], "whistle": [("median_value", ">", 90.0, "C"), ("n_assigned", "<", 1, "noise")]}
_WEIGHTS = {"click": 0.5}


def _windows(spark, d):
    """Clicks and whistles as windows; their clusters come from the numbers of detections, the last of those of ``sub`` never has a label."""
    x = M.detections(spark, d).filter("voc_type <> 'other'")
    n = F.col("detection_id")
    value = F.when(n % 4 != 3, F.concat(F.lit("C"), 1 + (F.col("grp") + n % 3 * (n % 2)) % 3))
    return x.select(
        n, F.col("voc_type").alias("detector"), (F.col("grp") % 50).alias("site"), (F.col("grp") % 23).alias("unit"), value.alias("value"), F.col("t_us").alias("start"), F.col("value").alias("measure"),
        F.when(n % 11 == 0, -1).otherwise((F.col("grp") + n % 2) % 6).cast("long").alias("cluster_kind"), ((F.col("grp") * 2 + n % 4) % 5).cast("long").alias("cluster_sub"),
    )


def library_class_stats(spark, d):
    """p, rows and units of each cluster; those of whistles without a class count too."""
    w = _windows(spark, d).filter("detector = 'whistle'").select(F.col("cluster_kind").alias("cluster"), "unit", F.col("value").alias("label"))
    out = L.class_stats(w, "cluster", "unit", "label", ["C1", "C2", "C3", "C4"], _SHARES)
    each = [F.get(c, F.lit(k)).alias(f"{c}_{k + 1}") for c in ("p", "n", "units") for k in range(4)]
    return r6(out.select("cluster", "n_labelled", *each), *(f"p_{k}" for k in range(1, 5)))


def library_blocks(spark, d):
    """A library of two detectors and two layers, built from all windows and applied to them by site."""
    w = _windows(spark, d)
    lib = L.of_clusters(w, _TREE, _WIDTH, _SHARES, _WEIGHTS, {k: [("median_measure" if c == "median_value" else c, *r) for c, *r in v] for k, v in _RULES.items()}, ("measure",))
    out = L.blocks(lib, w, ["site"])
    return r6(out, *(c for c, t in out.dtypes if t == "double"))


def missing_numbers(spark, d):
    """Decisions, rules and ranges where probabilities and measures are NaN or absent."""
    n = F.col("detection_id")
    nan = F.lit(float("nan"))
    p = M.wide_of(M.detections(spark, d)).join(M.detections(spark, d).select("detection_id", "value"), "detection_id")
    p = p.withColumns({"C1": F.when(n % 5 == 0, nan).otherwise(F.col("C1")), "C2": F.when(n % 7 == 0, F.lit(None)).otherwise(F.when(n % 3 == 0, nan).otherwise(F.col("C2"))), "C3": F.when(n % 15 == 0, nan).otherwise(F.col("C3"))})
    p = p.withColumn("value", F.when(n % 4 == 0, nan).when(n % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    probs = [F.col(c) for c in M.CLASSES]
    out = p.select(
        "detection_id", S.decision_score(probs).alias("score"), S.decide(probs, M.CLASSES, 0.05).alias("decision"),
        S.rule_chain([("value", ">", 50.0, "high"), ("value", "<=", 10.0, "low")], F.lit("rest")).alias("ruled"), D.in_ranges({"value": (5.0, 60.0)}).alias("in_range"),
    )
    return r6(out, "score")


_GRAPH = N.GraphParams(k=10, rounds=4)


def neighbour_graph(spark, d):
    """About the 10 nearest vectors of each."""
    return r6(N.neighbours(M.read(spark, d, "embeddings"), "vec_id", "embedding", _GRAPH), "distance")


def neighbour_map(spark, d):
    """The map of all vectors."""
    return N.neighbour_map(M.read(spark, d, "embeddings"), "vec_id", "embedding", _GRAPH, N.MapParams(steps=12))


def grouped_quantiles(spark, d):
    """Quartiles and tails of every type's values, a hot group among them."""
    x = M.detections(spark, d).withColumn("kind", F.when(F.col("voc_type") != "other", F.col("voc_type")))
    return r6(Q.exact_quantiles(x, ["kind"], "value", [0.005, 0.25, 0.5, 0.75, 0.995]), "share", "quantile")


def _held_out(spark, d):
    """Probabilities of detections by recorder, of every ninth none; their true class is another one in a third of the rows."""
    n = F.col("detection_id")
    x = M.wide_of(M.detections(spark, d)).withColumns({c: F.when(n % 9 != 0, F.col(c)) for c in M.CLASSES})
    return x.withColumns({"unit": F.col("grp") % 60, "truth": F.concat(F.lit("C"), 1 + (F.col("grp") + (n % 3 == 0).cast("int")) % 3)})


def held_out_levels(spark, d):
    """Held-out rows of windows, blocks of six hours and units."""
    return r6(H.levels(_held_out(spark, d), M.CLASSES, "unit", "t_us", "truth", 6 * 3600 * S.US), *M.CLASSES)


def held_out_curve(spark, d):
    """Coverage and accuracy of all levels at eleven thresholds."""
    x = H.evaluate(_held_out(spark, d), M.CLASSES, "unit", "t_us", "truth", 6 * 3600 * S.US, thresholds=[k / 50 for k in range(11)])["curve"]
    return r6(x, "threshold", "coverage", "accuracy", "balanced_accuracy")


def labelled_periods(spark, d):
    """Periods of detections of one type and class with gaps of at most two minutes and two detections or more."""
    x = M.detections(spark, d).withColumn("label", F.when(F.col("grp") % 4 != 3, F.concat(F.lit("L"), F.col("grp") % 4)))
    return I.labelled_periods(x, "voc_type", "label", "t_us", "end_us", 120 * S.US, 3600 * S.US, 2)


QUERIES = {f.__name__: f for f in (grouped_quantiles, held_out_levels, held_out_curve, labelled_periods, library_class_stats, library_blocks, missing_numbers, neighbour_graph, neighbour_map)}

_W = (
    M.EV
    + """, w AS (SELECT detection_id AS n, voc_type AS detector, grp % 50 AS site, grp % 23 AS unit, t_us // 43200000000 * 43200000000 AS block_start, value AS measure,
CASE WHEN detection_id % 4 <> 3 THEN 'C' || (1 + (grp + detection_id % 3 * (detection_id % 2)) % 3) END AS value,
CASE WHEN detection_id % 11 = 0 THEN -1 ELSE (grp + detection_id % 2) % 6 END AS cluster_kind, (grp * 2 + detection_id % 4) % 5 AS cluster_sub FROM ev WHERE voc_type <> 'other')"""
)


def _stats_sql(name: str, rows: str, classes: list[str]) -> str:
    """CTEs <name>_p (cluster, p of each class, n, units) and <name>_b (bases) of rows (cluster, unit, label)."""
    k = range(len(classes))
    total = " + ".join(f"t{i}" for i in k)
    even = " AND ".join(f"t{i} > 0" for i in k)
    mine = lambda what, end: ", ".join(f"coalesce(sum({what}) FILTER (label = '{c}'), 0) AS {end}{i}" for i, c in enumerate(classes))
    a = [f"(x{i} * w{i} + 10.0 * b{i})" for i in k]
    return f"""{name}_r AS ({rows}),
{name}_t AS (SELECT {mine("least(c, 20)", "t")} FROM (SELECT unit, label, count(*) AS c FROM {name}_r WHERE cluster >= 0 GROUP BY ALL)),
{name}_b AS (SELECT {", ".join(f"CASE WHEN {even} THEN ({total}) / {len(classes)}.0 / t{i} ELSE 1.0 END AS w{i}, CASE WHEN ({even}) OR ({total}) = 0 THEN 1.0 / {len(classes)} ELSE t{i} / ({total}) END AS b{i}" for i in k)} FROM {name}_t),
{name}_x AS (SELECT cluster, {mine("least(c, 20)", "x")}, {mine("c", "n")}, {", ".join(f"count(*) FILTER (label = '{c}') AS u{i}" for i, c in enumerate(classes))} FROM (SELECT cluster, unit, label, count(*) AS c FROM {name}_r WHERE cluster >= 0 GROUP BY ALL) GROUP BY cluster),
{name}_p AS (SELECT cluster, {", ".join(f"{a[i]} / ({' + '.join(a)}) AS p{i}, CAST(n{i} AS BIGINT) AS n{i}, u{i}" for i in k)} FROM {name}_x, {name}_b)"""


def _decide_sql(p: list[str], names: list[str], least: float) -> tuple[str, str]:
    order = f"list_reverse_sort([x FOR x IN [{', '.join(p)}] IF x IS NOT NULL])"
    score = f"({order}[1] * ({order}[1] - coalesce({order}[2], 0)))"
    top = " ".join(f"WHEN {x} = {order}[1] THEN '{n}'" for x, n in zip(p, names, strict=True))
    return score, f"CASE WHEN {order}[1] IS NULL THEN 'no_data' WHEN {score} < {least} THEN 'uncertain' ELSE CASE {top} END END"


def _merged_sql(layer: str, i: int, k: int, ruled: bool) -> str:
    """Evidence of click (weight 0.5) and whistle (1) for class i of k."""
    has = {d: f"({d}_{layer}_0 IS NOT NULL" + (f" AND rule_{d} IS NULL)" if ruled else ")") for d in ("click", "whistle")}
    log = lambda j: " + ".join(f"CASE WHEN {has[d]} THEN {w} * ln(greatest({d}_{layer}_{j}, 1e-9) / {d}_{layer}_b{j}) ELSE 0.0 END" for d, w in (("click", 0.5), ("whistle", 1.0)))
    both = " + ".join(f"exp({log(j)} - ({log(i)}))" for j in range(k))
    return f"CASE WHEN {has['click']} AND {has['whistle']} THEN 1.0 / ({both}) WHEN {has['click']} THEN click_{layer}_{i} WHEN {has['whistle']} THEN whistle_{layer}_{i} END"


_LABEL = {"kind": "CASE WHEN value IN ('C1', 'C2') THEN 'AB' WHEN value = 'C3' THEN 'C' ELSE 'none' END", "sub": "value"}
_GROUPS = {"kind": ["AB", "C"], "sub": ["C1", "C2"]}
_NODES = [(d, n) for d in ("click", "whistle") for n in ("kind", "sub")]


def _blocks_sql() -> str:
    stats = ",\n".join(
        _stats_sql(f"{d}_{n}", f"SELECT cluster_{n} AS cluster, unit, {_LABEL[n]} AS label FROM w WHERE detector = '{d}'" + (" AND value IN ('C1', 'C2')" if n == "sub" else ""), _GROUPS[n]) for d, n in _NODES
    )
    joins = " ".join(f"LEFT JOIN {d}_{n}_p ON w.detector = '{d}' AND w.cluster_{n} = {d}_{n}_p.cluster" for d, n in _NODES)
    means = ", ".join(f"avg({d}_{n}_p.p{i}) AS {d}_{n}_{i}" for d, n in _NODES for i in (0, 1))
    counts = ", ".join(f"count(*) FILTER (detector = '{d}') AS n_{d}, count(*) FILTER (detector = '{d}' AND cluster_kind >= 0) AS a_{d}, median(measure) FILTER (detector = '{d}') AS m_{d}" for d in ("click", "whistle"))
    bases = ", ".join(f"(SELECT b{i} FROM {d}_{n}_b) AS {d}_{n}_b{i}" for d, n in _NODES for i in (0, 1))
    alone = []
    for d, n in _NODES:
        _, said = _decide_sql([f"{d}_{n}_{i}" for i in (0, 1)], _GROUPS[n], 0.02 if n == "kind" else 0.01)
        said = f"CASE WHEN ({said}) = 'no_data' THEN 'uncertain' ELSE {said} END"
        said = f"coalesce(then_{d}, {said})" if n == "kind" else said
        alone.append(f"CASE WHEN n_{d} > 0 THEN {said} ELSE 'no_detections' END AS {n}_{d}")
    kind_score, kind = _decide_sql(["kp0", "kp1"], _GROUPS["kind"], 0.02)
    sub_score, sub = _decide_sql(["sp0", "sp1"], _GROUPS["sub"], 0.01)
    return f"""WITH {_W}, {stats},
g AS (SELECT site, block_start, {counts}, {means} FROM w {joins} GROUP BY site, block_start),
h AS (SELECT g.*, {bases}, CASE WHEN n_click > 5 THEN 'click: n_windows > 5' END AS rule_click, CASE WHEN n_click > 5 THEN 'noise' END AS then_click,
CASE WHEN n_whistle > 0 AND m_whistle > 90 THEN 'whistle: median_measure > 90' WHEN n_whistle > 0 AND a_whistle < 1 THEN 'whistle: n_assigned < 1' END AS rule_whistle,
CASE WHEN n_whistle > 0 AND m_whistle > 90 THEN 'C' WHEN n_whistle > 0 AND a_whistle < 1 THEN 'noise' END AS then_whistle FROM g),
m AS (SELECT *, {", ".join(f"{_merged_sql(n, i, 2, n == 'kind')} AS {n[0]}p{i}" for n in ("kind", "sub") for i in (0, 1))}, {", ".join(alone)} FROM h),
o AS (SELECT *, {kind} AS kd, {kind_score} AS ks, {sub} AS sd, {sub_score} AS ss FROM m),
q AS (SELECT *, kd = 'no_data' AND coalesce(rule_click, rule_whistle) IS NOT NULL AS ruled FROM o),
r AS (SELECT *, CASE WHEN ruled THEN coalesce(then_click, then_whistle) WHEN kd = 'no_data' THEN 'no_detections' ELSE kd END AS kind FROM q),
s AS (SELECT *, kind = 'AB' AS below, CASE WHEN kind <> 'AB' THEN 'n/a' WHEN sd = 'no_data' THEN 'no_detections' ELSE sd END AS sub FROM r)
SELECT site, block_start, n_click, n_whistle, kind_click, kind_whistle, CASE WHEN ruled THEN coalesce(rule_click, rule_whistle) END AS rule, kind, round(ks, 6) AS kind_score, round(kp0, 6) AS kind_p_AB, round(kp1, 6) AS kind_p_C,
CASE WHEN below THEN sub_click ELSE 'n/a' END AS sub_click, CASE WHEN below THEN sub_whistle ELSE 'n/a' END AS sub_whistle, sub, CASE WHEN below THEN round(ss, 6) END AS sub_score, CASE WHEN below THEN round(sp0, 6) END AS sub_p_C1, CASE WHEN below THEN round(sp1, 6) END AS sub_p_C2,
CASE WHEN below AND sub IN ('C1', 'C2') THEN 'AB > ' || sub WHEN ruled OR kind IN ('uncertain', 'no_detections') THEN '' ELSE kind END AS path, CASE WHEN below AND sub IN ('C1', 'C2') THEN sub ELSE kind END AS decision FROM s"""


_HELD = (
    M.PRED
    + """, hx AS (SELECT grp % 60 AS unit, t_us // 21600000000 * 21600000000 AS block, 'C' || (1 + (grp + CASE WHEN detection_id % 3 = 0 THEN 1 ELSE 0 END) % 3) AS truth,
CASE WHEN detection_id % 9 <> 0 THEN C1 END AS C1, CASE WHEN detection_id % 9 <> 0 THEN C2 END AS C2, CASE WHEN detection_id % 9 <> 0 THEN C3 END AS C3 FROM wide),
hc AS (SELECT unit, block, truth, count(*) AS k FROM hx GROUP BY GROUPING SETS ((unit, block, truth), (unit, truth))),
ht AS (SELECT unit, block, first(truth ORDER BY k DESC, truth) AS truth FROM hc GROUP BY unit, block),
hm AS (SELECT unit, block, count(*) AS n_windows, count(C1) AS n_with_probs, avg(C1) AS C1, avg(C2) AS C2, avg(C3) AS C3 FROM hx GROUP BY GROUPING SETS ((unit, block), (unit))),
hr AS (SELECT 'window' AS level, unit, block, truth, CAST(1 AS BIGINT) AS n_windows, CAST(CASE WHEN C1 IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_with_probs, C1, C2, C3 FROM hx
UNION ALL SELECT CASE WHEN hm.block IS NULL THEN 'unit' ELSE 'block' END, hm.unit, hm.block, truth, n_windows, n_with_probs, C1, C2, C3 FROM hm JOIN ht ON hm.unit = ht.unit AND hm.block IS NOT DISTINCT FROM ht.block)"""
)

SQL = {
    "grouped_quantiles": f"""WITH {M.EV}, k AS (SELECT CASE WHEN voc_type <> 'other' THEN voc_type END AS kind, value FROM ev WHERE value IS NOT NULL),
s AS (SELECT unnest([0.005, 0.25, 0.5, 0.75, 0.995]) AS share), q AS (SELECT kind, quantile_cont(value, [0.005, 0.25, 0.5, 0.75, 0.995]) AS q, count(*) AS n FROM k GROUP BY kind)
SELECT kind, CAST(round(share, 6) AS DOUBLE) AS share, round(q[list_position([0.005, 0.25, 0.5, 0.75, 0.995], share)], 6) AS quantile, n FROM q, s""",
    "held_out_levels": f"WITH {_HELD} SELECT level, unit, block, truth, n_windows, n_with_probs, round(C1, 6) AS C1, round(C2, 6) AS C2, round(C3, 6) AS C3 FROM hr",
    "held_out_curve": f"""WITH {_HELD}, s AS (SELECT level, truth, {_decide_sql(["C1", "C2", "C3"], M.CLASSES, 0)[1]} AS said, {_decide_sql(["C1", "C2", "C3"], M.CLASSES, 0)[0]} AS score FROM hr),
t AS (SELECT unnest(range(11)) AS k), p AS (SELECT level, k, truth, count(*) AS n_all, count(*) FILTER (score >= k / 50.0) AS n, count(*) FILTER (score >= k / 50.0 AND said = truth) AS ok FROM s, t GROUP BY ALL)
SELECT level, round(k / 50.0, 6) AS threshold, CAST(sum(n_all) AS BIGINT) AS n, round(sum(n) / sum(n_all), 6) AS coverage, round(sum(ok) / nullif(sum(n), 0), 6) AS accuracy, round(avg(ok / nullif(n, 0)), 6) AS balanced_accuracy FROM p GROUP BY level, k""",
    "labelled_periods": f"""WITH {M.EV}, x AS (SELECT voc_type, 'L' || (grp % 4) AS label, t_us, end_us FROM ev WHERE grp % 4 <> 3),
r AS (SELECT *, max(end_us) OVER (PARTITION BY voc_type, label ORDER BY t_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x),
n AS (SELECT *, sum(CASE WHEN t_us - p <= 120000000 THEN 0 ELSE 1 END) OVER (PARTITION BY voc_type, label ORDER BY t_us, end_us ROWS UNBOUNDED PRECEDING) AS s FROM r),
g AS (SELECT voc_type, label, s, min(t_us) AS a, max(end_us) AS z, count(*) AS k FROM n GROUP BY ALL HAVING count(*) >= 2)
SELECT label || '_' || voc_type || '_' || lpad(CAST(row_number() OVER (ORDER BY a, voc_type, label) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY a, voc_type, label) AS VARCHAR))) AS INTEGER), '0') AS event_id, label, a AS start, z AS "end", voc_type AS detector, k AS n_windows FROM g""",
    "library_class_stats": f"""WITH {_W}, {_stats_sql("s", "SELECT cluster_kind AS cluster, unit, value AS label FROM w WHERE detector = 'whistle'", ["C1", "C2", "C3", "C4"])}
SELECT CAST(cluster AS BIGINT) AS cluster, n0 + n1 + n2 + n3 AS n_labelled, {", ".join(f"round(p{k}, 6) AS p_{k + 1}, n{k} AS n_{k + 1}, u{k} AS units_{k + 1}" for k in range(4))} FROM s_p""",
    "library_blocks": _blocks_sql(),
    "missing_numbers": f"""WITH {M.PRED}, a AS (SELECT w.detection_id, CASE WHEN w.detection_id % 5 = 0 THEN NULL ELSE C1 END AS p1, CASE WHEN w.detection_id % 7 = 0 OR w.detection_id % 3 = 0 THEN NULL ELSE C2 END AS p2, CASE WHEN w.detection_id % 15 = 0 THEN NULL ELSE C3 END AS p3,
CASE WHEN w.detection_id % 4 = 0 OR w.detection_id % 9 = 0 THEN NULL ELSE value END AS finite, w.detection_id % 4 <> 0 AND w.detection_id % 9 = 0 AS infinite FROM wide w JOIN (SELECT detection_id, value FROM ev) v ON w.detection_id = v.detection_id)
SELECT detection_id, round({_decide_sql(["p1", "p2", "p3"], M.CLASSES, 0.05)[0]}, 6) AS score, {_decide_sql(["p1", "p2", "p3"], M.CLASSES, 0.05)[1]} AS decision,
CASE WHEN finite > 50 THEN 'high' WHEN finite <= 10 THEN 'low' ELSE 'rest' END AS ruled, NOT infinite AND coalesce(finite >= 5 AND finite <= 60, true) AS in_range FROM a""",
}
