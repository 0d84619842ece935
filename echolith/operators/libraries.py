"""Libraries of several detectors and layers: built, stored and applied as one.

A library has, for each detector and each layer of a finite tree, a frozen
clustering and the class probabilities of its clusters. Applied, every window
is assigned in all layers at once, one aggregation brings the detectors' means
together for each block, and the decisions of all layers are one projection: a
layer merges the evidence of the detectors that have it, and is ``n/a`` in a
block that its group's parent did not decide.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import recluster
from echolith.operators.clusters import beta_quantile
from echolith.operators.library import MAX_CENTROIDS
from echolith.operators.pathways import OPEN, Layer, labels, layers
from echolith.sources import sinks
from echolith.sources.durable import cut

#: Values of a block that rules may read, besides medians of the windows' measures.
COUNTS = ("n_windows", "n_assigned")
OPS = ("<", "<=", ">", ">=", "==", "!=")


@dataclass(frozen=True)
class Shares:
    """cap: most rows of a unit that count (0: all); prior: rows' worth of base rates; balanced: classes count alike where all have rows; ci, min_units: for verdicts."""

    cap: int = 50
    prior: float = 10.0
    balanced: bool = True
    ci: float = 0.9
    min_units: int = 2


def class_rates(df: DataFrame, cluster: str, unit: str, label: str, classes: list[str], p: Shares) -> DataFrame:
    """One row: t<k>, the capped rows of the k-th class in clusters, weight<k> and base<k>.

    A unit's cap holds over its clusters together. Weights make the classes equal and bases are equal; where
    that isn't wanted, or a class has no rows, weights are 1 and bases the classes' shares.
    """
    lab = df.filter((F.col(cluster) >= 0) & F.col(label).isin(classes) & F.col(unit).isNotNull())
    per = lab.groupBy(unit, label).agg(F.count("*").alias("_n"))
    n = F.least("_n", F.lit(p.cap)) if p.cap else F.col("_n")
    t = per.agg(*(F.coalesce(F.sum(F.when(F.col(label) == c, n)), F.lit(0)).cast("double").alias(f"t{k}") for k, c in enumerate(classes)))
    k = range(len(classes))
    total = sum((F.col(f"t{i}") for i in k), F.lit(0.0))
    even = F.least(*(F.col(f"t{i}") for i in k)) > 0 if p.balanced else F.lit(False)
    weight = [F.when(even, total / len(classes) / F.col(f"t{i}")).otherwise(1.0).alias(f"weight{i}") for i in k]
    base = [F.when(even | (total == 0), 1.0 / len(classes)).otherwise(F.try_divide(F.col(f"t{i}"), total)).alias(f"base{i}") for i in k]
    return t.select(*(f"t{i}" for i in k), *weight, *base)


def class_stats(df: DataFrame, cluster: str, unit: str, label: str, classes: list[str], p: Shares | None = None, rates: DataFrame | None = None) -> DataFrame:
    """(cluster, n_labelled, p, low, n, units, verdict) of every cluster, arrays in order of the classes.

    p are the capped, weighted rows and the prior's, made 1; low their lower Beta bounds. The verdict
    is the class of the greatest p among those whose bound is over the base rate and that enough units have,
    the first of equals, else ``uncertain``. Clusters without labelled rows have the base rates.
    """
    p = p or Shares()
    rates = class_rates(df, cluster, unit, label, classes, p) if rates is None else rates
    held = df.filter(F.col(cluster) >= 0)
    per = held.groupBy(cluster, unit, label).agg(F.count("*").alias("_n"))
    capped = F.least("_n", F.lit(p.cap)) if p.cap else F.col("_n")
    aggs = []
    for k, c in enumerate(classes):
        mine, there = F.col(label) == c, F.col(unit).isNotNull()
        aggs += [F.coalesce(F.sum(F.when(mine & there, capped)), F.lit(0)).cast("double").alias(f"x{k}"), F.coalesce(F.sum(F.when(mine, F.col("_n"))), F.lit(0)).alias(f"n{k}"), F.count_if(mine & there).alias(f"u{k}")]
    rows = per.groupBy(cluster).agg(*aggs).crossJoin(F.broadcast(rates))  # one row
    each = range(len(classes))
    rows = rows.withColumn("_a", F.array(*(F.col(f"x{k}") * F.col(f"weight{k}") + p.prior * F.col(f"base{k}") for k in each)))
    rows = rows.withColumn("_t", F.aggregate("_a", F.lit(0.0), lambda s, v: s + v))

    @F.pandas_udf("array<double>")
    def low(a: pd.Series) -> pd.Series:
        known: dict = {}

        def of(x, y):
            if (x, y) not in known:
                known[x, y] = beta_quantile((1 - p.ci) / 2, x, y) if x > 0 and y > 0 else None
            return known[x, y]

        return pd.Series([[of(x, sum(v) - x) for x in v] for v in a], dtype=object)

    rows = rows.withColumns({"p": F.transform("_a", lambda v: F.try_divide(v, F.col("_t"))), "low": low("_a"), "n": F.array(*(F.col(f"n{k}") for k in each)), "units": F.array(*(F.col(f"u{k}") for k in each))})
    ok = [(F.get("low", F.lit(k)) > F.col(f"base{k}")) & (F.col(f"u{k}") >= p.min_units) for k in each]
    passed = [F.when(o, F.get("p", F.lit(k))) for k, o in enumerate(ok)]
    verdict = F.coalesce(S.argmax_class(passed, classes), F.lit("uncertain"))
    return rows.select(cluster, F.aggregate("n", F.lit(0).cast("long"), lambda s, v: s + v).alias("n_labelled"), "p", "low", "n", "units", verdict.alias("verdict"))


@dataclass(frozen=True)
class Library:
    """tree: layers with groups, least scores and children; nodes: {(detector, layer): clustering, or None where clusters are given}.

    stats has (detector, layer, cluster, p), bases {(detector, layer): rates of the groups}. rules:
    {detector: [(value, comparison, number, decision)]}, for the first layer. width: of a block, as the windows' starts.
    """

    tree: Layer
    detectors: tuple[str, ...]
    width: int
    nodes: dict[tuple[str, str], recluster.Frozen | None]
    stats: DataFrame
    bases: dict[tuple[str, str], list[float]]
    weights: dict[str, float] = field(default_factory=dict)
    rules: dict[str, list[tuple[str, str, float, str]]] = field(default_factory=dict)
    measures: tuple[str, ...] = ()

    def of(self, layer: Layer) -> list[str]:
        return [d for d in self.detectors if (d, layer.name) in self.nodes]


def check_rules(rules: Mapping[str, list], measures: tuple[str, ...] = ()) -> dict[str, list[tuple[str, str, float, str]]]:
    """The rules with numbers as such; unknown values and comparisons are refused."""
    known, out = {*COUNTS, *(f"median_{m}" for m in measures)}, {}
    for detector, given in rules.items():
        out[detector] = []
        for value, op, number, then in given:
            if value not in known or op not in OPS or isinstance(number, bool) or not isinstance(number, (int, float)) or not isinstance(then, str):
                raise ValueError(f"not a rule: {value} {op} {number!r} -> {then!r}; values are {', '.join(sorted(known))}, comparisons {', '.join(OPS)}")
            out[detector].append((value, op, float(number), then))
    return out


def with_rules(lib: Library, rules: Mapping[str, list]) -> Library:
    """The library with other rules."""
    return replace(lib, rules=check_rules(rules, lib.measures))


def with_min_scores(lib: Library, scores: Mapping[str, float]) -> Library:
    """The library with other least scores of layers."""
    if unknown := sorted(set(scores) - {layer.name for layer in layers(lib.tree)}):
        raise ValueError(f"no such layers: {', '.join(unknown)}")

    def walk(layer: Layer) -> Layer:
        return replace(layer, min_score=float(scores.get(layer.name, layer.min_score)), children={g: walk(c) for g, c in layer.children.items()})

    return replace(lib, tree=walk(lib.tree))


def _within(tree: Layer, inside: Column | None = None) -> Iterator[tuple[Layer, Column | None]]:
    """Each layer and the condition on the column ``value`` that a window of its parent's group meets."""
    yield tree, inside
    for group, child in tree.children.items():
        yield from _within(child, F.col("value").isin(*tree.groups[group]))


def _gathered(parts: list[tuple[str, str, DataFrame, DataFrame]]) -> tuple[DataFrame, dict[tuple[str, str], list[float]]]:
    """Stats of all nodes in one stored table, and their bases: a row a node comes to the driver."""
    one = lambda d, n, x: x.select(F.lit(d).alias("detector"), F.lit(n).alias("layer"), F.col("cluster").cast("long").alias("cluster"), "p")
    stats = cut(reduce(DataFrame.unionByName, [one(d, n, s) for d, n, s, _ in parts]))
    rate = lambda d, n, r: r.select(F.lit(d).alias("d"), F.lit(n).alias("n"), F.array(*(c for c in r.columns if c.startswith("base"))).alias("b"))
    rows = reduce(DataFrame.unionByName, [rate(d, n, r) for d, n, _, r in parts]).collect()
    return stats, {(r["d"], r["n"]): list(r["b"]) for r in rows}


def of_clusters(windows: DataFrame, tree: Layer, width: int, shares: Shares | None = None, weights: Mapping[str, float] | None = None, rules: Mapping[str, list] | None = None, measures: tuple[str, ...] = ()) -> Library:
    """A library of windows (detector, unit, value, cluster_<layer> for each layer) that are clustered already."""
    shares = shares or Shares()
    detectors = tuple(sorted(r[0] for r in windows.select("detector").dropna().distinct().collect()))  # a row a detector
    parts = []
    for d in detectors:
        for layer, inside in _within(tree):
            mine = windows.filter(F.col("detector") == d)
            mine = (mine if inside is None else mine.filter(inside)).select(F.col(f"cluster_{layer.name}").alias("cluster"), "unit", labels(F.col("value"), layer).alias("label"))
            rates = class_rates(mine, "cluster", "unit", "label", list(layer.groups), shares)
            parts.append((d, layer.name, class_stats(mine, "cluster", "unit", "label", list(layer.groups), shares, rates), rates))
    stats, bases = _gathered(parts)
    return Library(tree, detectors, width, {(d, n): None for d, n, _, _ in parts}, stats, bases, dict(weights or {}), check_rules(rules or {}, measures), measures)


def build(
    windows: DataFrame, tree: Layer, width: int, p: recluster.HybridParams | None = None, shares: Shares | None = None, least: int = 30,
    weights: Mapping[str, float] | None = None, rules: Mapping[str, list] | None = None, measures: tuple[str, ...] = (),
) -> Library:
    """A library of windows (key, detector, unit, block, value, vector): a clustering for each detector and layer, frozen.

    A layer below the first sees the windows of its group only; a detector with under ``least`` of them has no such layer.
    """
    shares = shares or Shares()
    detectors = tuple(sorted(r[0] for r in windows.select("detector").dropna().distinct().collect()))
    nodes, parts = {}, []
    for d in detectors:
        for layer, inside in _within(tree):
            mine = windows.filter((F.col("detector") == d) & F.col("vector").isNotNull())
            mine = (mine if inside is None else mine.filter(inside)).withColumn("label", labels(F.col("value"), layer))
            if mine.limit(least).count() < least:
                continue
            known = mine.withColumn("label", F.when(F.col("label") != "none", F.col("label")))
            nodes[d, layer.name] = recluster.freeze(known, "key", "vector", "label", "block", p)
            mine = recluster.assign_frozen(mine, "vector", nodes[d, layer.name])
            rates = class_rates(mine, "cluster", "unit", "label", list(layer.groups), shares)
            parts.append((d, layer.name, class_stats(mine, "cluster", "unit", "label", list(layer.groups), shares, rates), rates))
    if not parts:
        raise ValueError(f"no detector has {least} windows")
    stats, bases = _gathered(parts)
    return Library(tree, detectors, width, nodes, stats, bases, dict(weights or {}), check_rules(rules or {}, measures), measures)


def save(spark: SparkSession, path: str, lib: Library) -> None:
    """The library as tables and a manifest, through Spark."""
    tables, nodes = {"stats": lib.stats}, []
    for k, ((d, name), frozen) in enumerate(sorted(lib.nodes.items())):
        node = {"detector": d, "layer": name, "base": lib.bases[d, name], "frozen": frozen is not None}
        if frozen is not None:
            own, node["clustering"] = recluster.frozen_tables(spark, frozen)
            tables |= {f"{n}_{k}": t for n, t in own.items()}
        nodes.append(node)
    sinks.save_library(spark, path, tables, {"tree": asdict(lib.tree), "detectors": lib.detectors, "width": lib.width, "nodes": nodes, "weights": lib.weights, "rules": lib.rules, "measures": lib.measures})


def load(spark: SparkSession, path: str) -> Library:
    tables, m = sinks.load_library(spark, path)

    def layer(x: dict) -> Layer:
        return Layer(x["name"], {g: tuple(v) for g, v in x["groups"].items()}, x["min_score"], {g: layer(c) for g, c in x["children"].items()})

    nodes, bases = {}, {}
    for k, n in enumerate(m["nodes"]):
        at = n["detector"], n["layer"]
        bases[at] = n["base"]
        nodes[at] = recluster.frozen_from({t: tables[f"{t}_{k}"] for t in ("centres", "members")}, n["clustering"]) if n["frozen"] else None
    return Library(layer(m["tree"]), tuple(m["detectors"]), m["width"], nodes, tables["stats"], bases, m["weights"], check_rules(m["rules"], tuple(m["measures"])), tuple(m["measures"]))


def assign(lib: Library, windows: DataFrame) -> DataFrame:
    """windows (detector, vector) with cluster_<layer> in every layer, -1 where unassigned or where the detector lacks the layer; no shuffle."""
    names = [layer.name for layer in layers(lib.tree)]
    shared = windows.sparkSession.sparkContext.broadcast(pickle.dumps(lib.nodes))
    opened: dict = {}

    @F.pandas_udf("array<long>")
    def of(detector: pd.Series, vector: pd.Series) -> pd.Series:
        if not opened:
            opened.update(pickle.loads(shared.value))
        out, some = np.full((len(vector), len(names)), -1, np.int64), vector.notna().to_numpy()
        for d in set(detector[some]):
            at = np.flatnonzero(some & (detector == d).to_numpy())
            x = np.stack(vector.iloc[at].to_list())
            for k, name in enumerate(names):
                if (d, name) in opened:
                    out[at, k] = opened[d, name].assign(x)
        return pd.Series(list(out))

    return windows.withColumn("_c", of("detector", "vector")).select("*", *(F.get("_c", F.lit(k)).alias(f"cluster_{n}") for k, n in enumerate(names))).drop("_c")


def blocks(lib: Library, windows: DataFrame, keys: list[str] | None = None, period: tuple[int, int] | None = None) -> DataFrame:
    """Decisions of blocks of windows (detector, start, cluster_<layer>, the rules' measures), for each of the keys.

    Columns: keys, block_start, n_<detector>; for each layer <layer> (decision), <layer>_score, <layer>_p_<group>
    and <layer>_<detector> (what the detector alone says); rule, path and decision, the deepest sure one. The first
    rule of a detector that holds takes its evidence from the first layer; where none is left, the first
    such detector's rule decides. A period adds its blocks without windows and leaves out all others.
    """
    keys = [*(keys or []), "block_start"]
    every = list(layers(lib.tree))
    w = windows.filter(F.col("detector").isin(*lib.detectors)).withColumn("block_start", S.floor_to(F.col("start"), lib.width))
    small = lib.stats.count() <= MAX_CENTROIDS
    for layer in every:
        own = lib.stats.filter(F.col("layer") == layer.name).select("detector", F.col("cluster").alias(f"cluster_{layer.name}"), F.col("p").alias(f"_p_{layer.name}"))
        w = w.join(F.broadcast(own) if small else own, ["detector", f"cluster_{layer.name}"], "left")
    aggs: list[Column] = []
    top = lib.tree.name
    for i, d in enumerate(lib.detectors):
        mine = F.col("detector") == d
        aggs += [F.count_if(mine).alias(f"_n{i}"), F.count_if(mine & (F.col(f"cluster_{top}") >= 0)).alias(f"_a{i}")]
        aggs += [F.median(F.when(mine, F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")))).alias(f"_m{i}_{m}") for m in lib.measures]
        for layer in every:
            aggs += [F.avg(F.when(mine, F.get(f"_p_{layer.name}", F.lit(k)))).alias(f"_{i}_{layer.name}_{k}") for k in range(len(layer.groups))]
    x = w.groupBy(*keys).agg(*aggs)
    if period is not None:
        first, last = period[0] - period[0] % lib.width, -(-period[1] // lib.width) * lib.width
        grid = windows.sparkSession.range(first, last, lib.width).select(F.col("id").alias("block_start"))
        grid = grid if len(keys) == 1 else grid.crossJoin(F.broadcast(windows.select(*keys[:-1]).distinct()))
        x = grid.join(x, keys, "left").fillna(0, [f"_{c}{i}" for c in "na" for i in range(len(lib.detectors))])
    null = F.lit(None).cast("string")
    text, then = [], []
    for i, d in enumerate(lib.detectors):
        of = {"n_windows": f"_n{i}", "n_assigned": f"_a{i}", **{f"median_{m}": f"_m{i}_{m}" for m in lib.measures}}
        rules = lib.rules.get(d, [])
        there = F.col(f"_n{i}") > 0
        text.append(F.when(there, S.rule_chain([(of[c], op, v, f"{d}: {c} {op} {v:g}") for c, op, v, _ in rules], null)))
        then.append(F.when(there, S.rule_chain([(of[c], op, v, t) for c, op, v, t in rules], null)))
    x = x.withColumns({**{f"_r{i}": t for i, t in enumerate(text)}, **{f"_t{i}": t for i, t in enumerate(then)}})
    out: dict[str, Column] = {}

    def walk(layer: Layer, reached: Column, root: bool) -> tuple[Column, Column]:
        nonlocal x
        groups, having = list(layer.groups), lib.of(layer)
        by, bases, weights = [], [], []
        for i, d in enumerate(lib.detectors):
            if d not in having:
                continue
            p = [F.col(f"_{i}_{layer.name}_{k}") for k in range(len(groups))]
            alone = S.decide(p, groups, layer.min_score)
            alone = F.when(alone == "no_data", "uncertain").otherwise(alone)
            alone = F.coalesce(F.col(f"_t{i}"), alone) if root else alone
            out[f"{layer.name}_{d}"] = F.when(reached, F.when(F.col(f"_n{i}") > 0, alone).otherwise("no_detections")).otherwise("n/a")
            by.append([F.when(F.col(f"_r{i}").isNull(), v) for v in p] if root else p)
            bases.append(lib.bases[d, layer.name])
            weights.append(lib.weights.get(d, 1.0))
        # Merged once, as columns of their own, so that deeper layers don't repeat the expressions.
        x = x.withColumns({f"_e_{layer.name}_{k}": m for k, m in enumerate(S.merge_evidence(by, bases, weights))})
        merged = [F.col(f"_e_{layer.name}_{k}") for k in range(len(groups))]
        own = S.decide(merged, groups, layer.min_score)
        ruled = F.lit(False)
        if root:
            ruled = (own == "no_data") & F.coalesce(*(F.col(f"_r{i}") for i in range(len(lib.detectors)))).isNotNull()
            own = F.when(ruled, F.coalesce(*(F.col(f"_t{i}") for i in range(len(lib.detectors))))).otherwise(own)
            out["rule"] = F.when(ruled, F.coalesce(*(F.col(f"_r{i}") for i in range(len(lib.detectors)))))
        x = x.withColumn(f"_d_{layer.name}", F.when(reached, F.when(own == "no_data", "no_detections").otherwise(own)).otherwise("n/a"))
        own = F.col(f"_d_{layer.name}")
        out[layer.name] = own
        out[f"{layer.name}_score"] = F.when(reached, S.decision_score(merged))
        out.update({f"{layer.name}_p_{g}": F.when(reached, m) for g, m in zip(groups, merged, strict=True)})
        sure = reached & ~own.isin(*OPEN) & ~ruled
        path, decision = F.when(sure, own).otherwise(""), own
        for group, child in layer.children.items():
            if not lib.of(child):
                continue
            at = reached & (own == group)
            deeper, last = walk(child, at, False)
            path = F.when(at & (deeper != ""), F.concat(F.lit(f"{group} > "), deeper)).otherwise(path)
            decision = F.when(at & ~last.isin(*OPEN), last).otherwise(decision)
        return path, decision

    path, decision = walk(lib.tree, F.lit(True), True)
    return x.select(*keys, *(F.col(f"_n{i}").alias(f"n_{d}") for i, d in enumerate(lib.detectors)), *(c.alias(n) for n, c in out.items()), path.alias("path"), decision.alias("decision"))


def classify(lib: Library, windows: DataFrame, keys: list[str] | None = None, period: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of new windows (detector, start, vector): assigned, merged and decided in all layers."""
    return blocks(lib, assign(lib, windows), keys, period)
