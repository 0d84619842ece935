"""A frozen library applied to new windows: verdicts, votes of decision blocks, rules; verdicts without each unit."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators.clusters import beta_quantile
from echolith.operators.intervals import overlapping


@dataclass(frozen=True)
class Task:
    """A question to the library: two labels (positive, negative), or several classes with a least score."""

    name: str
    labels: tuple[str, str] | None = None
    classes: tuple[str, ...] = ()
    min_score: float = 0.0


def classify_windows(assigned: DataFrame, verdicts: DataFrame, tasks: list[Task], cluster: str = "cluster") -> DataFrame:
    """assigned windows with ``<task>_pred`` and ``<task>_p_<class>`` of their cluster.

    verdicts: a row a cluster. Unassigned windows (-1) and clusters without a
    verdict are ``uncertain`` and have no probabilities.
    """
    said = [f"{t.name}_pred" for t in tasks if f"{t.name}_pred" in verdicts.columns]
    of = said + [f"{t.name}_p_{c}" for t in tasks for c in t.classes]
    joined = assigned.join(verdicts.filter(F.col(cluster) >= 0).select(cluster, *of), cluster, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("uncertain")) for c in said})


def _text(rule: tuple[str, str, float, str]) -> str:
    return f"{rule[0]} {rule[1]} {rule[2]:g}"


def block_votes(
    windows: DataFrame, contours: DataFrame, tasks: list[Task], width: int, bucket: int, rules: list[tuple[str, str, float, str]] | None = None,
    requires: dict[str, tuple[str, str]] | None = None, period: tuple[int, int] | None = None, by: str = "overlap",
) -> DataFrame:
    """Clock-aligned blocks of classified windows: counts, values that rules read, votes, decisions.

    windows: w_start, w_end (integers, as ``width`` and ``bucket``), cluster,
    the columns of ``classify_windows`` and, where known, ``abs_slope`` and
    ``freq``. contours: contour_id, start, end, mean_freq_hz, duration_s; those
    that overlap a window of the block (or whose middle it holds, by
    ``midpoint``) count once. A task of two labels takes the strict majority of
    its votes, one of classes the mean probabilities of its windows. The first
    rule that holds decides every task; else a task that ``requires`` another
    one's value is ``n/a`` without it. With a period, its blocks without
    windows are ``no_detections``, and no others are given.
    """
    block = lambda c: S.floor_to(F.col(c), width)
    w = windows.withColumn("block_start", block("w_start"))
    aggs = [F.count("*").alias("n_windows"), F.count_if(F.col("cluster") >= 0).alias("n_assigned")]
    for t in tasks:
        if t.classes:
            aggs += [F.avg(f"{t.name}_p_{c}").alias(f"{t.name}_p_{c}") for c in t.classes]
        else:
            aggs += [F.count_if(F.col(f"{t.name}_pred") == v).alias(f"{t.name}_n_{v}") for v in t.labels]
    for c, name in (("abs_slope", "block_median_abs_slope_hz_s"), ("freq", "block_median_freq_hz")):
        aggs.append((F.median(F.when(~F.isnan(c), F.col(c))) if c in windows.columns else F.lit(None).cast("double")).alias(name))
    counts = w.groupBy("block_start").agg(*aggs)
    per = w.groupBy("block_start", "cluster").agg(F.count("*").alias("n"))
    votes = per.groupBy("block_start").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cluster"))).alias("v"))
    votes = votes.select("block_start", F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["cluster"], -x["n"])), ";").alias("cluster_votes"))
    calls = contours.select("contour_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "mean_freq_hz", "duration_s")
    if by == "midpoint":
        calls = calls.withColumn("_s", F.floor((F.col("_s") + F.col("_e")) / 2)).withColumn("_e", F.col("_s") + 1)
    pairs = overlapping(w.select("block_start", "w_start", "w_end"), calls, ("w_start", "w_end"), ("_s", "_e"), bucket)
    once = pairs.groupBy("block_start", "contour_id").agg(F.first("mean_freq_hz").alias("mean_freq_hz"), F.first("duration_s").alias("duration_s"))
    heard = once.groupBy("block_start").agg(
        F.count("*").alias("n_contours"), (F.max("mean_freq_hz") - F.min("mean_freq_hz")).alias("block_meanfreq_range_hz"), F.median("duration_s").alias("block_median_contour_s")
    )
    rows = counts.join(votes, "block_start", "left").join(heard, "block_start", "left")
    if period is not None:
        first, last = period[0] - period[0] % width, -(-period[1] // width) * width
        grid = windows.sparkSession.range(first, last, width).select(F.col("id").alias("block_start"))
        rows = grid.join(rows, "block_start", "left")
    x = rows.fillna(0, ["n_windows", "n_assigned", "n_contours"]).fillna("", ["cluster_votes"])
    any_windows = F.col("n_windows") > 0
    for t in tasks:
        if t.classes:
            probs = [F.col(f"{t.name}_p_{c}") for c in t.classes]
            score, said = S.decision_score(probs), S.decide(probs, list(t.classes), t.min_score)
            said = F.when(said == "no_data", "uncertain").otherwise(said)
            x = x.withColumns({f"{t.name}_score": score, f"raw_{t.name}": F.when(any_windows, said).otherwise("no_detections")})
        else:
            yes, no = (F.coalesce(f"{t.name}_n_{v}", F.lit(0).cast("long")) for v in t.labels)
            said = F.when(yes > no, t.labels[0]).when(no > yes, t.labels[1]).otherwise("uncertain")
            share = F.try_divide(F.greatest(yes, no), yes + no)
            x = x.withColumns({f"{t.name}_n_{t.labels[0]}": yes, f"{t.name}_n_{t.labels[1]}": no, f"{t.name}_vote_share": share, f"raw_{t.name}": F.when(any_windows, said).otherwise("no_detections")})
    null = F.lit(None).cast("string")
    rules = rules or []
    text = S.rule_chain([(c, op, v, _text((c, op, v, then))) for c, op, v, then in rules], null)
    then = S.rule_chain(rules, null)
    x = x.withColumn("rule", F.when(any_windows, text)).withColumn("_then", F.when(any_windows, then))
    x = x.withColumns({t.name: F.coalesce("_then", F.col(f"raw_{t.name}")) for t in tasks})
    for name, (other, value) in (requires or {}).items():
        x = x.withColumn(name, F.when(any_windows & F.col("rule").isNull() & (F.col(other) != value), "n/a").otherwise(F.col(name)))
    head = ["block_start", "n_windows", "n_assigned", "n_contours", *(t.name for t in tasks), "rule", *(f"raw_{t.name}" for t in tasks)]
    rest = [c for c in x.columns if c not in head and c != "_then"]
    return x.withColumn("block_end", F.col("block_start") + width).select(head[0], "block_end", *head[1:], *rest)


def _beta(q: float):
    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([beta_quantile(q, x, y) if x > 0 and y > 0 else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return bound


def _sums(per: DataFrame, keys: list[str], label: str, labels: list[str], mark: str, support: bool = True) -> DataFrame:
    """keys and, for the k-th label, capped rows <mark>c<k> and units <mark>u<k>."""
    aggs: list[Column] = []
    for k, v in enumerate(labels):
        is_it = F.col(label) == v
        aggs.append(F.sum(F.when(is_it, F.col("_c")).otherwise(0)).alias(f"{mark}c{k}"))
        if support:
            aggs.append(F.count_if(is_it).alias(f"{mark}u{k}"))
    return per.groupBy(*keys).agg(*aggs)


def _without_unit(df: DataFrame, cluster: str, unit: str, label: str, labels: list[str], cap: int) -> DataFrame:
    """(unit, cluster) of labelled rows in a cluster: counts of the other units' rows, in the cluster (c, u) and in all (t).

    By subtraction from totals, which is exact because the cap applies to each
    unit; no fold is computed anew.
    """
    per = df.filter((F.col(cluster) >= 0) & F.col(label).isin(labels)).groupBy(cluster, unit, label).agg(F.least(F.count("*"), F.lit(cap)).alias("_c"))
    own = _sums(per, [cluster, unit], label, labels, "o")
    whole = _sums(per, [cluster], label, labels, "w")
    # The cap of the totals holds over a unit's clusters together.
    spread = df.filter((F.col(cluster) >= 0) & F.col(label).isin(labels)).groupBy(unit, label).agg(F.least(F.count("*"), F.lit(cap)).alias("_c"))
    of_unit = _sums(spread, [unit], label, labels, "x", support=False)
    of_all = _sums(spread, [], label, labels, "a", support=False)  # one row
    n = range(len(labels))
    x = own.join(whole, cluster).join(of_unit, unit).crossJoin(F.broadcast(of_all))
    rest = [(F.col(f"w{m}{k}") - F.col(f"o{m}{k}")).alias(f"{m}{k}") for m in "cu" for k in n]
    return x.select(unit, cluster, *rest, *((F.col(f"ac{k}") - F.col(f"xc{k}")).alias(f"t{k}") for k in n))


def left_out_verdicts(df: DataFrame, cluster: str, unit: str, label: str, labels: tuple[str, str], cap: int = 50, prior: float = 10.0, ci: float = 0.9, min_units: int = 2) -> DataFrame:
    """(unit, cluster, verdict): what a cluster says of two labels without the unit, for each unit with labelled rows in it."""
    x = _without_unit(df, cluster, unit, label, list(labels), cap)
    x = x.withColumn("_base", F.try_divide("t0", F.col("t0") + F.col("t1")))
    a, b = F.col("c0") + prior * F.col("_base"), F.col("c1") + prior * (1 - F.col("_base"))
    q = (1 - ci) / 2
    x = x.withColumn("low", _beta(q)(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))).withColumn("high", _beta(1 - q)(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
    yes = (F.col("low") > F.col("_base")) & (F.col("u0") >= min_units)
    no = (F.col("high") < F.col("_base")) & (F.col("u1") >= min_units)
    return x.select(unit, cluster, F.when(yes, labels[0]).when(no, labels[1]).otherwise("uncertain").alias("verdict"))


def left_out_predictions(df: DataFrame, cluster: str, unit: str, label: str, labels: tuple[str, str], **how) -> DataFrame:
    """Labelled rows with ``predicted``: their cluster's verdict without their own unit.

    Rows without a cluster are ``uncertain``. A unit without which a label has
    no row left at all is not predicted.
    """
    rows = df.filter(F.col(label).isin(*labels))
    n = rows.groupBy(unit).agg(*(F.count_if(F.col(label) == v).alias(f"_n{k}") for k, v in enumerate(labels)))
    total = n.agg(*(F.sum(f"_n{k}").alias(f"_t{k}") for k in (0, 1)))
    kept = n.crossJoin(F.broadcast(total)).filter("_t0 > _n0 AND _t1 > _n1").select(unit)
    said = left_out_verdicts(df, cluster, unit, label, labels, **how)
    out = rows.join(kept, unit, "left_semi").join(said, [unit, cluster], "left")
    return out.withColumn("predicted", F.coalesce("verdict", F.lit("uncertain"))).drop("verdict")


def left_out_by_unit(predictions: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, true_labels, n, coverage, accuracy) of held-out predictions; the labels by count, then name."""
    decided = F.col("predicted") != "uncertain"
    per = predictions.groupBy(unit, label).agg(F.count("*").alias("n"), F.count_if(decided).alias("d"), F.count_if(F.col("predicted") == F.col(label)).alias("r"))
    names = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))))
    out = per.groupBy(unit).agg(names.alias("v"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("r").alias("r"))
    text = F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["l"], -x["n"])), "; ")
    return out.select(unit, text.alias("true_labels"), "n", (F.col("d") / F.col("n")).alias("coverage"), F.try_divide("r", "d").alias("accuracy"))


def left_out_probabilities(df: DataFrame, cluster: str, unit: str, label: str, classes: list[str], cap: int = 50, prior: float = 10.0, balanced: bool = True) -> DataFrame:
    """Labelled rows with ``p_<class>`` of their cluster without their own unit; null for rows without a cluster.

    Classes count equally where each has rows left, else as often as they
    occur. A cluster that only the unit's rows are in gives nothing, nor does
    a corpus without other labelled rows: those units are left out.
    """
    x = _without_unit(df, cluster, unit, label, classes, cap)
    n = range(len(classes))
    k, total = len(classes), sum((F.col(f"t{i}") for i in n[1:]), F.col("t0"))
    full = F.lit(balanced) & F.least(*(F.col(f"t{i}") for i in n)).__gt__(0) if k > 1 else F.lit(balanced) & (F.col("t0") > 0)
    base = [F.when(full | (total == 0), 1.0 / k).otherwise(F.try_divide(F.col(f"t{i}"), total)) for i in n]
    weight = [F.when(full, F.try_divide(total / k, F.col(f"t{i}"))).otherwise(1.0) for i in n]
    a = [F.col(f"c{i}") * weight[i] + prior * base[i] for i in n]
    mass = sum(a[1:], a[0])
    # Clusters stay known while any row of another unit is in them, labelled or not.
    by = df.filter(F.col(cluster) >= 0).groupBy(cluster, unit).agg(F.count("*").alias("_n"))
    known = by.withColumn("_all", F.sum("_n").over(Window.partitionBy(cluster))).filter("_all > _n").select(cluster, unit)
    probs = x.join(known, [unit, cluster], "left_semi").select(unit, cluster, *((a[i] / mass).alias(f"p_{c}") for i, c in enumerate(classes)))
    rows = df.filter(F.col(label).isin(classes))
    units = rows.groupBy(unit).agg(F.count("*").alias("_n"))
    kept = units.crossJoin(F.broadcast(units.agg(F.sum("_n").alias("_all")))).filter("_all > _n").select(unit)
    return rows.join(kept, unit, "left_semi").join(probs, [unit, cluster], "left")
