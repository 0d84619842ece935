"""Pools of units, filters, cluster summaries and multiclass verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions.scalars import known
from echolith.operators.clusters import beta_quantile

#: Labels that say nothing of a class.
NO_LABEL = ["none", "partial", "mixed", "untyped", "unknown", "unlabelled", "n/a", "nan", "", "AMBIGUOUS"]


def typed(label: Column) -> Column:
    return label.isNotNull() & ~label.isin(NO_LABEL)


def pool(units: DataFrame, label: str, day: str, annotated_days: DataFrame, include_none: bool = False, include_other_days: bool = True) -> DataFrame:
    """Units for discovery: typed ones, ``none`` on annotated days if wanted, and those of days without annotations."""
    days = annotated_days.select(day).distinct().withColumn("_annotated", F.lit(True))
    rows = units.join(days, day, "left").withColumn("_annotated", F.coalesce("_annotated", F.lit(False)))
    kind = F.when(typed(F.col(label)), "typed").when(~F.col("_annotated"), "unannotated").when(F.coalesce(label, F.lit("none")) == "none", "none").otherwise("other")
    wanted = ["typed", *(["none"] if include_none else []), *(["unannotated"] if include_other_days else [])]
    return rows.withColumn("pool", kind).filter(F.col("pool").isin(wanted)).drop("_annotated")


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """Every measure lies in its range; null and NaN are kept."""
    out = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            out = out & ~F.coalesce(known(F.col(c)) < low, F.lit(False))
        if high is not None:
            out = out & ~F.coalesce(known(F.col(c)) > high, F.lit(False))
    return out


def with_enough_groups(df: DataFrame, label: str, group: str, least: int = 2) -> DataFrame:
    """Rows of labels that occur in enough groups."""
    ok = df.groupBy(label).agg(F.countDistinct(group).alias("_n")).filter(F.col("_n") >= least).select(label)
    return df.join(ok, label, "left_semi")


def label_checks(df: DataFrame, label: str, group: str, start: str, end: str) -> DataFrame:
    """Groups, detections and seconds by label."""
    return df.groupBy(label).agg(F.countDistinct(group).alias("n_groups"), F.count("*").alias("n"), F.sum(F.col(end) - F.col(start)).alias("span"))


def spans(df: DataFrame, event: str, start: str, end: str, label: str) -> DataFrame:
    """First start, last end and most frequent label (least of equals) of each event."""
    per = df.groupBy(event, label).agg(F.count("*").alias("_c"), F.min(start).alias("_s"), F.max(end).alias("_e"))
    return per.groupBy(event).agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.min(F.struct((-F.col("_c")).alias("c"), F.col(label))).alias("_m")).select(event, "start", "end", F.col("_m")[label].alias("label"))


def class_shares(df: DataFrame, cluster: str, unit: str, label: str, cap: int = 50, prior: float = 10.0, across: bool = False) -> DataFrame:
    """(cluster, label, n, n_units, weight, p): capped counts, balanced by class and shrunk to equal shares; rows without cluster (-1) or label don't count.

    The weights' totals cap a unit's rows in each cluster, or, with ``across``, over its clusters together.
    """
    held = df.filter((F.col(cluster) >= 0) & F.col(label).isNotNull())
    per = held.groupBy(cluster, unit, label).agg(F.count("*").alias("_n")).withColumn("_c", F.least("_n", F.lit(cap)))
    n = per.groupBy(cluster, label).agg(F.sum("_c").alias("n"), F.count("*").alias("n_units"))
    spread = per.groupBy(unit, label).agg(F.least(F.sum("_n"), F.lit(cap)).alias("n")) if across else n
    total = spread.groupBy(label).agg(F.sum("n").alias("_t"))
    k = F.count("*").over(Window.partitionBy())  # a row for each class
    weights = total.withColumn("weight", F.sum("_t").over(Window.partitionBy()) / k / F.col("_t")).withColumn("_k", k)
    x = n.join(F.broadcast(weights), label).withColumn("_w", F.col("n") * F.col("weight"))
    w = F.sum("_w").over(Window.partitionBy(cluster))
    return x.withColumn("p", (F.col("_w") + F.lit(prior) / F.col("_k")) / (w + prior)).select(cluster, label, "n", "n_units", "weight", "p")


def class_verdicts(shares: DataFrame, cluster: str, label: str, prior: float = 10.0, ci: float = 0.9, min_units: int = 2) -> DataFrame:
    """The class of the greatest share, the least of equals, of those in a cluster whose lower Beta bound is above an equal share and that have enough units.

    ``uncertain``, with p and low of the greatest share, where no class passes.
    """

    @F.pandas_udf("double")
    def low(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([beta_quantile((1 - ci) / 2, x, max(y, 1e-6)) for x, y in zip(a, b, strict=True)])

    every = shares.select(label).distinct().count()
    total = F.sum(F.col("n") * F.col("weight")).over(Window.partitionBy(cluster)) + prior
    x = shares.withColumn("_a", F.col("p") * total).withColumn("low", low(F.col("_a"), total - F.col("_a")))
    ok = (F.col("low") > 1 / every) & (F.col("n_units") >= min_units)
    one = F.struct((~ok).alias("other"), (-F.col("p")).alias("p"), F.col(label), F.col("low"))
    best = x.groupBy(cluster).agg(F.min(one).alias("b"))
    return best.select(cluster, F.when(F.col("b.other"), "uncertain").otherwise(F.col("b")[label].cast("string")).alias("verdict"), (-F.col("b.p")).alias("p"), "b.low")


def summary(df: DataFrame, cluster: str, label: str, unit: str, top: int = 3) -> DataFrame:
    """Size, units, top labels as text, share of the largest unit and of the largest label."""
    per = df.groupBy(cluster, label).agg(F.count("*").alias("c"))
    by_unit = df.groupBy(cluster, unit).agg(F.count("*").alias("c")).groupBy(cluster).agg(F.count("*").alias("n_units"), F.max("c").alias("top_unit"))
    names = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(label).alias("l"))))
    lab = per.groupBy(cluster).agg(F.sum("c").alias("n"), F.max("c").alias("top_label"), F.slice(names, 1, top).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["l"], -x["c"])), ";")
    return lab.join(by_unit, cluster).select(cluster, "n", "n_units", text.alias("top_labels"), (F.col("top_label") / F.col("n")).alias("label_share"), (F.col("top_unit") / F.col("n")).alias("unit_share"))
