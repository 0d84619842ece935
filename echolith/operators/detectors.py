"""Decisions of several detectors on the same blocks of time, merged."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.functions import scalars as S


def merge_blocks(
    tables: Mapping[str, DataFrame], keys: list[str], classes: list[str], bases: Mapping[str, Mapping[str, float]], weights: Mapping[str, float] | None = None, min_score: float = 0.0
) -> DataFrame:
    """One row a block that any detector has: evidence multiplied, decision and score.

    A table has the keys, a probability column for each class it knows, and may
    have ``n`` (windows), ``rule`` (text of a rule that matched) and
    ``rule_decision``. ``bases`` has the rates of each detector's classes; a class
    that a detector does not know is neutral there, and a block of one detector
    keeps its probabilities; a block that a rule decided gives no evidence, and the rule of the first
    detector decides where no evidence is left. All detectors meet in one
    aggregation, each key once from each.
    """
    sides = []
    for k, (name, df) in enumerate(tables.items()):
        has = set(df.columns)
        rule = F.col("rule") if "rule" in has else F.lit(None).cast("string")
        sides.append(df.select(
            *keys, F.lit(k).alias("_k"), (F.col("n").cast("long") if "n" in has else F.lit(1).cast("long")).alias("_n"), rule.alias("_rule"),
            (F.col("rule_decision") if "rule_decision" in has else F.lit(None).cast("string")).alias("_then"),
            F.array(*(F.col(c).cast("double") if c in has else F.lit(None).cast("double") for c in classes)).alias("_p"),
        ))
    rows = reduce(DataFrame.unionByName, sides)
    names = list(tables)
    of = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    aggs: list[Column] = []
    for k in range(len(names)):
        aggs += [of(k, "_n").alias(f"_n{k}"), of(k, "_rule").alias(f"_r{k}"), of(k, "_then").alias(f"_t{k}"), of(k, "_p").alias(f"_p{k}")]
    x = rows.groupBy(*keys).agg(*aggs)

    def evidence(k: int) -> list[Column]:
        known = F.col(f"_r{k}").isNull() & F.exists(f"_p{k}", lambda v: v.isNotNull())
        return [F.when(known, F.get(f"_p{k}", F.lit(i))) for i in range(len(classes))]

    by = [evidence(k) for k in range(len(names))]
    rates = [[bases.get(n, {}).get(c) for c in classes] for n in names]
    merged = S.merge_evidence(by, rates, [(weights or {}).get(n, 1.0) for n in names])
    x = x.select(*x.columns, *(m.alias(c) for m, c in zip(merged, classes, strict=True)))
    probs = [F.col(c) for c in classes]
    first = lambda c: F.coalesce(*(F.when(F.col(f"_r{k}").isNotNull(), F.col(f"_{c}{k}")) for k in range(len(names))))
    text = F.coalesce(*(F.when(F.col(f"_r{k}").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"_r{k}"))) for k, n in enumerate(names)))
    own = S.decide(probs, classes, min_score)
    ruled = (own == "no_data") & text.isNotNull()
    decision = F.when(ruled, F.coalesce(first("t"), F.lit("uncertain"))).when(own == "no_data", "no_detections").otherwise(own)
    return x.select(
        *keys, *(F.coalesce(f"_n{k}", F.lit(0).cast("long")).alias(f"n_{n}") for k, n in enumerate(names)), *classes, S.decision_score(probs).alias("score"),
        F.when(ruled, text).alias("rule"), decision.alias("decision"), F.when(ruled | decision.isin("uncertain", "no_detections"), "").otherwise(decision).alias("path"),
    )


def deepen(parent: DataFrame, child: DataFrame, keys: list[str], group: str) -> DataFrame:
    """parent with the child layer's decision where its own is ``group`` and the child's is a class; the path grows by it."""
    c = child.select(*keys, F.col("decision").alias("_d"), F.col("path").alias("_path"))
    x = parent.join(c, keys, "left")
    at = F.col("decision") == group
    sure = at & F.coalesce(~F.col("_d").isin("uncertain", "no_detections", "no_data", "n/a"), F.lit(False))
    path = F.when(at & (F.coalesce("_path", F.lit("")) != ""), F.concat_ws(" > ", F.lit(group), "_path")).otherwise(F.col("path"))
    return x.withColumns({"decision": F.when(sure, F.col("_d")).otherwise(F.col("decision")), "path": path}).select(*parent.columns)


def merge_held_out(tables: Mapping[str, DataFrame], unit: str, block: str, truth: str, classes: list[str], bases: Mapping[str, Mapping[str, float]], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Held-out window predictions of detectors as blocks: means multiplied, the most frequent truth (least of equals), windows counted."""
    keys = [unit, block]
    known = {n: [c for c in classes if c in t.columns] for n, t in tables.items()}
    means = {n: t.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in known[n]), F.count(known[n][0]).alias("n")) for n, t in tables.items()}
    truths = reduce(DataFrame.unionByName, [t.select(*keys, truth) for t in tables.values()]).groupBy(*keys).agg(F.mode(truth, True).alias("truth"))
    return merge_blocks(means, keys, classes, bases, weights).join(truths, keys)
