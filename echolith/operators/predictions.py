"""The long table of class probabilities: checks, pivots, aggregates, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions.scalars import argmax_class, decide, decision_score, floor_to


def validate(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows or detections break each rule of the long table."""
    p = F.col("probability")
    rows = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("class").isNull() | p.isNull()).alias("n_null"),
        F.count_if(~F.col("voc_type").isin("whistle", "click", "other")).alias("n_bad_type"),
        F.count_if((p < 0) | (p > 1)).alias("n_out_of_range"),
    )
    twice = df.groupBy(*key, "class").count().filter("count > 1").agg(F.count("*").alias("n_duplicate_keys"))
    sums = df.groupBy(*key).agg(F.sum("probability").alias("s")).filter("abs(s - 1) > 0.01").agg(F.count("*").alias("n_bad_sum"))
    return rows.crossJoin(twice).crossJoin(sums)  # one row each


def to_wide(df: DataFrame, key: list[str], classes: list[str], how=F.first) -> DataFrame:
    return df.groupBy(*key).pivot("class", classes).agg(how("probability"))


def to_long(df: DataFrame, key: list[str], classes: list[str]) -> DataFrame:
    return df.unpivot(key, classes, "class", "probability")


def event_predictions(df: DataFrame, event: str, classes: list[str]) -> DataFrame:
    """Summed and renormalised probabilities of each event, decision, score, detections, first truth."""
    wide = df.groupBy(event).pivot("class", classes).agg(F.sum("probability"))
    info = df.groupBy(event).agg(F.countDistinct("detection_id").alias("n_detections"), F.min("true_class").alias("true_class"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.col(classes[0]), F.lit(0.0)))
    wide = wide.withColumn("_t", total).select(event, *((F.coalesce(F.col(c), F.lit(0.0)) / F.col("_t")).alias(c) for c in classes))
    probs = [F.col(c) for c in classes]
    return wide.join(info, event).withColumn("predicted", argmax_class(probs, classes)).withColumn("score", decision_score(probs))


def group_predictions(wide: DataFrame, group: str, classes: list[str], min_score: float) -> DataFrame:
    """Mean probabilities of the detections that reach min_score; groups without one stay, null."""
    ok = decision_score([F.col(c) for c in classes]) >= min_score
    return wide.groupBy(group).agg(
        *(F.avg(F.when(ok, F.col(c))).alias(c) for c in classes), F.count_if(ok).alias("n"), F.count("*").alias("n_total"), F.min("true_class").alias("true_class")
    )


def threshold_curve(events: DataFrame, thresholds: int, step: float) -> DataFrame:
    """Coverage and accuracy of decided events for each threshold, in one pass over the events.

    Each event is counted at the last threshold it passes; running sums do the rest.
    """
    top = F.least(F.floor(F.col("score") / step + 1e-9), F.lit(thresholds - 1)).cast("int")
    at = events.groupBy(top.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("true_class")).alias("ok"))
    spark = events.sparkSession
    grid = spark.range(thresholds).select(F.col("id").cast("int").alias("k")).join(at, "k", "left").fillna(0)
    w = Window.orderBy(F.desc("k"))  # a row for each threshold
    summed = grid.select("k", F.sum("n").over(w).alias("n_decided"), F.sum("ok").over(w).alias("n_correct"), F.sum("n").over(Window.partitionBy()).alias("n_all"))
    return summed.select((F.col("k") * step).alias("threshold"), "n_decided", (F.col("n_decided") / F.col("n_all")).alias("coverage"), F.try_divide("n_correct", "n_decided").alias("accuracy"))


def confusion(events: DataFrame, classes: list[str]) -> DataFrame:
    return events.groupBy("true_class").pivot("predicted", classes).agg(F.count(F.lit(1))).fillna(0, classes)


def performance(events: DataFrame, min_score: float) -> DataFrame:
    """By class: events, decided, recall among the decided, coverage."""
    ok = F.col("score") >= min_score
    right = ok & (F.col("predicted") == F.col("true_class"))
    return events.groupBy("true_class").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_decided"), (F.count_if(ok) / F.count("*")).alias("coverage"), F.try_divide(F.count_if(right), F.count_if(ok)).alias("recall")
    )


def block_vectors(df: DataFrame, keys: list[Column], types: list[str], classes: list[str]) -> DataFrame:
    """One row a block: renormalised mean probabilities by type and class, has_ and n_ columns; missing types are 0."""
    sums, n = [], []
    for t in types:
        mine = F.col("voc_type") == t
        sums += [F.avg(F.when(mine & (F.col("class") == c), F.col("probability"))).alias(f"{t}|{c}") for c in classes]
        n.append(F.countDistinct(F.when(mine, F.col("detection_id"))).alias(f"n_{t}"))
    wide = df.groupBy(*keys).agg(*sums, *n)
    for t in types:
        total = sum((F.coalesce(F.col(f"{t}|{c}"), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.col(f"{t}|{classes[0]}"), F.lit(0.0)))
        wide = wide.withColumn("_t", total).withColumns({f"{t}|{c}": F.coalesce(F.try_divide(F.col(f"{t}|{c}"), F.col("_t")), F.lit(0.0)) for c in classes})
        wide = wide.withColumn(f"has_{t}", (F.col(f"n_{t}") > 0).cast("int")).drop("_t")
    return wide


def block_decisions(df: DataFrame, group: str, width: int, classes: list[str], min_score: float) -> DataFrame:
    """Clock-aligned blocks of each group: mean of the types' renormalised means, class, score, decision."""
    keys = [F.col(group), floor_to(F.col("t_us"), width).alias("block_us")]
    by_type = df.groupBy(*keys, "voc_type", "class").agg(F.avg("probability").alias("p"), F.countDistinct("detection_id").alias("n"))
    wide = by_type.groupBy(group, "block_us", "voc_type").agg(*(F.max(F.when(F.col("class") == c, F.col("p"))).alias(c) for c in classes), F.max("n").alias("n"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.col(classes[0]), F.lit(0.0)))
    wide = wide.withColumn("_t", total)
    block = wide.groupBy(group, "block_us").agg(*(F.avg(F.coalesce(F.col(c), F.lit(0.0)) / F.col("_t")).alias(c) for c in classes), F.sum("n").alias("n_detections"))
    probs = [F.col(c) for c in classes]
    return block.withColumn("score", decision_score(probs)).withColumn("decision", decide(probs, classes, min_score))


def block_sums(wide: DataFrame, group: str, width: int, classes: list[str]) -> DataFrame:
    """(group, block_us, voc_type, <class>_sum, <class>_n, n): what blocks_of_sums() needs of detections, so that parts can be added up."""
    given = [(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for c in classes]
    sums = [x for c, p in given for x in (F.sum(p).alias(f"{c}_sum"), F.count(p).alias(f"{c}_n"))]
    return wide.groupBy(group, floor_to(F.col("t_us"), width).alias("block_us"), "voc_type").agg(*sums, F.count("*").alias("n"))


def blocks_of_sums(sums: DataFrame, group: str, classes: list[str], min_score: float, digits: int = 6) -> DataFrame:
    """Decisions of blocks from the sums of any parts: the mean of the types' renormalised means.

    Rounded before the decision, so that the order in which parts are added changes nothing. A type
    without a probability other than 0 does not count; a block without any has null classes and ``no_data``.
    """
    keys = [group, "block_us"]
    whole = sums.groupBy(*keys, "voc_type").agg(*(F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in classes), F.sum("n").alias("n"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in classes[1:]), F.coalesce(F.col(classes[0]), F.lit(0.0)))
    whole = whole.withColumn("_t", total)
    block = whole.groupBy(*keys).agg(*(F.round(F.avg(F.try_divide(F.coalesce(F.col(c), F.lit(0.0)), F.col("_t"))), digits).alias(c) for c in classes), F.sum("n").alias("n_detections"))
    probs = [F.col(c) for c in classes]
    return block.withColumn("score", F.round(decision_score(probs), digits)).withColumn("decision", F.when(F.col("score") < min_score, "uncertain").otherwise(decide(probs, classes, 0.0)))


def event_features(df: DataFrame, event: str, classifiers: list[str], classes: list[str]) -> DataFrame:
    """Features <classifier>|<class> (renormalised means, missing 0), n_<classifier>, first and last time."""
    wide = block_vectors(df, [F.col(event)], classifiers, classes).drop(*(f"has_{t}" for t in classifiers))
    span = df.groupBy(event).agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    return wide.join(span, event)


def filter_events(events: DataFrame, least: dict[str, int], mode: str) -> DataFrame:
    """Events with enough detections of all (and) or any (or) of the types; a missing column counts 0."""
    tests = [(F.col(f"n_{t}") if f"n_{t}" in events.columns else F.lit(0)) >= n for t, n in least.items()]
    held = tests[0]
    for t in tests[1:]:
        held = held & t if mode == "and" else held | t
    return events.filter(held)


def capped_counts(df: DataFrame, group: str, unit: str, label: str, cap: int) -> DataFrame:
    """(group, label, n): rows of each unit count at most cap."""
    per = df.groupBy(group, unit, label).agg(F.count("*").alias("c"))
    return per.groupBy(group, label).agg(F.sum(F.least("c", F.lit(cap))).alias("n"), F.count("*").alias("n_units"))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label of each key, the least of equals, and its count."""
    per = df.groupBy(*keys, label).agg(F.count("*").alias("c"))
    low = per.groupBy(*keys).agg(F.max("c").alias("n"), F.sum("c").alias("n_all"))
    return per.join(low, keys).filter(F.col("c") == F.col("n")).groupBy(*keys).agg(F.min(label).alias("majority"), F.first("n").alias("n"), F.first("n_all").alias("n_all"))


def cap_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each group, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def left_out(df: DataFrame, group: str, unit: str, label: str, cap: int) -> DataFrame:
    """(group, unit, label, n_rest, total_rest): capped counts without the unit, by subtraction from the totals.

    Exact because the cap applies to each unit; no fold is refitted.
    """
    per = df.groupBy(group, unit, label).agg(F.count("*").alias("c")).withColumn("c", F.least("c", F.lit(cap)))
    by_label = per.groupBy(group, label).agg(F.sum("c").alias("_n"))
    by_unit = per.groupBy(group, unit).agg(F.sum("c").alias("_u"))
    total = per.groupBy(group).agg(F.sum("c").alias("_t"))
    own = per.select(group, unit, label, F.col("c").alias("_c"))
    grid = by_unit.join(by_label, group).join(total, group).join(own, [group, unit, label], "left")
    return grid.select(group, unit, label, (F.col("_n") - F.coalesce("_c", F.lit(0))).alias("n_rest"), (F.col("_t") - F.col("_u")).alias("total_rest"))
