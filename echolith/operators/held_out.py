"""Held-out predictions evaluated at once for windows, blocks and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import scalars as S

LEVELS = ("window", "block", "unit")


def levels(preds: DataFrame, classes: list[str], unit: str, start: str, truth: str, width: int) -> DataFrame:
    """(level, unit, block, truth, n_windows, n_with_probs, classes): held-out windows, and the mean probabilities of blocks of each unit and of units.

    One aggregation over grouping sets gives blocks and units. Means are over the windows with probabilities (null and NaN
    are none); the truth is the most frequent one, the least of equals.
    """
    x = preds.select(F.col(unit).alias("unit"), S.floor_to(F.col(start), width).alias("block"), F.col(truth).alias("truth"), *(S.known(F.col(c)).alias(c) for c in classes))
    sets = [[F.col("unit"), F.col("block")], [F.col("unit")]]
    of = x.groupingSets(sets, "unit", "block").agg(
        F.grouping_id().alias("_g"), F.mode("truth", True).alias("truth"), F.count("*").alias("n_windows"), F.count(classes[0]).alias("n_with_probs"), *(F.avg(c).alias(c) for c in classes)
    )
    names = ["level", "unit", "block", "truth", "n_windows", "n_with_probs", *classes]
    many = of.withColumn("level", F.when(F.col("_g") == 0, "block").otherwise("unit")).select(*names)
    one = x.withColumns({"level": F.lit("window"), "n_windows": F.lit(1).cast("long"), "n_with_probs": F.col(classes[0]).isNotNull().cast("long")}).select(*names)
    return one.unionByName(many)


def curve(rows: DataFrame, classes: list[str], thresholds: list[float]) -> DataFrame:
    """(level, threshold, n, coverage, accuracy, balanced_accuracy) of each level at each threshold, in one pass over the rows.

    coverage: share of rows with a score that reaches the threshold; accuracy of those; balanced: the mean of the
    classes' shares right, over the classes that have decided rows. A row is counted at the last threshold it
    reaches; running sums over the thresholds do the rest.
    """
    thresholds = sorted(thresholds)
    probs = [F.col(c) for c in classes]
    x = rows.select("level", "truth", S.argmax_class(probs, classes).alias("said"), S.decision_score(probs).alias("score"))
    k = sum(((F.col("score") >= t).cast("int") for t in thresholds[1:]), (F.col("score") >= thresholds[0]).cast("int")) - 1
    at = x.groupBy("level", "truth", F.coalesce(k, F.lit(-1)).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("truth")).alias("ok"))
    names = F.array(*map(F.lit, thresholds))
    every = at.select("level", "truth").distinct().crossJoin(at.sparkSession.range(-1, len(thresholds)).select(F.col("id").cast("int").alias("k")))  # a row a level, truth and threshold
    grid = every.withColumn("_t", F.coalesce("truth", F.lit(""))).join(at.withColumn("_t", F.coalesce("truth", F.lit(""))).drop("truth"), ["level", "_t", "k"], "left").fillna(0, ["n", "ok"])
    down = Window.partitionBy("level", "truth").orderBy(F.desc("k"))
    sums = grid.select("level", "truth", "k", F.sum("n").over(down).alias("n"), F.sum("ok").over(down).alias("ok"), F.sum("n").over(Window.partitionBy("level")).alias("n_all")).filter("k >= 0")
    per = F.when(F.col("truth").isin(*classes) & (F.col("n") > 0), F.col("ok") / F.col("n"))
    out = sums.groupBy("level", "k").agg(F.max("n_all").alias("n"), F.sum("n").alias("_d"), F.sum("ok").alias("_ok"), F.avg(per).alias("balanced_accuracy"))
    return out.select("level", F.get(names, F.col("k")).alias("threshold"), "n", (F.col("_d") / F.col("n")).alias("coverage"), F.try_divide("_ok", "_d").alias("accuracy"), "balanced_accuracy")


def evaluate(preds: DataFrame, classes: list[str], unit: str, start: str, truth: str, width: int, min_score: float = 0.0, thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """Everything from one table of levels: ``rows`` with decisions, ``curve``, ``performance`` (a row a level) and ``confusion`` (level, truth, decision, n of decided rows)."""
    probs = [F.col(c) for c in classes]
    rows = levels(preds, classes, unit, start, truth, width)
    decided = rows.withColumns({"score": S.decision_score(probs), "decision": S.decide(probs, classes, min_score)})
    confusion = decided.filter(~F.col("decision").isin("uncertain", "no_data")).groupBy("level", "truth", "decision").agg(F.count("*").alias("n"))
    steps = thresholds or [k / 50 for k in range(26)]
    return {"rows": decided, "curve": curve(rows, classes, steps), "performance": curve(rows, classes, [min_score]), "confusion": confusion}
