"""Classifiers of events on the outputs of others, and of blocks over detection types: fit, hold out, apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.functions import scalars as S
from echolith.operators import density, models
from echolith.operators.models import ForestParams
from echolith.operators.predictions import cap_per_group

#: Settings of event classifiers: small leaves, no cap on the rows of a group.
EVENT_PARAMS = ForestParams(trees=1000, node_size=5, max_per_group=0)


def training_rows(df: DataFrame, features: list[str], label: str, group: str, p: ForestParams, prune: float = 0.0) -> DataFrame:
    """Rows to learn from: labelled, without the outliers of each label, then at most ``max_per_group`` of each group (0: all)."""
    rows = df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    if prune > 0:
        rows = density.prune_outliers(rows, features, label, prune)
    if not p.max_per_group:
        return rows
    order = [F.md5(F.to_json(F.struct(F.lit(p.seed), *features)).cast("binary")), *(F.col(c) for c in features)]
    return cap_per_group(rows, group, order, p.max_per_group)


def fit(df: DataFrame, features: list[str], label: str, group: str, p: ForestParams | None = None, prune: float = 0.0) -> dict:
    """The forest of all rows, as ``models.predict`` takes it."""
    p = p or EVENT_PARAMS
    return models.fit_folds(training_rows(df, features, label, group, p, prune), features, label, group, [], p)


def predict(df: DataFrame, model: dict, features: list[str]) -> DataFrame:
    """df without its features, with a column of each class, predicted and score; features that df lacks are 0."""
    classes = list(map(str, model[None][0]))
    full = df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
    out = models.predict(full, model, features)
    probs = [F.get("probs", F.lit(k)) for k in range(len(classes))]
    return out.withColumns({**dict(zip(classes, probs, strict=True)), "score": S.decision_score(probs)}).drop("probs", *features)


def cross_validate(df: DataFrame, features: list[str], label: str, group: str, id_col: str, p: ForestParams | None = None, classifier: str = "eventclassifier", prune: float = 0.0) -> DataFrame:
    """Held-out predictions in the long table: each row by the forest of the other groups' rows."""
    p = p or EVENT_PARAMS
    train = training_rows(df, features, label, group, p, prune)
    folds = [r[0] for r in train.select(group).distinct().limit(models.MAX_TRAIN + 1).orderBy(group).collect()]
    fitted = models.fit_folds(train, features, label, group, folds, p)
    rows = df.filter(F.col(label).isNotNull())
    out = models.predict(rows, fitted, features, group).filter("probs IS NOT NULL")
    classes = sorted({str(c) for m in fitted.values() for c in m[0]})
    each = F.posexplode("probs").alias("_k", "probability")
    score = S.decision_score([F.get("probs", F.lit(k)) for k in range(len(classes))])
    x = out.select(F.col(id_col).cast("string").alias("detection_id"), F.col(group).cast("string").alias("event_id"), F.col(label).cast("string").alias("true_class"), score.alias("score"), each)
    name = F.get(F.array(*map(F.lit, classes)), F.col("_k")).alias("class")
    return x.select("detection_id", "event_id", F.lit(classifier).alias("classifier"), F.lit("other").alias("voc_type"), name, "probability", "score", "true_class")


def event_table(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """A row an event of the long table: probabilities, predicted, score, its group and, where known, truth (the least of several)."""
    probs = [F.col(c) for c in classes]
    info = [F.min("event_id").alias("group"), *([F.min("true_class").alias("true_class")] if "true_class" in predictions.columns else [])]
    wide = predictions.groupBy(F.col("detection_id").alias("event")).agg(*(F.avg(F.when(F.col("class") == c, F.col("probability"))).alias(c) for c in classes), *info)
    return wide.withColumns({"predicted": S.argmax_class(probs, classes), "score": S.decision_score(probs)})


def summarise(events: DataFrame, min_score: float = 0.0) -> DataFrame:
    """One row: n, accuracy of events that reach the score, mean of the classes' accuracies, share discarded."""
    kept = F.col("score") >= min_score
    right = kept & (F.col("predicted") == F.col("true_class"))
    per = events.groupBy("true_class").agg(F.count("*").alias("n"), F.count_if(kept).alias("k"), F.count_if(right).alias("r"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("r"), F.sum("k")).alias("event_accuracy"), F.avg(F.try_divide("r", "k")).alias("mean_class_accuracy"),
        F.coalesce(1 - F.sum("k") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("events_discarded"),
    )


def summary_curve(events: DataFrame, thresholds: list[float]) -> DataFrame:
    """``summarise`` at every threshold, one pass: (threshold, event_accuracy, mean_class_accuracy, events_kept)."""
    bounds = sorted(thresholds)
    at = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in bounds[1:]), F.when(F.col("score") >= bounds[0], 1).otherwise(0))
    hit = F.count_if(F.col("predicted") == F.col("true_class"))
    per = events.withColumn("_k", at).groupBy("true_class", "_k").agg(F.count("*").alias("n"), hit.alias("r"))  # classes x thresholds rows
    grid = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(k + 1).alias("need")) for k, t in enumerate(bounds))))
    x = per.select("*", grid.alias("g")).select("true_class", "g.threshold", F.when(F.col("_k") >= F.col("g.need"), F.col("n")).otherwise(0).alias("k"), F.when(F.col("_k") >= F.col("g.need"), F.col("r")).otherwise(0).alias("r"), "n")
    by = x.groupBy("threshold", "true_class").agg(F.sum("k").alias("k"), F.sum("r").alias("r"), F.sum("n").alias("n"))
    out = by.groupBy("threshold").agg(F.try_divide(F.sum("r"), F.sum("k")).alias("event_accuracy"), F.avg(F.try_divide("r", "k")).alias("mean_class_accuracy"), (F.sum("k") / F.sum("n")).alias("events_kept"))
    return out


def decide_blocks(blocks: DataFrame, model: dict, features: list[str], block_s: int, min_score: float = 0.0) -> DataFrame:
    """New block vectors by the final forest: span, counts, probabilities, predicted, score, decision."""
    classes = list(map(str, model[None][0]))
    counts = [c for c in blocks.columns if c.startswith("n_") and c not in features]
    out = predict(blocks, model, features)
    said = F.when(F.col("score") >= min_score, F.col("predicted")).otherwise("uncertain")
    return out.select("block_start", (F.col("block_start") + block_s).alias("block_end"), *counts, *(F.col(c).alias(f"p_{c}") for c in classes), "predicted", "score", said.alias("decision"))


def discover(
    units: DataFrame, key: str, unit: str, cluster: Callable[[DataFrame], DataFrame], label: str, classes: tuple[str, str], vector: str, cap: int = 50, min_units: int = 2
) -> dict[str, DataFrame]:
    """Discovery as one call: clusters of a pool's units with their summary and verdicts, held-out verdicts and the scorecard.

    ``cluster`` gives (key, cluster) of every unit; units keep a null label
    where they have none. Every table is a plan over the same clusters, which
    the caller may write first.
    """
    from echolith.operators import application, clusters, discovery, evaluation

    found = units.join(cluster(units).select(key, "cluster"), key)
    yes = F.when(F.col(label).isin(*classes), F.col(label) == classes[0])
    verdicts = clusters.binary_verdicts(found.withColumn("_yes", yes), "cluster", unit, "_yes", cap=cap, min_units=min_units)
    verdicts = verdicts.withColumn("verdict", F.when(F.col("verdict") == "yes", classes[0]).when(F.col("verdict") == "no", classes[1]).otherwise("uncertain"))
    held_out = application.left_out_predictions(found, "cluster", unit, label, classes, cap=cap, min_units=min_units)
    size = discovery.summary(found.filter("cluster >= 0").fillna("unlabelled", [label]), "cluster", label, unit)
    return {
        "units": found, "clusters": size.join(verdicts.select("cluster", "p", "low", "high", "base", "verdict"), "cluster", "left"),
        "held_out": held_out, "by_unit": application.left_out_by_unit(held_out, unit, label), "held_out_skill": evaluation.leave_out_summary(held_out, label, "predicted"),
        "scorecard": evaluation.scorecard(found.filter(F.col(label).isNotNull()), key, unit, "cluster", vector, label),
    }
