"""Selects labelled units for training a classifier: one of equal texts, enough groups, a cap, folds over groups.

    python -m jobs.training_selection --documents DIR --labels DIR --out DIR [--config jobs/training_selection.json]

Units are documents with labels; their groups are the sources. Texts that are
equal but for case and blanks are one unit, the one of the least id, so that
copies never lie on both sides of a split. Labels of too few groups go, each
group gives each label at most ``cap`` units in a random order that every run
repeats, and whole groups are dealt over the folds.

Writes ``selection`` (a row a unit) by fold and label and ``report`` (counts) by
fold, each overwritten as a whole, so a rerun gives the same.

Defined results: units without text, id or label are not selected; a null source is the group
``n/a``; of several label rows of an id the least counts; a hot group is cut to
its cap in each task before the shuffle.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.operators.discovery import with_enough_groups
from echolith.operators.network import group_folds
from echolith.operators.predictions import cap_per_group
from jobs.common import command, settings

LOG = logging.getLogger("training_selection")

#: ``min_groups``: least groups of a label. ``cap``: most units of a label from a group. ``folds``: number of folds.
DEFAULTS = {"min_groups": 2, "cap": 50, "folds": 5}
COLUMNS = "doc_id long, text_md5 string, lang string, source string, n_chars long, n_copies long, fold int, label string"


def units(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_md5, lang, source, label, n_chars, n_copies): a row for each different labelled text."""
    named = labels.filter(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("_labels"))
    label = F.concat(F.when(F.col("_labels.quality") == 1, "good").otherwise("poor"), F.when(F.col("_labels.toxic") == 1, "_toxic").otherwise(""))
    plain = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \t\n\r\f]+", " "))
    rows = documents.filter("text IS NOT NULL").join(named, "doc_id").select(
        F.md5(plain.cast("binary")).alias("text_md5"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("n/a")).alias("source"),
        F.coalesce("lang", F.lit("n/a")).alias("lang"), label.alias("label"), F.length("text").cast("long").alias("n_chars"),
    )
    first = F.min(F.struct("doc_id", "source", "lang", "label", "n_chars")).alias("u")
    return rows.groupBy("text_md5").agg(first, F.count("*").alias("n_copies")).select("text_md5", "u.*", "n_copies")


def select(rows: DataFrame, config: dict) -> DataFrame:
    """The units of labels with enough groups, capped, with folds."""
    rows = with_enough_groups(rows, "label", "source", config["min_groups"])
    draw = F.md5(F.col("doc_id").cast("string").cast("binary"))
    kept = cap_per_group(rows.withColumn("_cell", F.struct("label", "source")), "_cell", [draw, F.col("doc_id"), F.col("text_md5")], config["cap"]).drop("_cell")
    return kept.join(F.broadcast(group_folds(kept, "label", "source", config["folds"])), "source")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: str | None = None) -> DataFrame:
    """Writes selection and report below out; the selection, read back."""
    c = settings(spark, config, DEFAULTS)
    docs, named = spark.read.parquet(documents), spark.read.parquet(labels)
    LOG.info("read %d documents from %s and %d labels from %s", docs.count(), documents, named.count(), labels)
    chosen = select(units(docs, named), c)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    chosen.select(*names).repartition("fold", "label").write.mode("overwrite").partitionBy("fold", "label").parquet(f"{out}/selection")
    written = spark.read.schema(COLUMNS).parquet(f"{out}/selection")
    report = written.groupBy("fold", "label").agg(F.count("*").alias("n_units"), F.countDistinct("source").alias("n_groups"), F.sum("n_chars").alias("n_chars"), F.sum("n_copies").alias("n_documents"))
    report.coalesce(1).write.mode("overwrite").partitionBy("fold").json(f"{out}/report")
    for r in written.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds")).orderBy("label").collect():  # a row a label
        LOG.info("wrote %d units of %s in %d folds to %s/selection", r.n, r.label, r.folds, out)
    return written


if __name__ == "__main__":
    command(run, ["documents", "labels"], __doc__)
