"""Keeps the decisions of blocks of detections up to date as files of detections arrive.

    python -m jobs.live_blocks --events DIR --out DIR [--config jobs/live_blocks.json]

A file stream with a checkpoint takes the files that no run has taken yet. Each
batch adds mergeable sums of its blocks to ``sums`` (by day and batch) and
writes the days that it touches anew to ``blocks`` (by day) from the sums, so
earlier detections are never read again and late ones still count. A batch that
runs again after a failure overwrites its own sums and the same days, so the
result is the same.

Writes below --out: ``sums``, ``blocks`` and ``checkpoint``.

Defined results: each file holds detections of its own (equal rows in two files
count twice); detections without a time go; a run without new files leaves the output
as it is; an input without files gives no block.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions.scalars import US, day_of
from echolith.operators.predictions import block_sums, blocks_of_sums
from echolith.plans.mapping import CLASSES, detections_of, wide_of
from jobs.common import command, settings

LOG = logging.getLogger("live_blocks")

#: ``width_s``: length of a block. ``min_score``: least score of a decision. ``max_files``: most files of a batch.
DEFAULTS = {"width_s": 21_600, "min_score": 0.05, "max_files": 1000}
SUMS = ", ".join(["grp long, block_us long, voc_type string", *(f"{c}_sum double, {c}_n long" for c in CLASSES), "n long, day string, batch long"])
BLOCKS = ", ".join(["grp long, block_us long", *(f"{c} double" for c in CLASSES), "n_detections long, score double, decision string, day string"])


def run(spark: SparkSession, events: str, out: str, config: str | None = None) -> DataFrame:
    """Takes what is new; all blocks as they stand now."""
    c = settings(spark, config, DEFAULTS)
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    dynamic = {"partitionOverwriteMode": "dynamic"}

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        wide = wide_of(detections_of(batch).filter("t_us IS NOT NULL"))
        sums = block_sums(wide, "grp", c["width_s"] * US, CLASSES).withColumns({"day": day_of(F.col("block_us")), "batch": F.lit(number).cast("long")})
        sums.select(*names(SUMS)).write.mode("overwrite").options(**dynamic).partitionBy("day", "batch").parquet(f"{out}/sums")
        stored = own.read.schema(SUMS).parquet(f"{out}/sums")
        new = {r.day: r.n for r in stored.filter(F.col("batch") == number).groupBy("day").agg(F.sum("n").alias("n")).collect()}  # a row a day
        LOG.info("batch %d: read %d detections of %d days from %s", number, sum(new.values()), len(new), events)
        blocks = blocks_of_sums(stored.filter(F.col("day").isin(list(new))), "grp", CLASSES, c["min_score"]).withColumn("day", day_of(F.col("block_us")))
        blocks.select(*names(BLOCKS)).repartition("day").write.mode("overwrite").options(**dynamic).partitionBy("day").parquet(f"{out}/blocks")
        LOG.info("batch %d: wrote the blocks of %d days to %s/blocks", number, len(new), out)

    schema = spark.read.parquet(events).schema
    # A stream takes a single file only as a pattern; as such the path may be a file or a folder.
    pattern = events.rstrip("/") if re.search(r"[*?\[{]", events) else re.sub(r"(.)/*$", r"[\1]", events)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["max_files"]).parquet(pattern)
    spark.createDataFrame([], BLOCKS).write.mode("ignore").partitionBy("day").parquet(f"{out}/blocks")
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%d batches in %s are taken", len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}), events)
    return spark.read.schema(BLOCKS).parquet(f"{out}/blocks")


if __name__ == "__main__":
    command(run, ["events"], __doc__)
