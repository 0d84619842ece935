"""Binary detector files, read in parallel by a decoder that the caller brings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import file_spans, file_time

#: Seconds that the last file of a folder is taken to run.
LAST_S = 24 * 3600


def list_files(spark: SparkSession, path: str, pattern: str = "*.pgdf") -> DataFrame:
    """(path, folder, start, end, length): files with a time in the name run until the next of their folder; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), file_time(F.element_at(F.split("path", "/"), -1)).alias("start"), "length")
    return file_spans(named.filter("start IS NOT NULL"), ["folder"], "start", "end", LAST_S).unionByName(named.filter("start IS NULL").withColumn("end", F.lit(None).cast("double")))


def in_periods(files: DataFrame, periods: DataFrame, start: str = "start", end: str = "end", day_s: int = 86_400) -> DataFrame:
    """Files that overlap a period, once each, by an equi-join on days; files without a time are kept."""
    days = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / day_s), F.floor(F.col(b) / day_s)))
    f = files.filter("start IS NOT NULL").withColumn("_day", days("start", "end"))
    p = periods.select(F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e")).withColumn("_day", days("_s", "_e"))
    hit = f.join(p, "_day").filter("start < _e AND end > _s").select("path").distinct()
    return files.join(hit, "path", "left_semi").unionByName(files.filter("start IS NULL"))


def read(spark: SparkSession, path: str, decode: Callable[[bytes, str], Iterator[dict[str, Any]]], schema: str, pattern: str = "*.pgdf", periods: DataFrame | None = None, batch: int = 5000) -> DataFrame:
    """Rows of ``decode(content, name)`` of every file, or of those that overlap ``periods``, with the file's name.

    A file is one row of Spark's binary source and is decoded in the task that
    reads it, so files should be far smaller than an executor's memory; rows
    are handed on in batches. A file that the decoder refuses gives a row with
    null values and the reason in ``error``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    if periods is not None:
        files = files.join(in_periods(list_files(spark, path, pattern), periods).select("path"), "path", "left_semi")
    fields = spark.createDataFrame([], schema).columns

    def frame(name: str, rows: list[dict], error: str | None = None) -> pd.DataFrame:
        out = pd.DataFrame({c: [r.get(c) for r in rows] for c in fields}, dtype=object)
        return out.assign(file=name, error=error)

    def run(batches):
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                name, rows = os.path.basename(where), []
                try:
                    for row in decode(content, name):
                        rows.append(row)
                        if len(rows) == batch:
                            yield frame(name, rows)
                            rows = []
                except ValueError as e:
                    if rows:
                        yield frame(name, rows)
                    yield frame(name, [{}], str(e))
                    continue
                if rows:
                    yield frame(name, rows)

    return files.mapInPandas(run, f"{schema}, file string, error string")
