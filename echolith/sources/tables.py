"""Readers: annotations, selection tables, contours, clicks, feature tables, SQLite predictions."""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])


def seconds(text: Column) -> Column:
    """Unix seconds (UTC) of a number or an ISO text; null if it is neither."""
    iso = F.try_to_timestamp(F.regexp_replace(text, r"\s*(Z|\+00:?00)$", ""))
    return F.coalesce(text.try_cast("double"), (F.unix_micros(iso) / 1_000_000).cast("double"))


def annotations(spark: SparkSession, path: str, require_label: bool = True) -> DataFrame:
    """Labelled periods from CSV; bad times and ends before starts are errors when rows are read."""
    raw = spark.read.csv(path, header=True)
    df = raw.toDF(*(c.strip() for c in raw.columns))
    need = {"event_id", "start", "end", *(["label"] if require_label else [])}
    if missing := need - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    df = df.withColumns({"start": seconds(F.col("start")), "end": seconds(F.col("end")), "event_id": F.col("event_id").cast("string")})
    fault = F.raise_error(F.concat(F.lit("bad period: "), F.coalesce("event_id", F.lit("null"))))
    return df.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(fault.cast("double")))


def selection_table(spark: SparkSession, paths: str | list[str], label_cols: list[str], begin: str, end: str, delta: str | None = None, sep: str = "\t", offset_s: float = 0.0) -> DataFrame:
    """Annotation tables with times relative to a recording; first label that is given, rows without a duration go."""
    raw = spark.read.csv(paths, header=True, sep=sep)
    start = F.col(begin).try_cast("double") + offset_s
    stop = start + F.col(delta).try_cast("double") if delta else F.col(end).try_cast("double") + offset_s
    label = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in label_cols))
    return raw.select(label.alias("label"), start.alias("start"), stop.alias("end")).filter("label IS NOT NULL AND end > start")


def contours(spark: SparkSession, path: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Contours from JSON with a range of days, both inclusive (end is the start of the last day)."""
    schema = "start double, times array<double>, freqs array<bigint>, slice_s double, snr_db double"
    df = spark.read.schema(schema).json(path, multiLine=True)
    if start is not None:
        df = df.filter(F.col("start") >= start)
    return df if end is None else df.filter(F.col("start") < end + 86_400)


def clicks(spark: SparkSession, path: str) -> DataFrame:
    """Clicks from CSV; start as a number or a time, a missing duration is 0."""
    df = spark.read.csv(path, header=True)
    numbers = {c: F.col(c).try_cast("double") for c in df.columns if c not in ("start", "uid", "file")}
    df = df.withColumns({**numbers, "start": seconds(F.col("start"))}).filter("start IS NOT NULL")
    return df.withColumn("end", F.col("start") + (F.coalesce("duration", F.lit(0.0)) if "duration" in df.columns else F.lit(0.0)))


def rocca(df: DataFrame, voc_type: str, features: list[str]) -> DataFrame:
    """Whistle or click rows of contour statistics, without rows that lack a feature."""
    whistle = (F.col("FREQMAX") != 0) & (F.col("FREQPEAK") == 0)
    click = (F.col("FREQMAX") == 0) & (F.col("FREQPEAK") != 0)
    return df.filter(whistle if voc_type == "whistle" else click).dropna(subset=features)


def numeric_features(df: DataFrame, exclude: list[str]) -> list[str]:
    """Columns that can be features: numbers that are neither excluded nor boolean."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def file_spans(files: DataFrame, keys: list[str], start: str, end: str, last: int) -> DataFrame:
    """files with an end: the start of the next one, or ``last`` after its own."""
    follow = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return files.withColumn(end, F.coalesce(follow, F.col(start) + last))


def file_time(name: Column) -> Column:
    """UTC seconds of the _YYYYMMDD_HHMMSS at the end of a file's name, else null."""
    part = F.regexp_extract(name, r"_(\d{8}_\d{6})\.[^.]+$", 1)
    return F.unix_micros(F.try_to_timestamp(part, F.lit("yyyyMMdd_HHmmss"))) / 1_000_000


def json_probabilities(df: DataFrame, id_col: str, json_col: str, classes: list[str]) -> DataFrame:
    """Long probabilities from JSON {"predictions": [[...]]}: rows with the right number of non-negative values, made to sum to 1."""
    p = F.get(F.from_json(json_col, "predictions array<array<double>>")["predictions"], F.lit(0))
    rows = df.select(id_col, p.alias("p")).filter((F.size("p") == len(classes)) & F.forall("p", lambda x: F.coalesce(x >= 0, F.lit(False))))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    long = rows.select(id_col, total.alias("t"), F.posexplode("p").alias("k", "v"))
    return long.select(id_col, F.get(F.array(*map(F.lit, classes)), F.col("k")).alias("class"), F.try_divide("v", "t").alias("probability"))


def prediction_tables(database: str) -> dict[str, int]:
    """The tables named *_Predictions of a SQLite file with their numbers of rows."""
    with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name LIKE '%\\_Predictions' ESCAPE '\\' ORDER BY name")]
        return {n: c.execute(f'SELECT count(*) FROM "{n}"').fetchone()[0] for n in names}


def sqlite_table(spark: SparkSession, database: str, table: str, columns: dict[str, str], parts: int = 8) -> DataFrame:
    """A table of a SQLite file that executors can reach, read in ranges of rowid."""
    with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as c:
        low, high = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
    names = ", ".join(f'"{c}"' for c in columns)

    def read(batches):
        import pandas as pd

        for b in batches:
            for a, z in zip(b["a"], b["z"], strict=True):
                with sqlite3.connect(f"file:{database}?mode=ro", uri=True) as c:
                    yield pd.read_sql_query(f'SELECT {names} FROM "{table}" WHERE rowid >= {a} AND rowid < {z}', c)

    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.createDataFrame([(a, a + step) for a in range(low, high + 1, step)] or [(0, 0)], "a long, z long").repartition(parts)
    return ranges.mapInPandas(read, ", ".join(f"`{k}` {v}" for k, v in columns.items()))
