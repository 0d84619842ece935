"""SQLite tables as a Spark data source, and the tables of detector databases read through it.

    register(spark)
    spark.read.format("echolith_sqlite").option("path", db).option("table", name).load().filter("UID > 5")

A partition is a range of rowids and runs one SELECT with the columns of the
read's schema and the filters that SQLite can apply; rows come in Arrow batches.
The file must be where every executor can open it. Each value is of its column's type
or null: what SQLite holds of another type is converted where that loses nothing.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)

from . import tables

SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def connect(path: str) -> sqlite3.Connection:
    """Read only."""
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str | None) -> T.DataType:
    """The Spark type of a column by its declaration, as SQLite reads it: a part of the word decides; anything else is text."""
    word = (declared or "").upper()
    if "INT" in word:
        return T.LongType()
    if any(x in word for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in word else T.StringType()


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts
        self.where: list[str] = []
        self.values: list = []

    def _condition(self, f: Filter) -> tuple[str, list] | None:
        """SQL and values of a filter, if SQLite decides it as Spark does."""
        if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in self.schema.fieldNames():
            return None
        column, kind = quoted(f.attribute[0]), self.schema[f.attribute[0]].dataType
        if isinstance(f, (IsNull, IsNotNull)):
            # A value of another type may become null in Spark only, so IS NULL is Spark's to decide.
            return (f"{column} IS NOT NULL", []) if isinstance(f, IsNotNull) else None
        # Only where all values of the column have the filter's type do both compare alike.
        typed = {T.LongType: "integer", T.StringType: "text"}.get(type(kind))
        if typed is None:
            return None
        other = f"typeof({column}) NOT IN ('{typed}', 'null') OR "
        if type(f) in SIGNS:
            return f"{other}{column} {SIGNS[type(f)]} ?", [f.value]
        if isinstance(f, In):
            return f"{other}{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, StringStartsWith):
            return f"{other}substr({column}, 1, {len(f.value)}) = ?", [f.value]
        return None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what SQLite can narrow; Spark checks every filter again, since a column may hold values of other types."""
        for f in filters:
            known = self._condition(f)
            if known is not None:
                self.where.append(f"({known[0]})")
                self.values += known[1]
            yield f

    def partitions(self) -> list[Rows]:
        with connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def query(self) -> str:
        names = ", ".join(quoted(n) for n in self.schema.fieldNames()) or "NULL"
        return f"SELECT {names} FROM {quoted(self.table)} WHERE {' AND '.join(['rowid >= ? AND rowid < ?', *self.where])}"

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kinds = [f.dataType for f in self.schema.fields]
        arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}
        with connect(self.path) as c:
            found = c.execute(self.query(), [partition.low, partition.high, *self.values])
            while rows := found.fetchmany(10_000):
                columns = [pa.array([value(v, type(k)) for v in x], arrow.get(type(k), pa.string())) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, self.schema.fieldNames())


def value(v, kind: type):
    """A value of SQLite as one of a Spark type: whole numbers and texts of numbers are converted, what isn't of the type is null."""
    if v is None:
        return None
    try:
        if kind is T.LongType:
            return int(v) if not isinstance(v, (float, bytes)) or (isinstance(v, float) and v.is_integer()) else None
        if kind is T.DoubleType:
            return float(v) if not isinstance(v, bytes) else None
    except ValueError:
        return None
    if kind is T.BinaryType:
        return v if isinstance(v, bytes) else str(v).encode()
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SqliteSource(DataSource):
    """Options: path, table, parts (most partitions, 8)."""

    @classmethod
    def name(cls) -> str:
        return "echolith_sqlite"

    def schema(self) -> T.StructType:
        with connect(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return T.StructType([T.StructField(r[1], kind_of(r[2])) for r in columns])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], schema, int(self.options.get("parts", 8)))


def register(spark: SparkSession) -> None:
    """Makes the source known and lets it take filters."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, schema: str | None = None, parts: int = 8) -> DataFrame:
    """The table, or of it the columns of the schema only."""
    register(spark)
    source = spark.read.format(SqliteSource.name()).option("path", path).option("table", table).option("parts", parts)
    return (source.schema(schema) if schema else source).load()


def predictions(spark: SparkSession, path: str, table: str, classes: list[str], classifier: str | None = None, voc_type: str = "other") -> DataFrame:
    """The long table of a model's predictions: detection_id, event_id (empty), time, classifier, voc_type, class, probability, start (s).

    The table's name may lack its ``_Predictions``. Rows with missing or negative predictions, or with others than the classes, go.
    """
    name = table if table.endswith("_Predictions") else f"{table}_Predictions"
    with connect(path) as c:
        columns = [r[1] for r in c.execute(f"PRAGMA table_info({quoted(name)})")]
    column = next((x for x in ("Predicition", "Prediction") if x in columns), None)  # spelt either way
    if column is None:
        raise ValueError(f"no predictions in {name} of {path}")
    said = classifier or name.removesuffix("_Predictions")
    rows = read(spark, path, name, f"UID long, UTC string, {column} string").withColumn("_id", F.concat(F.lit(f"{said}:"), F.col("UID").cast("string")))
    rows = rows.withColumn("_start", tables.seconds(F.trim("UTC"))).withColumn("_key", F.struct("_id", "_start"))
    long = tables.json_probabilities(rows, "_key", column, classes)
    us = F.timestamp_micros(F.rint(F.col("_key._start") * 1_000_000).cast("long"))
    return long.select(
        F.col("_key._id").alias("detection_id"), F.lit("").alias("event_id"), F.date_format(F.to_utc_timestamp(us, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.lit(said).alias("classifier"),
        F.lit(voc_type).alias("voc_type"), "class", "probability", F.col("_key._start").alias("start"),
    )


def recording_events(rows: DataFrame, name: str, t: str, is_start: str, most: float) -> DataFrame:
    """(name, start, end) of each recording: from its last start to its last row within ``most`` after that; none without a start or of no length."""
    starts = rows.filter(is_start).groupBy(name).agg(F.max(t).alias("start"))
    last = rows.join(starts, name).filter((F.col(t) >= F.col("start")) & (F.col(t) <= F.col("start") + most))
    return last.groupBy(name, "start").agg(F.max(t).alias("end")).filter("end > start")


def recordings(spark: SparkSession, path: str, max_hours: float = 24) -> DataFrame:
    """(event_id, start, end in seconds) of the recordings in ``Sound_Acquisition``, as for annotations."""
    x = read(spark, path, "Sound_Acquisition", "UTC string, Status string, SystemName string")
    x = x.select(F.trim("SystemName").alias("event_id"), F.trim("Status").alias("status"), tables.seconds(F.trim("UTC")).alias("t")).filter("event_id <> 'None'")
    return recording_events(x, "event_id", "t", "status = 'Start'", max_hours * 3600)
