"""SQLite as a data source: partitions, columns, filters, mixed types; predictions and recordings read through it."""

from __future__ import annotations

import sqlite3

import pytest

from echolith.sources import sqlite as Q
from echolith.sources import tables


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "my data.sqlite3")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "odd ""name" (UID INTEGER, level REAL, note TEXT, raw BLOB, other)')
        c.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?, ?)', [(k, k / 4, f"n{k % 7}", bytes([k % 256]), k) for k in range(1000)])
        c.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?, ?, ?)', [("12", "0.5", 3, "text", None), ("many", None, None, None, b"xy"), (2.5, "x", b"n1", None, 1.5), (None, 1, "n1", b"", "z")])
        c.execute("CREATE TABLE empty (a INTEGER, b TEXT)")
        c.execute("CREATE TABLE Birds_Predictions (UID INTEGER, UTC TEXT, Predicition TEXT)")
        good = '{"predictions": [[0.2, 0.6]]}'
        c.executemany("INSERT INTO Birds_Predictions VALUES (?, ?, ?)", [(1, " 2024-01-01 00:00:00.250 ", good), (2, "2024-01-01 00:00:01", '{"predictions": [[-1, 0.6]]}'), (3, "2024-01-01 00:00:02", None), (4, "2024-01-01 00:00:03", '{"predictions": [[1, 2, 3]]}')])
        c.execute("CREATE TABLE Sound_Acquisition (UTC TEXT, Status TEXT, SystemName TEXT)")
        c.executemany("INSERT INTO Sound_Acquisition VALUES (?, ?, ?)", [
            ("2024-01-01 00:00:00", "Start ", "a.wav"), ("2024-01-01 01:00:00", " Start", "a.wav "), ("2024-01-01 02:00:00", "Continue", "a.wav"), ("2024-01-03 02:00:00", "Stop", "a.wav"),
            ("2024-01-01 00:00:00", "Stop", "b.wav"), ("2024-01-01 00:00:00", "Start", "c.wav"), ("2024-01-01 00:00:00", "Start", "None"), ("2024-01-01 01:00:00", "Stop", "None"),
        ])
    return path


def test_rows_in_ranges(spark, db):
    df = Q.read(spark, db, 'odd "name', parts=5)
    assert df.dtypes == [("UID", "bigint"), ("level", "double"), ("note", "string"), ("raw", "binary"), ("other", "string")]
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 5 and len(rows) == 1004
    by = {r.UID: r for r in rows[:1000]}
    assert by[7].level == 1.75 and by[7].note == "n0" and bytes(by[7].raw) == b"\x07" and by[7].other == "7"
    odd = sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows[1000:]), key=str)
    want = [(12, 0.5, "3", b"text", None), (None, None, None, None, "xy"), (None, None, "n1", None, "1.5"), (None, 1.0, "n1", b"", "z")]
    assert odd == sorted(want, key=str)
    assert Q.read(spark, db, "empty").collect() == []
    assert [r.asDict() for r in Q.read(spark, db, "Birds_Predictions", "UID long").orderBy("UID").collect()] == [{"UID": k} for k in range(1, 5)]
    with pytest.raises(Exception, match="no table nothing"):
        Q.read(spark, db, "nothing")


@pytest.mark.parametrize("condition, n", [("UID >= 990", 10), ("UID > 5 AND note = 'n1'", 142), ("UID IN (1, 2, 3000)", 2), ("note LIKE 'n1%'", 145), ("UID IS NULL", 3), ("UID IS NOT NULL AND level < 1", 5), ("UID = 12", 2), ("NOT note = 'n1'", 858), ("raw = X'07'", 4)])
def test_filters_by_either_side(spark, db, condition, n):
    """Rows are those that Spark finds without pushdown, whatever types the column holds."""
    df = Q.read(spark, db, 'odd "name')
    pushed = df.filter(condition)
    plain = spark.createDataFrame(df.collect(), df.schema).filter(condition).collect()
    key = lambda rows: sorted(map(str, rows))
    assert key(pushed.collect()) == key(plain) and len(plain) == n


def test_filters_reach_sqlite(db):
    """The statement has the schema's columns and the filters only."""
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType

    r = Q.Reader(db, 'odd "name', StructType.fromDDL("UID long, level double"), 3)
    assert len(list(r.pushFilters([GreaterThan(("UID",), 5), EqualTo(("level",), 1.0)]))) == 2
    assert r.query() == """SELECT "UID", "level" FROM "odd ""name" WHERE rowid >= ? AND rowid < ? AND (typeof("UID") NOT IN ('integer', 'null') OR "UID" > ?)"""
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 994 + 3  # 12, and the two that Spark decides


def test_predictions(spark, db):
    rows = Q.predictions(spark, db, "Birds", ["A", "B"], voc_type="whistle").orderBy("class").collect()
    assert [(r.detection_id, r.event_id, r.time, r.classifier, r.voc_type, r["class"]) for r in rows] == [("Birds:1", "", "2024-01-01T00:00:00.250000Z", "Birds", "whistle", c) for c in "AB"]
    assert [r.probability for r in rows] == pytest.approx([0.25, 0.75]) and rows[0].start == 1_704_067_200.25
    with pytest.raises(ValueError, match="no predictions"):
        Q.predictions(spark, db, "Fish", ["A"])
    assert tables.prediction_tables(db) == {"Birds_Predictions": 4}


def test_recordings(spark, db):
    """From the last start to the last row within a day; recordings without a start or of no length go."""
    assert [tuple(r) for r in Q.recordings(spark, db).collect()] == [("a.wav", 1_704_070_800.0, 1_704_074_400.0)]
    assert [r.end for r in Q.recordings(spark, db, 72).collect()] == [1_704_247_200.0]
