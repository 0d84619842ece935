"""The jobs: equal to plain Python and DuckDB, twice the same, and over growing input only what is new."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from echolith.operators import predictions
from jobs import live_blocks, queries, training_selection

DIR = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@data
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    got = queries.QUERIES[name](spark, DIR)
    assert before == {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    assert not spark.streams.active
    c = duckdb.connect()
    for t in ("documents", "labels", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    cur = c.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = cur.fetchall()
    assert want and sorted(want) == sorted(tuple(r[x] for x in columns) for r in got.collect())


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def _copy(spark, low, high):
    return spark.read.parquet(f"{DIR}/events.parquet").filter(f"event_id % 1000 >= {low} AND event_id % 1000 < {high}")


@data
def test_blocks_over_growing_input(spark, tmp_path, caplog):
    """Two runs over files that arrive in between give what one run over all gives; the second reads the new ones only, a third nothing."""
    caplog.set_level("INFO")
    new, out = f"{tmp_path}/in", f"{tmp_path}/out"
    key = lambda df: sorted(map(tuple, df.collect()))
    _copy(spark, 0, 600).coalesce(1).write.mode("append").parquet(new)
    first = key(live_blocks.run(spark, new, out))
    _copy(spark, 600, 1000).coalesce(1).write.mode("append").parquet(new)
    caplog.clear()
    second = key(live_blocks.run(spark, new, out))
    read = [int(m.split("read ")[1].split()[0]) for r in caplog.records if "read " in (m := r.getMessage())]
    assert sum(read) == _copy(spark, 600, 1000).count()
    whole = key(live_blocks.run(spark, f"{DIR}/events.parquet", f"{tmp_path}/whole"))
    assert first != second == whole
    caplog.clear()
    assert key(live_blocks.run(spark, new, out)) == whole
    assert not [r for r in caplog.records if "wrote" in r.getMessage()]


@data
def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """A checkpoint that lost its last commit replays the batch; sums and blocks are overwritten alike."""
    new, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _copy(spark, 0, 500).coalesce(1).write.parquet(new)
    first = sorted(map(tuple, live_blocks.run(spark, new, out).collect()))
    for name in ("0", ".0.crc"):
        os.remove(f"{out}/checkpoint/commits/{name}")
    assert sorted(map(tuple, live_blocks.run(spark, new, out).collect())) == first


def test_blocks_of_no_files_and_hard_rows(spark, tmp_path):
    new, out = f"{tmp_path}/in", f"{tmp_path}/out"
    _events(spark, []).write.parquet(new)
    assert live_blocks.run(spark, new, out).collect() == []
    rows = [(1, None, 1, "click", None, None), (2, None, None, None, None, None)]
    _events(spark, rows).withColumn("extra", F.lit(1)).coalesce(1).write.mode("append").parquet(new)
    assert live_blocks.run(spark, new, out).collect() == []


def test_sums_of_parts(spark):
    """Sums of any parts give the blocks of the whole; null and NaN probabilities don't count, an empty block has no data."""
    classes = ["A", "B"]
    rows = [(1, k * 7, "click" if k % 3 else "whistle", (k % 10) / 10, 1 - (k % 10) / 10) for k in range(50)]
    rows += [(2, 5, "click", None, None), (2, 6, "click", float("nan"), 0.5), (3, 5, "click", None, None), (4, 1, None, 0.0, 0.0), (None, 9, "click", 0.75, 0.25)]
    df = spark.createDataFrame(rows, "g long, t_us long, voc_type string, A double, B double")
    parts = [predictions.block_sums(df.filter(f"pmod(t_us, 3) = {k}"), "g", 100, classes) for k in range(3)]
    got = predictions.blocks_of_sums(parts[0].unionByName(parts[1]).unionByName(parts[2]), "g", classes, 0.05)
    whole = predictions.blocks_of_sums(predictions.block_sums(df, "g", 100, classes), "g", classes, 0.05)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    by = defaultdict(list)
    for g, t, v, a, b in rows[:50]:
        by[g, t // 100 * 100, v].append((a, b))
    blocks = defaultdict(list)
    for (g, t, _), x in by.items():
        a, b = (sum(y[k] for y in x) / len(x) for k in (0, 1))
        blocks[g, t].append((a / (a + b), b / (a + b)))
    for r in whole.filter("g = 1").collect():
        want = [sum(x[k] for x in blocks[1, r.block_us]) / len(blocks[1, r.block_us]) for k in (0, 1)]
        assert [r.A, r.B] == pytest.approx(want, abs=1e-6)
    found = {(r.g, r.block_us): r for r in whole.filter("g > 1").collect()}
    assert found[3, 0].decision == found[4, 0].decision == "no_data" and found[3, 0].n_detections == 1 and found[2, 0].decision == "B"


def _plain_selection(docs, labels, min_groups, cap, folds):
    """The selection in plain Python."""
    named = {}
    for i, q, t in labels:
        if i is not None and q in (0, 1) and t in (0, 1):
            named[i] = min(named.get(i, (9, 9)), (q, t))
    found = defaultdict(list)
    for i, text, lang, source in docs:
        if text is not None and i in named:
            plain = text
            for c in range(65, 91):
                plain = plain.replace(chr(c), chr(c + 32))
            plain = " ".join(x for x in plain.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ") if x)
            label = ("good" if named[i][0] else "poor") + ("_toxic" if named[i][1] else "")
            found[plain].append((i, source or "n/a", lang or "n/a", label, len(text)))
    units = [(*min(v), len(v), hashlib.md5(k.encode()).hexdigest()) for k, v in found.items()]
    groups = defaultdict(set)
    for u in units:
        groups[u[3]].add(u[1])
    cells = defaultdict(list)
    for u in units:
        if len(groups[u[3]]) >= min_groups:
            cells[u[3], u[1]].append(u)
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    kept = [u for c in cells.values() for u in sorted(c, key=lambda u: (md5(u[0]), u[0], u[6]))[:cap]]
    first = {}
    for u in kept:
        first[u[1]] = min(first.get(u[1], "~"), u[3])
    order = sorted(first, key=lambda s: (first[s], md5(s), s))
    fold = {s: k % folds for k, s in enumerate(order)}
    return Counter((u[0], u[6], u[2], u[1], u[4], u[5], fold[u[1]], u[3]) for u in kept)


def test_selection_by_plain_python(spark, tmp_path):
    """Copies, nulls, contradictory and repeated rows, a hot group, rare labels and clashing columns."""
    docs = [(k, f"text number {k % 150} here", "en" if k % 2 else None, "hot" if k % 3 else f"s{k % 7}") for k in range(400)]
    docs += [(401, "  Text  NUMBER\t1 here\n", "de", "s1"), (402, None, "de", "s1"), (403, "", None, None), (404, " ", "x", "s2"), (None, "no id", "en", "s1"), (5, "another text of five", "en", "s3"), docs[7], docs[7]]
    labels = [(k, k % 2, int(k % 11 == 0)) for k in range(405)] + [(5, 0, 0), (5, 0, 0), (None, 1, 1), (8, None, 1), (9, 2, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.lit("x"), "label": F.lit(3), "fold": F.lit("f")}).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")).write.parquet(f"{tmp_path}/l")
    with open(f"{tmp_path}/c.json", "w") as f:
        json.dump({"cap": 6, "folds": 3, "min_groups": 3}, f)
    for _ in range(2):
        got = training_selection.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/o", f"{tmp_path}/c.json")
        assert Counter(map(tuple, got.collect())) == _plain_selection(docs, labels, 3, 6, 3)
    assert all(len({r.fold for r in rows}) == 1 for rows in [got.filter(F.col("source") == s).collect() for s in ("hot", "s1")])
    report = spark.read.json(f"{tmp_path}/o/report")
    assert report.agg(F.sum("n_units")).head()[0] == got.count()


def test_selection_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/l")
    assert training_selection.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/o").collect() == []


def test_settings_are_checked(spark, tmp_path):
    with open(f"{tmp_path}/c.json", "w") as f:
        f.write('{"width": 1}')
    with pytest.raises(ValueError, match="unknown settings: width"):
        live_blocks.run(spark, f"{tmp_path}/none", f"{tmp_path}/o", f"{tmp_path}/c.json")
    for job in (live_blocks, training_selection):
        with open(f"{os.path.dirname(job.__file__)}/{job.__name__.split('.')[-1]}.json") as f:
            assert set(json.load(f)) == set(job.DEFAULTS)


@data
def test_command_line(tmp_path):
    """The command creates and stops its own session, logs what it read and wrote, and leaves the files."""
    run = subprocess.run(
        [sys.executable, "-m", "jobs.training_selection", "--documents", f"{DIR}/documents.parquet", "--labels", f"{DIR}/labels.parquet", "--out", f"{tmp_path}/o", "--config", "jobs/training_selection.json"],
        capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300,
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert "read 200 documents" in run.stderr and "wrote" in run.stderr
    assert any(n.startswith("fold=") for n in os.listdir(f"{tmp_path}/o/selection"))


def test_jobs_are_apart_from_the_training_data_operators():
    where = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in [f"jobs/{n}" for n in os.listdir(f"{where}/jobs") if n.endswith(".py")] + ["tests/test_jobs.py"]:
        with open(f"{where}/{name}") as f:
            used = [line for line in f if line.lstrip().startswith(("import ", "from "))]
        assert not [u for u in used if "llm" in u or "corpus_pipeline" in u]
