"""Queries cover whole tables: no part of the ids, no capped sample."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from echolith.operators import clusters, recluster
from echolith.plans import mapping
from echolith.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@data
@pytest.mark.parametrize("name", ["frames_membership", "sample_rate_consensus"])
def test_every_detection(spark, name):
    got = QUERIES[name](spark, DIR)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DIR}/events.parquet')")
    cur = c.execute(ORACLE_SQL[name])
    columns = [x[0] for x in cur.description]
    assert sorted(map(str, (tuple(r[x] for x in columns) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


def test_rates_of_groups_of_any_number(spark, monkeypatch):
    rows = [(g, 1_704_067_200_000_000 + k * 1_000_000) for g in (100, 1001, 99_999) for k in range(4)]
    monkeypatch.setattr(mapping, "detections", lambda spark, d: spark.createDataFrame(rows, "grp long, t_us long"))
    assert [tuple(r) for r in QUERIES["sample_rate_consensus"](spark, "").collect()] == [(96_000.0, 1)]


@pytest.mark.parametrize("name", ["unit_clusters", "outlying_units", "density_clusters", "hybrid_clusters"])
def test_every_unit(spark, monkeypatch, name):
    """Units beyond the pool get results, and where the pool decides clearly the same as within it."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16)) * 6
    rows = [(k, (centres[k % 4] + rng.normal(size=16) * 0.3).tolist(), k % 4) for k in range(2400)]
    units = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    monkeypatch.setattr(mapping, "read", lambda spark, d, table: units)
    whole = {r.vec_id: r.cluster for r in QUERIES[name](spark, "").collect()}
    assert len(whole) == 2400
    monkeypatch.setattr(clusters, "MAX_UNITS", 600)
    pooled = {r.vec_id: r.cluster for r in QUERIES[name](spark, "").collect()}
    assert len(pooled) == 2400
    pairs = Counter((k % 4, c) for k, c in pooled.items() if c >= 0)
    assert len(pairs) >= 4 and all(len({v for v, c in pairs if c == own}) == 1 for own in {c for _, c in pairs})
    if name != "density_clusters":
        assert sum(pairs.values()) > 2000


def test_every_row_in_reclustered_blocks(spark, monkeypatch):
    """Blocks whose rows lie beyond the pool are predicted too."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 16)) * 6
    rows = [(k, (centres[k % 4] + rng.normal(size=16) * 0.3).tolist(), k // 400) for k in range(2400)]
    units = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    monkeypatch.setattr(mapping, "read", lambda spark, d, table: units)
    want = {(str(k % 5), f"L{k // 400 % 3}"): 2 for k in range(2400)}
    for most in (recluster.MAX_UNITS, 300):
        monkeypatch.setattr(recluster, "MAX_UNITS", most)
        assert {(r.unit, r.truth): r.n for r in QUERIES["leave_out_reclustered"](spark, "").collect()} == want
    loud = [(f"a{k % 2}", str(k % 3), k // 600, v, f"L{k % 4 // 2}") for k, v, _ in rows]
    df = spark.createDataFrame([(d, u, b + 10 * (lab == "L1"), v, lab) for d, u, b, v, lab in loud], "d string, u string, b int, v array<double>, l string")
    out = recluster.leave_out_reclustered(df, "d", "u", "b", "v", "l", recluster.HybridParams(cut=0.8, least=5, trees=10), trees=20).collect()
    assert len(out) == 24 and all(r.truth == r.predicted for r in out)
