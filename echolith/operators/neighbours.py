"""Graphs of nearest neighbours of any number of units, and the map that keeps neighbours together.

The graph is found by neighbour descent: sorted along a few random directions,
units are compared with those beside them; after that, each round compares the
neighbours of every unit with each other, since a neighbour's neighbour is
likely a neighbour. No step compares all pairs, and what a task holds of a unit
is bounded by the number of neighbours.

The map starts from a layout of at most LANDMARKS units, places every other one
by its nearest landmarks, and moves all of them along sampled gradients: edges
draw their ends together, units drawn at random push away.

Equal vectors are one node (the least key), so a vector that a third of all
units share is one row; units get the place of their node. Units without a
vector, or with a missing number in it, have no neighbours and no place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.sources.durable import cut

#: Units whose layout is made in one task, and whose vectors and places are broadcast.
LANDMARKS = 2000
#: Places that push units away in a step; each unit meets PUSHES of them.
PUSHED, PUSHES = 1000, 15
#: Edges of a partition that stays through all steps of the map.
EDGES = 100_000
#: Curve of the map's distances for a least distance of 0.1 (fixed values).
CURVE_A, CURVE_B = 1.577, 0.8951


@dataclass(frozen=True)
class GraphParams:
    """k: neighbours of a unit; directions: random sort orders of the start; beside: units compared there; rounds: most rounds of descent; settled: share of changed edges that ends it."""

    k: int = 15
    directions: int = 4
    beside: int = 64
    rounds: int = 8
    settled: float = 0.002
    seed: int = 42


@dataclass(frozen=True)
class MapParams:
    """start: steps of the landmarks' layout; steps: gradient steps of all units, if there are others; rate: the first step's size, falling to 0."""

    start: int = 200
    steps: int = 20
    rate: float = 0.25
    seed: int = 42


def nodes(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(node, vector) of each different vector, and (key, node) of each unit with one."""
    x = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("vector"))
    x = x.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v)))
    one = cut(x.groupBy("vector").agg(F.min("_key").alias("node")))
    return one, x.join(one.hint("shuffle_hash"), "vector").select(F.col("_key").alias(key), "node")


def _matrix(column: pa.ListArray | pa.BinaryArray) -> np.ndarray:
    """The vectors of a column, of numbers or packed."""
    if not len(column):
        return np.empty((0, 0))
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(len(column), -1)


def _packed(one: DataFrame, directions: np.ndarray | None = None) -> DataFrame:
    """(node, vector, along): vectors as the bytes of their numbers, which are shuffled and handed over whole; along: their places along the directions."""
    kind = one.schema["node"].dataType
    shared = one.sparkSession.sparkContext.broadcast(directions)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ascontiguousarray(_matrix(b.column(1)))
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 8)
            vector = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            along = x @ shared.value if shared.value is not None else np.empty((len(x), 0))
            to = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(along.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), vector, pa.ListArray.from_arrays(to, pa.array(along.ravel()))], ["node", "vector", "along"])

    return one.select("node", "vector").mapInArrow(pack, f"node {kind.simpleString()}, vector binary, along array<double>")


def _distances(x: np.ndarray) -> np.ndarray:
    """All distances within each of the last two axes' sets of vectors."""
    square = (x * x).sum(-1)
    d = square[..., :, None] + square[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2)
    return np.sqrt(np.maximum(d, 0))


def best(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, d): the k nearest b of each a, the least of equally near ones. A column known stays true where any equal edge has it."""
    known = [F.max("known").alias("known")] if "known" in edges.columns else []
    once = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), *known)
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).filter(F.col("_n") <= k).drop("_n")


def _beside(one: DataFrame, p: GraphParams) -> DataFrame:
    """Edges between nodes that lie beside each other along random directions."""
    width = one.select(F.size("vector")).head()
    if width is None:
        return one.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("d"))
    directions = np.random.default_rng(p.seed).normal(size=(width[0], p.directions))
    kind = one.schema["node"].dataType

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, xs = None, None
        for b in batches:
            ids, x = b.column(0), _matrix(b.column(1))
            if held is not None:
                ids, x = pa.concat_arrays([held, ids]), np.concatenate([xs, x])
            last = 0
            for at in range(0, max(len(x) - p.beside, 1), p.beside):
                some = x[at : at + 2 * p.beside]
                yield from _nearest(ids.slice(at, 2 * p.beside), _distances(some), p.k)
                last = at + p.beside
            # What has not met its successors yet meets them with the next batch.
            held, xs = ids.slice(min(last, len(x))), x[last:]
            if not len(xs):
                held, xs = ids.slice(max(len(x) - p.beside, 0)), x[max(len(x) - p.beside, 0) :]
        if held is not None and len(xs) > 1:
            yield from _nearest(held, _distances(xs), p.k)

    placed = cut(_packed(one, directions))
    found = []
    for t in range(p.directions):
        order = placed.withColumn("_o", F.get("along", F.lit(t))).repartitionByRange("_o").sortWithinPartitions("_o", "node")
        found.append(order.select("node", "vector").mapInArrow(compare, f"a {kind.simpleString()}, b {kind.simpleString()}, d double"))
    return reduce(DataFrame.unionByName, found)


def _nearest(ids: pa.Array, d: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    k = min(k, len(d) - 1)
    if k < 1:
        return
    to = np.argpartition(d, k - 1, axis=1)[:, :k]
    of = np.repeat(np.arange(len(d)), k)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), ids.take(pa.array(to.ravel())), pa.array(d[of, to.ravel()])], ["a", "b", "d"])


def _descend(one: DataFrame, edges: DataFrame, p: GraphParams, turn: int) -> DataFrame:
    """Edges between the neighbours of a node that are nearer than the farthest neighbour of one end."""
    draw = F.xxhash64("a", "b", F.lit(p.seed + turn))
    back = edges.withColumn("_n", F.row_number().over(Window.partitionBy("b").orderBy(draw))).filter(F.col("_n") <= p.k)
    members = edges.select(F.col("a").alias("centre"), F.col("b").alias("node")).union(back.select(F.col("b"), F.col("a"))).distinct()
    reach = edges.groupBy(F.col("a").alias("node")).agg(F.max("d").alias("reach"), F.count("*").alias("n"))
    known = one.join(reach, "node").withColumn("reach", F.when(F.col("n") < p.k, float("inf")).otherwise(F.col("reach"))).drop("n")
    rows = members.join(known, "node").select("centre", "node", "vector", "reach").repartition("centre").sortWithinPartitions("centre")
    kind = one.schema["node"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            centre = t["centre"].combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(np.asarray(pa.compute.not_equal(centre[1:], centre[:-1]))) + 1]) if len(centre) > 1 else np.zeros(1, int)
            yield from _groups(t.slice(0, int(starts[-1])), starts)
            held = t.slice(int(starts[-1]))
        if held is not None:
            yield from _groups(held, np.array([0, len(held)]))

    return rows.mapInArrow(compare, f"a {kind}, b {kind}, d double")


def _groups(t: pa.Table, starts: np.ndarray, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    """Edges within the groups of rows [starts[k], starts[k + 1])."""
    if not len(t):
        return
    ids, x, reach = t["node"].combine_chunks(), _matrix(t["vector"].combine_chunks()), t["reach"].to_numpy()
    size = np.diff(starts)
    for low in range(0, len(size), at_once):
        n = size[low : low + at_once]
        grid = np.arange(n.max())[None, :]
        there = grid < n[:, None]
        at = np.where(there, starts[low : low + len(n), None] + grid, 0)
        d = _distances(x[at])
        pair = there[:, :, None] & there[:, None, :] & (at[:, :, None] != at[:, None, :]) & (d < reach[at][:, :, None])
        g, i, j = np.nonzero(pair)
        if len(g):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[g, i])), ids.take(pa.array(at[g, j])), pa.array(d[g, i, j])], ["a", "b", "d"])


def graph(one: DataFrame, p: GraphParams | None = None) -> DataFrame:
    """(a, b, d): about the k nearest nodes b of each node a, by neighbour descent. Nodes are as from nodes()."""
    p = p or GraphParams()
    edges = cut(best(_beside(one, p).filter("a <> b"), p.k))
    n = edges.count()
    packed = cut(_packed(one).select("node", "vector")) if n else one
    for turn in range(p.rounds if n else 0):
        more = _descend(packed, edges, p, turn)
        new = cut(best(edges.withColumn("known", F.lit(True)).unionByName(more.withColumn("known", F.lit(False))), p.k))
        changed = new.filter("not known").count()
        edges = new.drop("known")
        if changed <= p.settled * n:
            break
    return edges


def _sharpness(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, scale) of each row of distances (NaN where none): exp(-(d - nearest) / scale) sums to log2 of their number."""
    near = np.nanmin(d, axis=1)
    want = np.log2(np.maximum((~np.isnan(d)).sum(1), 2))
    low, high = np.full(len(d), 1e-9), np.full(len(d), np.nanmax(d) * 100 + 1)
    for _ in range(60):
        mid = np.sqrt(low * high)
        over = np.nansum(np.exp(-(d - near[:, None]) / mid[:, None]), axis=1) > want
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return near, np.sqrt(low * high)


def fuzzy(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: how surely two nodes are neighbours, by either's distances: w1 + w2 - w1 w2."""

    @F.pandas_udf("array<double>")
    def weights(d: pd.Series) -> pd.Series:
        if not len(d):
            return pd.Series([], dtype=object)
        wide = max(map(len, d))
        x = np.array([[*v, *[np.nan] * (wide - len(v))] for v in d])
        near, scale = _sharpness(x)
        w = np.exp(-(x - near[:, None]) / scale[:, None])
        return pd.Series([row[: len(v)] for row, v in zip(w, d, strict=True)])

    own = edges.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("e"))  # k at most
    rows = own.select("a", F.explode(F.arrays_zip(F.col("e.b").alias("b"), weights(F.col("e.d")).alias("w"))).alias("x"))
    both = rows.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"), "x.w")
    return both.groupBy("a", "b").agg((F.sum("w") - F.when(F.count("*") == 2, F.product("w")).otherwise(0.0)).alias("w"))


def _layout(x: np.ndarray, k: int, p: MapParams) -> np.ndarray:
    """Places of a bounded number of vectors: their own graph, laid out from the first two components."""
    n = len(x)
    if n < 3:
        return np.stack([np.arange(n, dtype=float), np.zeros(n)], 1)
    d = _distances(x)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    to = np.argsort(d, axis=1, kind="stable")[:, :k]
    near, scale = _sharpness(np.take_along_axis(d, to, 1))
    w = np.zeros((n, n), np.float32)
    np.put_along_axis(w, to, np.exp(-(np.take_along_axis(d, to, 1) - near[:, None]) / scale[:, None]).astype(np.float32), 1)
    w = w + w.T - w * w.T
    a, b = np.nonzero(w)
    w = w[a, b] / w.max()
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    y = centred @ axes[:2].T
    y = np.pad(y, ((0, 0), (0, 2 - y.shape[1]))) * 10 / max(np.abs(y).max(), 1e-12)
    r = np.random.default_rng(p.seed)
    y += r.normal(0, 1e-3, y.shape)
    for step in range(p.start):
        on = r.random(len(w)) < w
        i, j = a[on], b[on]
        move = np.zeros_like(y)
        diff = y[i] - y[j]
        d2 = (diff**2).sum(1)
        pull = -2 * CURVE_A * CURVE_B * np.maximum(d2, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * d2**CURVE_B)
        part = np.clip(pull[:, None] * diff, -4, 4)
        for c in range(2):
            move[:, c] += np.bincount(i, part[:, c], n) - np.bincount(j, part[:, c], n)
        i = np.repeat(i, 5)
        diff = y[i] - y[r.integers(0, n, len(i))]
        d2 = (diff**2).sum(1)
        part = np.clip((2 * CURVE_B / ((0.001 + d2) * (1 + CURVE_A * d2**CURVE_B)))[:, None] * diff, -4, 4)
        for c in range(2):
            move[:, c] += np.bincount(i, part[:, c], n)
        y += (1 - step / p.start) * np.clip(move, -4, 4)
    return y


def places(one: DataFrame, edges: DataFrame, k: int = 15, p: MapParams | None = None) -> DataFrame:
    """(node, x, y): the map of all nodes."""
    p = p or MapParams()
    sc = one.sparkSession.sparkContext
    kind = one.schema["node"].dataType.simpleString()
    marks = one.orderBy(F.xxhash64("node", F.lit(p.seed)), "node").limit(LANDMARKS)

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            d = pd.concat(got).sort_values("node").reset_index(drop=True)
            y = _layout(np.stack(d["vector"]), k, p)
            yield pd.DataFrame({"vector": d["vector"], "x": y[:, 0], "y": y[:, 1]})

    rows = marks.repartition(1).mapInPandas(lay, "vector array<double>, x double, y double").collect()  # LANDMARKS at most
    shared = sc.broadcast((np.array([r["vector"] for r in rows]), np.array([[r["x"], r["y"]] for r in rows])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = shared.value
        square = (at * at).sum(1)
        near = min(k, len(at))
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                x = _matrix(b.column(1))
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + square - 2 * x @ at.T, 0))
                to = np.argpartition(d, near - 1, axis=1)[:, :near]
                d = np.take_along_axis(d, to, 1)
                least = d.min(1, keepdims=True)
                w = np.exp(-(d - least) / np.maximum((d - least).mean(1, keepdims=True), 1e-9) * 3)
                w = np.where(least < 1e-9, (d < 1e-9).astype(float), w)
                spot = (w[:, :, None] * y[to]).sum(1) / w.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spot[:, 0]), pa.array(spot[:, 1])], ["node", "x", "y"])

    y = cut(one.select("node", "vector").mapInArrow(place, f"node {kind}, x double, y double"))
    if len(rows) < LANDMARKS or not p.steps:  # all are landmarks
        return y
    w = fuzzy(edges)
    both = cut(w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    # Kept by b, so that no step shuffles the edges for their first join.
    both = both.repartition(max(sc.defaultParallelism, both.count() // EDGES + 1), "b").persist()
    try:
        for step in range(p.steps):
            y = cut(_move(y, both, p.rate * (1 - step / p.steps), p.seed + step))
    finally:
        both.unpersist()
    return y


def _move(y: DataFrame, both: DataFrame, rate: float, seed: int) -> DataFrame:
    """One step of all nodes: drawn by their neighbours, pushed by PUSHES of PUSHED places drawn at random."""
    other = y.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    own = y.select(F.col("node").alias("a"), "x", "y")
    clip = lambda c: F.greatest(F.least(c, F.lit(4.0)), F.lit(-4.0))

    def curve(d2: Column) -> Column:
        return 1 + CURVE_A * F.pow(d2, CURVE_B)

    met = both.join(other.hint("shuffle_hash"), "b").join(own.hint("shuffle_hash"), "a")  # a task holds the places of its nodes
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    d2 = F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    pull = F.col("w") * -2 * CURVE_A * CURVE_B * F.pow(d2, CURVE_B - 1) / curve(d2)
    drawn = met.groupBy("a").agg(F.sum(clip(pull * dx)).alias("px"), F.sum(clip(pull * dy)).alias("py"), F.sum("w").alias("pw"))
    pushed = _pushed(y, seed)
    z = pushed.join(drawn.withColumnRenamed("a", "node"), "node", "left")
    go = lambda c: clip(F.coalesce(f"p{c}", F.lit(0.0)) + F.coalesce("pw", F.lit(0.0)) * F.col(f"q{c}"))
    return z.select("node", (F.col("x") + rate * go("x")).alias("x"), (F.col("y") + rate * go("y")).alias("y"))


def _pushed(y: DataFrame, seed: int) -> DataFrame:
    """(node, x, y, qx, qy): all nodes, and the sum of their PUSHES pushes, as if of 5."""
    some = y.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(PUSHED).select("x", "y").collect()  # PUSHED at most
    shared = y.sparkSession.sparkContext.broadcast(np.array(some, float).reshape(-1, 2))
    drawn = F.array(*(F.pmod(F.xxhash64("node", F.lit(seed), F.lit(k)), F.lit(max(len(some), 1))).cast("int") for k in range(PUSHES)))
    kind = y.schema["node"].dataType.simpleString()

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                b = whole.slice(low, 2000)
                own = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
                e = own[:, None] - shared.value[_matrix(b.column(3))]
                e2 = (e * e).sum(-1)
                force = 2 * CURVE_B / ((0.001 + e2) * (1 + CURVE_A * e2**CURVE_B))
                q = np.clip(force[:, :, None] * e, -4, 4).sum(1) * (5 / PUSHES)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(q[:, 0]), pa.array(q[:, 1])], ["node", "x", "y", "qx", "qy"])

    return y.select("node", "x", "y", drawn.alias("drawn")).mapInArrow(push, f"node {kind}, x double, y double, qx double, qy double")


def neighbours(df: DataFrame, key: str, vector: str, p: GraphParams | None = None) -> DataFrame:
    """(node, neighbour, rank, distance): about the k nearest different vectors of each different vector, as their least keys."""
    one, _ = nodes(df, key, vector)
    found = graph(one, p)
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), rank.alias("rank"), F.col("d").alias("distance"))


def neighbour_map(df: DataFrame, key: str, vector: str, g: GraphParams | None = None, p: MapParams | None = None) -> DataFrame:
    """(key, x, y) of each unit with a vector; units of equal vectors share a place."""
    g = g or GraphParams()
    one, members = nodes(df, key, vector)
    return members.join(places(one, graph(one, g), g.k, p), "node").select(key, "x", "y")
