"""N-gram Jaccard join by chosen paths.

Sets are the five-word shingles of lower-case texts. Copies of a text are made
one first. Each set follows every chosen path of two sampled tokens (minhash
coordinates that the path so far selects), TREES of them from the root, which
gives pairs of the wanted similarity the target recall. Sets that meet on a
path are compared by sketches when the bucket is small; a larger bucket is
split on further tokens, and where sampled tokens no longer split it (near
copies) it is compared block by block in many tasks. A bucket yields a
spanning forest of its similar sets, never its pairs; rows of a path, of a
class or of a text that very many share are dealt over several tasks. Within the connected
sets of all buckets every pair is then verified exactly on the full shingle
sets, block by block, and counted; no bucket, partner or candidate is capped.

Defined results: a text of fewer than five words has one shingle of all its
words; null, empty and blank texts have none and link to nothing; documents
with equal texts (nulls too) are copies and share a class; ties for a class's
id go to the least id; columns besides id and text are not read, except that
``one_of_each`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, durable, heavy_keys, table
from .fitting import Memo

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
T = 128  # minhash coordinates
MEAN = 1 / THRESHOLD  # tokens that a path selects
#: Of a pair at the threshold, the chance to share a token and then a selected one.
_SHARE = THRESHOLD * (1 - math.exp(-MEAN * THRESHOLD))
LIMIT = 256  # sets of a bucket that one task compares
SPLITS = 5  # further tokens on which every large bucket is split
ROUNDS = 4  # splits of a bucket, one after the other
#: Matches of 4-bit minhashes: 4.3 deviations below what the threshold gives, and the chance of a pair at the threshold to have fewer.
_MATCH = THRESHOLD + (1 - THRESHOLD) / 16
LEAST = int(T * _MATCH - 4.3 * math.sqrt(T * _MATCH * (1 - _MATCH)))
_UNLIKE = sum(math.comb(T, k) * _MATCH**k * (1 - _MATCH) ** (T - k) for k in range(LEAST))
#: Of such a pair, the chance that a tree finds it after all splits, each of which it survives if it agrees on one of the tokens; the runs
#: are repeated, TREES of them, until the recall is reached where every split happens.
_FOUND = _SHARE * (1 - (1 - _MATCH) ** SPLITS) ** ROUNDS
TREES = math.ceil(math.log(1 - RECALL - _UNLIKE) / math.log(1 - _FOUND))
BLOCK = 256  # sets of a block; a task verifies two blocks
SKETCH_BLOCK = 1024  # sketches of a block; a task compares two blocks

_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 1 << 32, T, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, T, dtype=np.uint64).astype(np.uint32)
_SEED = _RNG.integers(0, 1 << 63, T, dtype=np.int64).astype(np.uint64)
_ROOT = _RNG.permutation(T)[:TREES]
_ZERO = np.array([((b & 15) == 0) + ((b >> 4) == 0) for b in range(256)], np.uint8)
_WORD = Memo(xxhash.xxh3_64_intdigest, 300_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The hashed word shingles of a text, repetitions included."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_WORD[w] for w in words], np.uint64)
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + _mix(h[j : len(h) - k + 1 + j])
    return _mix(out)


def signature(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, ((x[None, at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).min(1))
    return out


def _paths(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all chosen paths of two tokens."""
    one = _mix(sig[:, _ROOT].astype(np.uint64) * np.uint64(0x100000001B3) + _SEED[_ROOT])
    most = np.uint64(int(MEAN / T * (1 << 64)))
    rows, paths = [], []
    for j in range(T):
        r, c = np.nonzero(_mix(one ^ _SEED[j]) < most)
        rows.append(r)
        paths.append(_mix(one[r, c] * np.uint64(0x9E3779B97F4A7C15) + _SEED[j] + sig[r, j]))
    return np.concatenate(rows), np.concatenate(paths)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4000):
            b = whole.slice(at, 4000)
            sets = [shingles(x.as_py()) for x in b.column(2)]
            some = np.flatnonzero([len(s) > 0 for s in sets])
            sig = np.stack([signature(sets[k]) for k in some]) if len(some) else np.zeros((0, T), np.uint32)
            row, path = _paths(sig)
            order = np.argsort(row, kind="stable")
            size = np.zeros(b.num_rows, np.int64)
            np.add.at(size, some[row], 1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            nibble = ((sig >> np.uint32(9)) & np.uint32(15)).astype(np.uint8)
            packed = nibble[:, ::2] << 4 | nibble[:, 1::2]
            sketch: list = [None] * b.num_rows
            for k, x in zip(some, packed, strict=True):
                sketch[k] = x.tobytes()
            lists = pa.ListArray.from_arrays(offsets, pa.array(path[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sketch, pa.binary()), lists], ["id", "node", "sketch", "paths"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Batches of whole groups; rows come sorted by the first n_keys columns."""
    rest: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        last = [t.column(k)[-1] for k in range(n_keys)]
        cut = t.num_rows
        keys = [t.column(k).to_pylist() for k in range(n_keys)]
        end = [x.as_py() for x in last]
        while cut and all(keys[k][cut - 1] == end[k] for k in range(n_keys)):
            cut -= 1
        if cut:
            yield pa.concat_tables([*rest, t.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(t.slice(cut))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the similar sketches in each bucket. Columns: path, block, node, sketch, side."""
    for t in _groups(batches, 2):
        path, block = t.column(0).to_numpy(), t.column(1).to_numpy()
        names, node = np.unique(np.array([x.hex() for x in t.column(2).to_pylist()]), return_inverse=True)
        s = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, T // 2)
        side = t.column(4).to_numpy()
        a, b = [], []
        at = np.arange(len(path))
        for lag in range(1, len(path)):
            at = at[at + lag < len(path)]
            at = at[(path[at] == path[at + lag]) & (block[at] == block[at + lag])]
            if not len(at):
                break
            use = at[(side[at] != side[at + lag]) | (side[at] < 0)]
            for part in np.array_split(use, len(use) // 20_000 + 1):
                hit = part[_ZERO[s[part] ^ s[part + lag]].sum(1, dtype=np.int32) >= LEAST]
                a.append(node[hit])
                b.append(node[hit + lag])
        if not a:
            continue
        label = _labels(len(names), np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(label != np.arange(len(names)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([bytes.fromhex(x) for x in names[own]], pa.binary()), pa.array([bytes.fromhex(x) for x in names[label[own]]], pa.binary())], ["u", "v"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets on their paths longer by a token: each path selects SPLITS of the tokens, so none loses its rows. Columns: path, n, node, sketch."""
    for b in batches:
        path, at = np.unique(b.column(0).to_numpy().view(np.uint64), return_inverse=True)
        s = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, T // 2)
        tokens = np.argsort(_mix(path[:, None] ^ _SEED[None, :]), axis=1, kind="stable")[:, :SPLITS] if len(path) else np.zeros((0, SPLITS), np.int64)
        j = tokens[at]
        value = (np.take_along_axis(s, j // 2, 1) >> np.where(j % 2, 0, 4).astype(np.uint8)) & 15
        out = _mix(path[at][:, None] * np.uint64(0x9E3779B97F4A7C15) + _SEED[j] + value)
        row = pa.array(np.repeat(np.arange(len(at)), SPLITS))
        yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), *(b.column(k).take(row) for k in range(4))], ["path", "parent", "was", "node", "sketch"])


def _in_blocks(rows: DataFrame, size: Column, most: int) -> DataFrame:
    """rows (with column node) once for each pair of blocks that they are compared in: block, side."""
    n = F.ceil(size / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("node"), n.cast("long")).cast("int")
    at = rows.select("*", n.alias("_n"), own.alias("_b")).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    block = (F.least("_b", "_o").cast("long") * F.col("_n") + F.greatest("_b", "_o")).alias("block")
    side = F.when(F.col("_b") == F.col("_o"), F.lit(-1)).when(F.col("_b") < F.col("_o"), F.lit(0)).otherwise(F.lit(1)).alias("side")
    return at.select("*", block, side).drop("_n", "_b", "_o")


def _edges(rows: DataFrame, size: str) -> DataFrame:
    ready = _in_blocks(rows, F.col(size), SKETCH_BLOCK).select("path", "block", "node", "sketch", "side")
    return ready.repartition("path", "block").sortWithinPartitions("path", "block").mapInArrow(_compare, "u binary, v binary")


def _sized(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows of the paths in several, with their number n; a path of very many is met in several tasks."""
    return dealt_join(rows, several, "path", heavy_keys(several, "path"), ["node"])


def similar_edges(reps: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the sets that meet on a chosen path and have similar sketches.

    A large bucket is split on further tokens. Where its longer paths that keep
    over half of it would together take more comparisons than the bucket itself
    (near copies agree on every token), the bucket is compared as it is, once,
    in the place of all its paths.
    """
    met = reps.select(F.explode("paths").alias("path"), "node").distinct()
    several = durable(met.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "paths")
    rows = _sized(met, several).join(reps.select("node", "sketch"), "node").select("path", "n", "node", "sketch")
    rows = durable(rows, "buckets")
    edges = _edges(rows.filter(F.col("n") <= LIMIT), "n")
    large = rows.filter(F.col("n") > LIMIT)
    if large.isEmpty():
        return edges
    edges = durable(edges, "met")  # each turn's edges by a job of their own: the exchanges of all turns at once take a thread of the driver each
    for _ in range(ROUNDS):
        if large.isEmpty():
            return edges
        longer = durable(large.mapInArrow(_split, "path long, parent long, was long, node binary, sketch binary").distinct(), "split")
        several = durable(longer.groupBy("path").agg(F.count("*").alias("n"), F.min("parent").alias("of"), F.min("was").alias("_was")).filter("n > 1"), "paths")
        hard = (F.col("n") > LIMIT) & (F.col("n") > 0.5 * F.col("_was"))
        squares = several.filter(hard).groupBy(F.col("of").alias("path")).agg(F.sum(F.col("n").cast("double") ** 2).alias("all"), F.min("_was").alias("w"))
        whole = durable(squares.filter(F.col("all") >= F.col("w").cast("double") ** 2).select("path", F.col("w").alias("n")), "whole")
        edges = edges.unionByName(durable(_edges(_sized(large.drop("n"), whole), "n"), "met"))
        rest = several.join(whole.select(F.col("path").alias("of")), "of", "left_anti").select("path", "n", "_was")
        rows = _sized(longer.select("path", "node", "sketch"), rest)
        edges = edges.unionByName(durable(_edges(rows.filter((F.col("n") <= LIMIT) | hard), "n"), "met"))
        large = durable(rows.filter((F.col("n") > LIMIT) & ~hard).select("path", "n", "node", "sketch"), "large")
    return edges.unionByName(durable(_edges(large, "n"), "met"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (u, v) with the least node of its component.

    Alternates large and small stars; each round is written to the shared folder.
    """
    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = dealt_join(both.filter("v > u"), low.drop("n"), "u", heavy_keys(low, "u"), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(shingles(x.as_py())).tobytes() for x in b.column(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], ["root", "size", "node", "set"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 4:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[code] > 1
    row, code = row[use], code[use]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    cuts = np.searchsorted(code, np.arange(0, int(code[-1]) + 8192, 8192)) if len(code) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            a = np.zeros((m, 8192), np.float32)
            a[row[lo:hi], code[lo:hi] % 8192] = 1
            out += (a @ a.T).astype(np.int64)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each block: (node, links, v), v spanning. Columns: root, block, node, set, side."""
    for t in _groups(batches, 2):
        root, block = t.column(0).to_pylist(), t.column(1).to_pylist()
        begins = [k for k in range(len(root)) if not k or root[k] != root[k - 1] or block[k] != block[k - 1]] + [len(root)]
        names, links, to = [], [], []
        for lo, hi in zip(begins[:-1], begins[1:], strict=True):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column(3).slice(lo, hi - lo).to_pylist()]
            node = t.column(2).slice(lo, hi - lo).to_pylist()
            side = t.column(4).slice(lo, hi - lo).to_numpy()
            size = np.array([len(s) for s in sets])
            both = _shared(sets)
            near = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9
            near &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
            np.fill_diagonal(near, False)
            a, b = np.nonzero(near)
            label = _labels(hi - lo, a, b)
            for k in np.flatnonzero(near.any(1)):
                names.append(node[k])
                links.append(int(near[k].sum()))
                to.append(node[label[k]])
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64()), pa.array(to, pa.binary())], ["node", "links", "v"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (id, node), node the key of the text, and the texts as
    (node, class_id, n_links, n_copies, keep): keep is the (id, node) that stands for the class."""
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("node"), text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    seen = durable(base.mapInArrow(_sketched, f"id {kind}, node binary, sketch binary, paths array<long>"), "sketches")
    texts = durable(seen.groupBy("node").agg(F.min(F.struct(F.col("id"), F.col("node"))).alias("rep"), F.count("*").alias("n_copies")), "texts")
    once = seen.filter("sketch IS NOT NULL").join(texts.select(F.col("rep.id").alias("__el_i"), F.col("node").alias("_n")), F.col("id").eqNullSafe(F.col("__el_i")) & (F.col("node") == F.col("_n")))
    reps = durable(once.dropDuplicates(["id", "node"]).select("node", "sketch", "paths"), "reps")
    found = durable(components(similar_edges(reps)), "candidates")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    sized = dealt_join(found, sizes, "root", heavy_keys(sizes, "root", "size"), ["node"]).join(texts.select("node", F.col("rep.id").alias("rep_id")), "node")
    wanted = sized.select("root", "size", F.col("node").alias("_n"), "rep_id")
    texts_in = base.join(wanted, base["id"].eqNullSafe(wanted["rep_id"]) & (base["node"] == wanted["_n"])).dropDuplicates(["id", "node"])
    sets = texts_in.select("root", "size", "node", text_col).mapInArrow(_sets, "root binary, size long, node binary, set binary")
    blocks = _in_blocks(sets, F.col("size"), BLOCK).select("root", "block", "node", "set", "side")
    links = durable(blocks.repartition("root", "block").sortWithinPartitions("root", "block").mapInArrow(_verify, "node binary, links long, v binary"), "links")
    joined = components(links.select(F.col("node").alias("u"), "v"))
    count = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    every = durable(texts.join(joined, "node", "left").join(count, "node", "left").withColumn("root", F.coalesce("root", "node")), "classed")
    keep = every.groupBy("root").agg(F.min("rep").alias("keep"), F.count("*").alias("n"))
    both = dealt_join(every, keep.drop("n"), "root", heavy_keys(keep, "root"), ["node"])
    out = both.select("node", F.col("keep.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "keep")
    return seen.select("id", "node"), out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class."""
    _, texts = classes(docs, id_col, text_col)
    keep = texts.select(F.col("keep.id").alias("__el_i"), F.col("keep.node").alias("__el_n")).distinct()
    keyed = docs.withColumn("__el_node", text_key(F.col(text_col)))
    return keyed.join(keep, keyed[id_col].eqNullSafe(keep["__el_i"]) & (keyed["__el_node"] == keep["__el_n"]), "left_semi").dropDuplicates([id_col, "__el_node"]).select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt_join(rows, texts, "node", heavy_keys(texts, "node", "n_copies"), ["id"]).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")
