"""Alignment of two tokenizers' tokens, and in how many documents their ids are linked.

Each text is encoded by both tokenizers. The tokens of B are a static index of
byte ranges; every token of A stabs it by two bisections, which give the first
and the last token of B that overlaps it. A gap between tokens that no range
spans ends a group; all pairs of a group's tokens are links.

Pairs of ids are counted by the documents that hold them. They are stored once
for each document, packed, and summed in each task before the shuffle. The
counts of the most frequent pairs, HOT at most, are broadcast as numbers; all
others are joined back by shuffle, and none of these can be in over
2 / HOT of all documents' pairs, so no task is hot. The highest count of each
id of A has a row for each id of the vocabulary at most and is broadcast.

Defined results: null and empty texts, and texts that either tokenizer does not
give back byte by byte, have no tokens: zeros and ''. Repeated rows count as
documents of their own and get equal results; an empty table gives no row; a
very long text is one row, but its pairs travel in parts of about PART; equal
counts are all highest; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Most pairs whose counts are broadcast.
HOT = 1 << 20
#: Pairs of tokens that a text's part holds before equal ones are merged.
PART = 1 << 22
#: Pairs that a task merges before it passes their counts on.
FLUSH = 1 << 22
#: Characters that are encoded at a time.
SLICE = 1 << 20
#: Most distinct parts of texts that a task remembers, and their characters.
MEMO = 1 << 20
MEMO_CHARS = 1 << 26

WHITE = " \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space after anything but white space, and one at the start or after white space.
SPACE = re.compile(f"(?<=[^{WHITE}]) ")
LATER = re.compile(f"^ |[{WHITE}] ")

HEAD = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for 256 and up, in order."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both vocabularies as text and bytes, so that executors need no file of their own."""

    def __init__(self, byte_level: str, pieces: str):
        with open(byte_level, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        letters = byte_letters()
        self.ranks = {bytes(letters[c] for c in word): k for word, k in model["model"]["vocab"].items() if word not in special}
        with open(pieces, "rb") as f:
            self.pieces = f.read()

    def open(self) -> Tokenizers:
        """Makes the encoders, in the task that uses them."""
        import sentencepiece
        import tiktoken

        # The fixed pattern of the byte-level vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.pieces)
        self.a_bytes = [b""] * (max(self.ranks.values()) + 1)
        for word, k in self.ranks.items():
            self.a_bytes[k] = word
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(w) for w in x]) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = (np.array([[f"{k}{end}" for k in range(len(x))] for end in ends], object) for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", ""))))
        words = [self.b.id_to_piece(k).lstrip("▁") for k in range(self.b.get_piece_size()) if not self.b.is_control(k)]
        self.apart = not any("▁" in w for w in words)
        self._forget()
        return self

    def _piece(self, k: int) -> bytes:
        word = self.b.id_to_piece(k)
        return bytes([int(word[3:5], 16)]) if self.b.is_byte(k) else word.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.known, self.chars = {}, 0
        self.ids = array("i"), array("i")
        self.ends = array("q", [0]), array("q", [0])
        self.same = bytearray()

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts that aren't known; each stands for a space and itself."""
        blank = [self.b.piece_to_id("▁")]
        a = list(map(self.a.encode_ordinary, map(" ".__add__, parts)))
        b = [ids or blank for ids in self.b.encode(parts, num_threads=1)]
        want = [p.encode() for p in map(" ".__add__, parts)]
        size, same = np.array(list(map(len, want)), np.int64), np.ones(len(parts), bool)
        for found, of, ids, ends in zip((a, b), (self.a_bytes, self.b_bytes), self.ids, self.ends, strict=True):
            flat = array("i", chain.from_iterable(found))
            to = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            given = list(map(of.__getitem__, flat))
            long = np.concatenate([[0], np.cumsum(np.fromiter(map(len, given), np.int64, len(given)))])
            if not np.array_equal(long[to], np.cumsum(size)) or b"".join(given) != b"".join(want):
                same &= [b"".join(map(of.__getitem__, x)) == w for x, w in zip(found, want, strict=True)]
            ends.frombytes((to + len(ids)).tobytes())
            ids.extend(flat)
        self.same += same.tobytes()
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.chars += sum(map(len, parts))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B of each text; none where either does not give back a space and the text.

        Neither tokenizer has a token over a space that follows no blank, so each
        distinct part between such spaces is encoded once and looked up after that.
        """
        if not self.apart:
            self._forget()
        parts = [split(t, self.apart) if t else [] for t in texts]
        found = {p for x in parts for p in x}
        if len(self.known) + len(found) > MEMO or self.chars > MEMO_CHARS:
            self._forget()
        self._learn([p for p in found if p not in self.known])
        ids = [np.frombuffer(x, np.int32) for x in self.ids]
        ends = [np.frombuffer(x, np.int64) for x in self.ends]
        same = np.frombuffer(self.same, bool)
        out = []
        for x in parts:
            at = np.fromiter(map(self.known.__getitem__, x), np.int64, len(x))
            out.append(tuple(_runs(i, e, at if same[at].all() else at[:0]) for i, e in zip(ids, ends, strict=True)))
        return out


def split(text: str, apart: bool = True) -> list[str]:
    """The parts between spaces that follow no white space."""
    return [text] if not apart else SPACE.split(text) if LATER.search(text) else text.split(" ")


def _runs(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` of the given numbers, one after the other."""
    begin, size = ends[at], ends[at + 1] - ends[at]
    to = np.cumsum(size)
    return flat[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(begin - to + size, size)].astype(np.int64)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last token of B that overlaps each token of A; tokens follow each other without gaps."""
    begins = np.concatenate([[0], a_ends[:-1]])
    return np.searchsorted(b_ends, begins, "right"), np.searchsorted(b_ends, a_ends, "left")


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie before the end of each group.

    A token of A and its successor overlap different tokens of B only where no token spans the gap between them.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = overlaps(a_ends, b_ends)
    closed = np.append(last[:-1] < first[1:], True)
    return np.flatnonzero(closed) + 1, last[closed] + 1


def pairs(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, links): each pair of ids that is linked, as id of A << 32 | id of B, in order, and its number of links.

    Where a text has more links than ``part``, equal ids within a group are
    merged and the ids of A are dealt into parts, so no pair is in two of them.
    """
    a_n, b_n = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    of_a, of_b = np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)
    a_times, b_times = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    parts = 1
    if int((a_n * b_n).sum()) > part:
        merged = lambda of, ids: np.unique(of << 32 | ids, return_counts=True)
        (a, a_times), (b, b_times) = merged(of_a, a), merged(of_b, b)
        of_a, a, of_b, b = a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF
        a_n, b_n = (np.bincount(of, minlength=len(a_n)) for of in (of_a, of_b))
        parts = -(-int((a_n * b_n).sum()) // part)
    b_begin = np.cumsum(b_n) - b_n
    for k in range(parts):
        mine = a % parts == k if parts > 1 else slice(None)
        at, ids, times = of_a[mine], a[mine], a_times[mine]
        n = b_n[at]
        ends = np.cumsum(n)
        other = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(b_begin[at] - ends + n, n)
        keys = np.repeat(ids, n) << 32 | b[other]
        links = np.repeat(times, n) * b_times[other]
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[new], np.add.reduceat(links, new) if len(new) else links


def groups_text(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_text: np.ndarray, b_text: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, in order. The texts have each id with each of its ends."""
    if not len(a):
        return ""
    a_end, b_end = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_end[a_cut - 1], b_end[b_cut - 1], b_end[-1] = 1, 1, 2
    out = np.empty(len(a) + len(b), object)
    a_n, b_n = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    out[np.arange(len(a)) + np.repeat(b_cut - b_n, a_n)] = a_text[a_end, a]
    out[np.arange(len(b)) + np.repeat(a_cut, b_n)] = b_text[b_end, b]
    return "".join(out.tolist())


def _packed(keys: np.ndarray, links: np.ndarray) -> bytes:
    """Differences of the ordered keys and the links, as bytes; Parquet compresses them."""
    wide = 4 if not len(links) or int(links.max()) < 1 << 32 else 8
    return bytes([wide]) + np.diff(keys, prepend=0).tobytes() + links.astype(f"<u{wide}").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = data[0]
    n = (len(data) - 1) // (8 + wide)
    return np.cumsum(np.frombuffer(data, np.int64, n, 1)), np.frombuffer(data, f"<u{wide}", n, 1 + 8 * n).astype(np.int64)


def align(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __el_k, n_a, n_b, n_groups, n_links, groups_sha256, pairs): a row for each document, and further ones with pairs only.

    __el_k is a number of the row, for a result that is stored before it is used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value.open()
        for whole in batches:
            sizes = [len(x.as_py() or "") for x in whole.column(2)]
            at = 0
            while at < len(sizes):
                to, size = at + 1, sizes[at]
                while to < len(sizes) and size + sizes[to] <= SLICE:
                    size += sizes[to]
                    to += 1
                batch = whole.slice(at, to - at)
                at = to
                row, head, data = [], [], []
                for k, (a, b) in enumerate(t.encode(batch.column(2).to_pylist())):
                    cuts = groups(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
                    said = groups_text(a, b, *cuts, t.a_text, t.b_text)
                    links = int((np.diff(cuts[0], prepend=0) * np.diff(cuts[1], prepend=0)).sum())
                    found = [len(a), len(b), len(cuts[0]), links, hashlib.sha256(said.encode()).hexdigest() if said else ""]
                    for part in pairs(a, b, *cuts):
                        row.append(k)
                        head.append(found)
                        data.append(_packed(*part))
                        found = [None] * 5
                    if sum(map(len, data)) > 1 << 25:
                        yield rows_(batch, row, head, data)
                        row, head, data = [], [], []
                if row:
                    yield rows_(batch, row, head, data)

    def rows_(batch: pa.RecordBatch, row: list, head: list, data: list) -> pa.RecordBatch:
        numbers = [pa.array(x, pa.int64()) for x in list(zip(*head, strict=True))[:4]]
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array([x[4] for x in head], pa.string()), pa.array(data, pa.binary())], [id_col, "__el_k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.monotonically_increasing_id().alias("__el_k"), text_col)
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, __el_k long, {HEAD}, pairs binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents each pair of ids is linked, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for b in batches:
            for data in b.column(0):
                held.append(_unpacked(data.as_py())[0])
                size += len(held[-1])
                if size > FLUSH:
                    size = 0
                    yield rows()
        yield rows()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count, a power of two, that at most ``most`` pairs reach. Below it a pair has under twice the count of the pair of rank ``most``."""
    by = {r["p"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("k")).collect()}
    least, above = max(by, default=-1) + 1, 0
    while least > 0 and above + by.get(least - 1, 0) <= most:
        least -= 1
        above += by.get(least, 0)
    return 1 << least


def _scores(aligned: DataFrame, shared, id_col: str) -> DataFrame:
    """(__el_k, n_best, count_sum) of the links whose pairs are broadcast, a row for each stored one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for b in batches:
            sums = []
            for data in b.column(1):
                own, links = _unpacked(data.as_py())
                at = np.searchsorted(keys, own).clip(max=max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                sums.append((int(links[hit][best[at[hit]]].sum()), int((links[hit] * n[at[hit]]).sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (list(zip(*sums, strict=True)) or [[], []]))], ["__el_k", "n_best", "count_sum"])

    return aligned.select("__el_k", "pairs").mapInArrow(run, "__el_k long, n_best long, count_sum long")


def _others(aligned: DataFrame, shared) -> DataFrame:
    """(__el_k, pair, links) of the pairs that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value[0]
        for b in batches:
            for k, data in zip(b.column(0), b.column(1), strict=True):
                own, links = _unpacked(data.as_py())
                if len(keys):
                    rare = keys[np.searchsorted(keys, own).clip(max=len(keys) - 1)] != own
                    own, links = own[rare], links[rare]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k.as_py())), pa.array(own), pa.array(links)], ["__el_k", "pair", "links"])

    return aligned.select("__el_k", "pairs").mapInArrow(run, "__el_k long, pair long, links long")


def alignments(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    n_best are the links whose pair has the highest count of its id of A, count_sum the sum of the links' counts.
    """
    aligned = durable(align(docs, tokenizers, id_col, text_col), "aligned")
    counts = durable(pair_counts(aligned), "pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    least = _frequent(counts, hot)
    got = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    packed = got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy(zero_copy_only=False)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    rest = _others(aligned, shared).join(counts.filter(F.col("n") < least), "pair")
    rest = rest.groupBy("__el_k").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum"))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    heads = aligned.filter("n_a IS NOT NULL").select("__el_k", id_col, *names)
    sums = _scores(aligned, shared, id_col).unionByName(rest)
    rows = heads.unionByName(sums, allowMissingColumns=True).groupBy("__el_k").agg(F.max(id_col).alias(id_col), *(F.max(c).alias(c) for c in names), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizers = Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignments(table(spark, sf_dir, "documents"), tokenizers).withColumn("doc_id", F.col("doc_id").cast("long"))
