"""BPE encoding and decoding over a table of distinct words.

Texts are split into words; each distinct word of the corpus is encoded once
by the tokenizer (the distinct-word table, written to the shared folder). The
most frequent words, HOT at most and none of over HOT_BYTES, are broadcast and
met while the texts are read; every other occurrence travels as (document,
position, word), is joined with the distinct-word table and joins its
document's ids at its position. So the broadcast has a fixed bound and all
other words have an exact way at any size; occurrences of one that is frequent
all the same (a long one) are dealt over several tasks. Decoding joins ids with
the pieces of the vocabulary, whose size is fixed.

A text of ASCII and Latin-1 letters only is split as the tokenizer splits it
(lower case, contractions, letters, digits, marks); any other text at blanks,
and the tokenizer works on what lies between. Either way no merge crosses a
word's end.

Defined results: null is empty; an empty text has no ids; an empty table gives
no row; repeated rows get equal results; a very long text is one row
throughout; equally frequent words are hot by their hashes, which no result
shows; columns besides id and text are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, durable, heavy_keys, table, with_key

#: Most words that are broadcast, and the most bytes of one.
HOT = 1 << 18
HOT_BYTES = 64
#: Hashes by which equally frequent words are told apart.
TIES = 1 << 20
#: Words that a task counts before it passes the counts on, and characters that it reads.
FLUSH = 300_000
FLUSH_CHARS = 1 << 26

LETTERS = [c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)] + [c for c in range(128) if chr(c).isalpha()]
PROSE = bytes([*b" \t\n\r.,", *LETTERS])
PLAIN = bytes([*b"\t\n\r", *range(0x20, 0x7F), *LETTERS])
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
BLANK = re.compile(r"[^ \t\n\r]+")


def split(text: str | None) -> list[str]:
    if not text:
        return []
    try:
        rest = text.encode("latin-1").translate(None, PROSE)
    except UnicodeEncodeError:
        return BLANK.findall(text)
    if not rest and not any(x in text for x in ("..", ".,", ",.", ",,")):
        return text.lower().replace(".", " . ").replace(",", " , ").split()
    if not rest.translate(None, PLAIN) and "<|" not in text:
        return WORD.findall(text.lower())
    return BLANK.findall(text)


class Vocabulary:
    """The tokenizer's file as text, so that executors need no file of their own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()

    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.json)
        t.no_truncation()
        t.no_padding()
        return t


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = 0

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0):
                t = text.as_py() or ""
                seen.update(split(t))
                size += len(t)
                if len(seen) > FLUSH or size > FLUSH_CHARS:
                    size = 0
                    yield rows()
        yield rows()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, ids): each distinct word encoded once; ids are 32-bit integers as bytes."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value.tokenizer()
        for b in batches:
            ids = []
            for at in range(0, b.num_rows, 2000):
                part = b.column(0).slice(at, 2000).to_pylist()
                ids += [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(encode, "word string, n long, ids binary")


def _boundary(rows: DataFrame, value: str, most: int) -> tuple[int, int]:
    """(least, above): the rows whose value is least or more are ``most`` or fewer, ``above`` of them, and with those of least - 1 they are more.

    Values are whole numbers from 0. The range is cut into at most 4096 parts until one value is left, so little comes to the driver.
    """
    top, n = rows.agg(F.max(value), F.count("*")).head()
    if n <= most:
        return 0, n
    low, high, above = 0, int(top) + 1, 0
    while high > low:
        step = -(-(high - low) // 4096)
        inside = rows.filter((F.col(value) >= low) & (F.col(value) < high))
        parts = {r["p"]: r["k"] for r in inside.groupBy(F.expr(f"int(({value} - {low}) div {step})").alias("p")).agg(F.count("*").alias("k")).collect()}
        for p in sorted(parts, reverse=True):
            if above + parts[p] > most:
                if step == 1:
                    return low + p + 1, above
                low, high = low + p * step, min(high, low + (p + 1) * step)
                break
            above += parts[p]
        else:
            return low, above
    return low, above


def hot_words(words: DataFrame, most: int = HOT) -> Column:
    """Whether a word is among the most frequent ones of at most HOT_BYTES, ``most`` of them.

    Of words with the count at which the number is reached, those of some hashes
    are taken, so the number comes near ``most`` also where a great many words
    have one count.
    """
    short = words.filter(F.octet_length("word") <= HOT_BYTES).select("n", F.pmod(F.xxhash64("word"), F.lit(TIES)).alias("slot"))
    least, above = _boundary(short, "n", most)
    if not least:
        return F.octet_length("word") <= HOT_BYTES
    first, _ = _boundary(short.filter(F.col("n") == least - 1), "slot", most - above)
    tie = (F.col("n") == least - 1) & (F.pmod(F.xxhash64("word"), F.lit(TIES)) >= first)
    return (F.octet_length("word") <= HOT_BYTES) & ((F.col("n") >= least) | tie)


def _lookup(words: DataFrame):
    """The hot words, most frequent first, as (text of words, offsets, ids)."""
    got = words.select("word", "n", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    sizes = pc.binary_length(got["ids"]).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(got["ids"].to_pylist()), "<u4")
    return "\n".join(got["word"].to_pylist()), np.concatenate([[0], np.cumsum(sizes)]), flat


_INDEX: dict = {}


def _index(shared) -> tuple[dict, np.ndarray, np.ndarray]:
    if shared.value[0] is not _INDEX.get("of"):
        _INDEX.clear()
        text, offsets, flat = shared.value
        _INDEX.update(of=text, got=({w: k for k, w in enumerate(text.split("\n"), 1)} if text else {}, offsets, flat))
    return _INDEX["got"]


def _pack(idx: np.ndarray) -> bytes:
    """Ranks of words, 0 for a rare one, by planes of bytes: frequent words have short ranks."""
    return zstandard.compress((idx.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3]).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def _known(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(id, __el_k, pos -1, data): each text as the ranks of its words, with gaps for the rare words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _index(shared)[0].get
        for b in batches:
            data = [_pack(np.array([get(w, 0) for w in split(t.as_py())], np.uint32)) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([-1] * b.num_rows, pa.int32()), pa.array(data, pa.binary())], [id_col, "__el_k", "pos", "data"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "__el_k", text_col).mapInArrow(run, f"`{id_col}` {kind}, __el_k long, pos int, data binary")


def _rare(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(id, __el_k, pos, word): the occurrences of words that are not broadcast, pos counting them in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)[0]
        for b in batches:
            row, pos, word = [], [], []
            for k, text in enumerate(b.column(2)):
                rare = [w for w in split(text.as_py()) if w not in index]
                row += [k] * len(rare)
                pos += range(len(rare))
                word += rare
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(pos, pa.int32()), pa.array(word, pa.string())], [id_col, "__el_k", "pos", "word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "__el_k", text_col).mapInArrow(run, f"`{id_col}` {kind}, __el_k long, pos int, word string")


def _whole(shared, id_col: str):
    """Makes (id, ids) of the rows of each document, met in order of pos; ids are packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, offsets, flat = _index(shared)
        some = lambda x: x if len(x) else np.zeros(1, np.uint32)
        key, packed, rare = None, [], {}
        ids, out = [], []

        def close():
            fill = [rare[k] for k in range(len(rare))]
            own = np.frombuffer(b"".join(fill), "<u4")
            own_at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in fill])]).astype(np.int64)
            for data in packed:
                rank = _unpack(data)
                gap = rank == 0
                begin = offsets[np.maximum(rank, 1) - 1] if len(flat) else np.zeros(len(rank), np.int64)
                size = offsets[np.maximum(rank, 1)] - begin if len(flat) else np.zeros(len(rank), np.int64)
                if len(rare):
                    begin[gap], size[gap] = own_at[:-1] + len(flat), np.diff(own_at)
                ends = np.cumsum(size)
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)
                ids.append(key[0])
                got = np.where(at < len(flat), some(flat).take(at, mode="clip"), some(own).take(at - len(flat), mode="clip"))
                out.append(got.astype("<u4").tobytes())

        def rows_():
            got = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.binary())], [id_col, "ids"])
            ids.clear()
            out.clear()
            return got

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for i, k, pos, data in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if key != (i, k):
                    if key is not None:
                        close()
                    key, packed, rare = (i, k), [], {}
                    if len(out) >= 500:
                        yield rows_()
                if pos < 0:
                    packed.append(data)
                else:
                    rare[pos] = data
        if key is not None:
            close()
        if kind is not None:
            yield rows_()

    return run


def _met(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, hot: int):
    """The packed texts and the ids of their rare words, sorted for _whole, and the broadcast words."""
    words = durable(encode_words(count_words(docs, text_col), vocabulary), "words")
    is_hot = hot_words(words, hot)
    shared = docs.sparkSession.sparkContext.broadcast(_lookup(words.filter(is_hot)))
    keyed = with_key(docs.select(id_col, text_col), id_col, text_col)
    others = words.filter(~is_hot).select("word", "n", F.col("ids").alias("data"))
    heavy = heavy_keys(others, "word")
    rare = dealt_join(_rare(keyed, shared, id_col, text_col), others.drop("n"), "word", heavy, ["__el_k", "pos"]).select(id_col, "__el_k", "pos", "data")
    rows = _known(keyed, shared, id_col, text_col).unionByName(rare)
    return rows.repartition(id_col, "__el_k").sortWithinPartitions(id_col, "__el_k", "pos"), shared


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, ids): for each row of docs the token ids of its whole text, as bytes of 32-bit integers."""
    rows, shared = _met(docs, vocabulary, id_col, text_col, hot)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_whole(shared, id_col), f"`{id_col}` {kind}, ids binary")


def _pieces(spark: SparkSession, vocabulary: Vocabulary, id_col: str):
    """Makes (id, n_tokens, ids_text, decoded) of (id, ids)."""
    t = vocabulary.tokenizer()
    size = max(t.get_vocab(with_added_tokens=True).values()) + 1
    pieces = spark.sparkContext.broadcast([t.id_to_token(k) or "" for k in range(size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(pieces.value, pa.string())
        number = pa.array(map(str, range(len(piece))), pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                data = b.column(1).to_pylist()
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]), pa.int64())
                ids = pa.array(np.frombuffer(b"".join(data), "<u4"))
                join = lambda words: pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.take(ids)), " ").cast(pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0), pc.subtract(offsets[1:], offsets[:-1]), join(number), join(piece)], [id_col, "n_tokens", "ids_text", "decoded"])

    return run


DECODED = "n_tokens long, ids_text string, decoded string"


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """encoded with n_tokens, ids_text (ids joined by a space) and decoded, by looking up each id's piece."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(_pieces(encoded.sparkSession, vocabulary, id_col), f"`{id_col}` {kind}, {DECODED}")


def encode_decode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """decode(encode(docs)) in one Python worker a task instead of two."""
    rows, shared = _met(docs, vocabulary, id_col, text_col, hot)
    whole, pieces = _whole(shared, id_col), _pieces(docs.sparkSession, vocabulary, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lambda batches: pieces(whole(batches)), f"`{id_col}` {kind}, {DECODED}")


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    out = encode_decode(docs, vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
