"""Benchmark decontamination over a positional inverted index.

Term frequencies of the test windows' words are counted over the corpus. Then
one scan writes the index: the postings (term, document, position) of each
window's rarest and second rarest term, as a table in the shared folder, those
of the rarest with the words around them. The lists of the two terms are
shifted by their offsets and intersected in a shuffle join on (terms,
document, position); what is left is held against the exact wording. A
``proximity`` match lets the two offsets differ. Only hashes of the terms are
broadcast, BLOCK of them a scan; windows, items and postings meet by shuffles,
and postings of a frequent term or passages that very many documents share are
dealt over several tasks.

Defined results: null and empty texts have no words and no hit; an item
without words has no window; an empty table of either side gives no hit; equal
windows of several items count for each, windows with equally rare words give
the same hits whichever is looked up; a very long text is one row of words;
rows with the same id and text each get the same result; columns besides id
and text are not read, and ``clean`` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, durable, heavy_keys, table, with_key

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Most hashes of terms that are broadcast; each further block of them is a scan.
BLOCK = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and other letters as they are."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.filter(F.split(low, GAP), lambda w: w != "")


def test_windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(wtext, ws, item): the windows of each item and their words."""
    ws = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    cut = ws.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("ws"))
    return cut.select(F.array_join("ws", " ").alias("wtext"), "ws", "item").dropDuplicates(["wtext", "item"])


def _blocks(terms: DataFrame, n: int) -> list[DataFrame]:
    """terms (with their hash h) in blocks of about BLOCK rows at most."""
    k = -(-n // BLOCK)
    return [terms] if k <= 1 else [terms.filter(F.pmod("h", F.lit(2 * k)) == i) for i in range(2 * k)]


def term_frequencies(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, cf): how often each test term occurs in the corpus, in one scan; tokens has column ws."""
    rows = tokens.select(F.explode("ws").alias("term"))
    hashed = terms.select(F.xxhash64("term").alias("h")).distinct()
    if hashed.count() <= BLOCK:  # other terms need not be counted; where there are more, they are
        rows = rows.join(F.broadcast(hashed), F.xxhash64("term") == F.col("h"), "left_semi")
    return rows.groupBy("term").agg(F.count("*").alias("cf")).join(terms, "term")


def anchored(windows: DataFrame, cf: DataFrame, whole: bool = True) -> DataFrame:
    """Each window with the offsets of its rarest and second rarest term that occur; windows with an absent term go, if asked whole."""
    terms = windows.select("wtext", F.size("ws").alias("len"), F.posexplode("ws").alias("off", "term"))
    both = terms.join(cf, "term").groupBy("wtext", "len").agg(F.sort_array(F.collect_list(F.struct("cf", "off", "term"))).alias("by"))
    a, b = F.col("by")[0], F.get(F.col("by"), 1)
    out = (both.filter(F.size("by") == F.col("len")) if whole else both).select(
        "wtext", "len", a["term"].alias("term"), a["off"].alias("off"), a["cf"].alias("cf"),
        F.coalesce(b["term"], a["term"]).alias("term2"), F.coalesce(b["off"], a["off"]).alias("off2"), F.coalesce(b["cf"], a["cf"]).alias("cf2"),
    )
    return out.withColumn("shift", F.col("off2") - F.col("off")).withColumn("pair", F.xxhash64("term", "term2", "shift"))


def index(tokens: DataFrame, terms: DataFrame, id_col: str, size: int = WINDOW) -> DataFrame:
    """The stored index of (id, __el_k, ws): postings (term, id, __el_k, pos) of the terms (term, around), and for each document one of the empty term with n_words.

    pos counts from 1. Where a term has ``around``, near has the size - 1 words on either side of a posting, and the word itself.
    """
    wanted = terms.groupBy(F.xxhash64("term").alias("h")).agg(F.max("around").alias("around"))
    mark = tokens.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.lit(False).alias("around"))
    rows = tokens.select(id_col, "__el_k", "ws", F.explode(F.sequence(F.lit(0), F.size("ws"))).alias("pos"))
    rows = rows.withColumn("term", F.when(F.col("pos") == 0, F.lit("")).otherwise(F.get("ws", F.col("pos") - 1)))
    near = F.array_join(F.slice("ws", F.greatest(F.col("pos") - (size - 1), F.lit(1)), F.least(F.col("pos") - 1, F.lit(size - 1)) + size), " ")
    out = None
    for k, block in enumerate(_blocks(wanted, wanted.count())):
        block = block.unionByName(mark) if k == 0 else block
        found = rows.join(F.broadcast(block), F.xxhash64("term") == F.col("h"))
        found = found.select("term", id_col, "__el_k", "pos", F.when(F.col("pos") == 0, F.size("ws")).alias("n_words"), F.when(F.col("around"), near).alias("near"))
        out = found if out is None else out.unionByName(found)
    return durable(out, "postings")


def _list(postings: DataFrame, pairs: DataFrame, term: str, cf: str, columns: list[str]) -> DataFrame:
    """The postings of one of the terms of each pair."""
    counts = pairs.groupBy(F.col(term).alias("term")).agg(F.max(cf).alias("n"))
    right = pairs.select(F.col(term).alias("term"), "pair", "shift")
    return dealt_join(postings.select("term", *columns), right, "term", heavy_keys(counts, "term"), ["__el_k", "pos"])


def _searched(docs: DataFrame, items: DataFrame, names: tuple[str, str, str, str], whole: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """windows by item, anchors, stored postings, and the pairs of terms that are looked up."""
    id_col, text_col, item_id, item_text = names
    tokens = with_key(docs.select(id_col, text_col), id_col, text_col).select(id_col, "__el_k", words(F.col(text_col)).alias("ws"))
    having = durable(test_windows(items, item_id, item_text), "windows")
    windows = having.dropDuplicates(["wtext"]).select("wtext", "ws")
    terms = windows.select(F.explode("ws").alias("term")).distinct()
    anchors = durable(anchored(windows, term_frequencies(tokens, terms), whole), "anchors")
    used = anchors.select("term", F.lit(True).alias("around")).unionByName(anchors.select(F.col("term2").alias("term"), F.lit(False).alias("around")))
    postings = index(tokens, used, id_col)
    pairs = anchors.groupBy("pair", "term", "term2", "shift").agg(F.max("cf").alias("cf"), F.max("cf2").alias("cf2"))
    return having, anchors, postings, pairs


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, __el_k, n_words, start, len, item): for each row of docs one with n_words, for each exact occurrence one with start and len, for each item that occurs in a document one with it."""
    having, anchors, postings, pairs = _searched(docs, items, (id_col, text_col, item_id, item_text), True)
    first = _list(postings.filter("near IS NOT NULL"), pairs, "term", "cf", [id_col, "__el_k", "pos", "near"])
    second = _list(postings, pairs.filter("shift <> 0"), "term2", "cf2", ["__el_k", "pos"]).select("pair", "__el_k", (F.col("pos") - F.col("shift")).alias("pos"))
    met = first.filter("shift <> 0").join(second, ["pair", "__el_k", "pos"], "left_semi").unionByName(first.filter("shift = 0"))
    met = durable(met.select("pair", id_col, "__el_k", "pos", "near"), "intersected")
    counts = met.groupBy("pair").agg(F.count("*").alias("n"))
    both = dealt_join(met, anchors.select("pair", "wtext", "len", "off"), "pair", heavy_keys(counts, "pair"), ["__el_k", "pos"])
    before = F.least(F.col("pos") - 1, F.lit(WINDOW - 1))
    exact = F.array_join(F.slice(F.split("near", " "), F.greatest(before - F.col("off"), F.lit(0)) + 1, F.col("len")), " ") == F.col("wtext")
    hits = both.filter((F.col("off") <= before) & exact).select(id_col, "__el_k", (F.col("pos") - F.col("off")).alias("start"), "len", "wtext")
    hits = durable(hits, "hits")
    seen = hits.select(id_col, "__el_k", "wtext").distinct()
    often = hits.groupBy("wtext").agg(F.count("*").alias("n"))
    of = dealt_join(seen, having.select("wtext", "item"), "wtext", heavy_keys(often, "wtext"), ["__el_k"]).select(id_col, "__el_k", "item").distinct()
    rows = postings.filter("pos = 0").select(id_col, "__el_k", "n_words")
    spans = hits.select(id_col, "__el_k", "start", "len").distinct()
    return rows.unionByName(spans, True).unionByName(of, True).fillna(0, ["len"])


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, wtext, items, start, stretch): windows whose two rarest terms, of those that the corpus has, occur in a document
    with an offset that differs by at most slop from theirs in the window."""
    having, anchors, postings, pairs = _searched(docs, items, (id_col, text_col, item_id, item_text), False)
    first = _list(postings, pairs.filter("shift <> 0"), "term", "cf", [id_col, "__el_k", "pos"]).select("pair", id_col, "__el_k", "pos")
    second = _list(postings, pairs.filter("shift <> 0"), "term2", "cf2", ["__el_k", "pos"])
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    second = second.select("pair", "__el_k", "pos", "shift", off.alias("by")).select("pair", "__el_k", (F.col("pos") - F.col("shift") + F.col("by")).alias("pos"), F.abs("by").alias("by"))
    near = first.join(second.groupBy("pair", "__el_k", "pos").agg(F.min("by").alias("stretch")), ["pair", "__el_k", "pos"])
    texts = having.groupBy("wtext").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = near.join(anchors.select("pair", "wtext", "off"), "pair").join(texts, "wtext")
    return out.select(id_col, "wtext", "items", (F.col("pos") - F.col("off") - 1).alias("start"), "stretch")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each different row of docs, which copies counts, from the rows of occurrences()."""
    by_doc = found.groupBy(id_col, "__el_k").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count("n_words").cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("len") > 0, F.struct("start", "len")))).alias("at"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    merge = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], a["end"]))).alias("n"))
    n_hit = F.aggregate("at", zero, merge, lambda a: a["n"]).cast("long")
    return by_doc.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("at") > 0).alias("contaminated"), "__el_k", "copies",
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an occurrence of a test window."""
    dirty = occurrences(docs, items, id_col, text_col).filter("len > 0").select(F.col(id_col).alias("__el_i"), F.col("__el_k").alias("__el_j")).distinct()
    keyed = with_key(docs, id_col, text_col)
    return keyed.join(dirty, keyed[id_col].eqNullSafe(dirty["__el_i"]) & (keyed["__el_k"] == dirty["__el_j"]), "left_anti").drop("__el_k")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rows = report(found)
    return rows.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("_c", "copies", "__el_k")


_ASCII_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_SQL_WORDS = rf"regexp_extract_all({_ASCII_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH i AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[p:least(p + 9, len(ws))], ' ') AS g, least(10, len(ws)) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_WORDS} AS ws FROM documents),
x AS (SELECT DISTINCT n FROM w),
p AS (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, x WHERE len(ws) >= n),
h AS (SELECT k, s, p.n, item_id FROM p JOIN w ON p.n = w.n AND array_to_string(ws[s:s + p.n - 1], ' ') = g),
c AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS q FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(j, ',' ORDER BY j) AS js FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS j FROM h) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(js, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
