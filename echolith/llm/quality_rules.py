"""Quality rules: a threshold table compiled into one projection without user functions.

Words are runs of anything but space and \\t-\\r. Every measure comes from the
whole text of one row, so the plan is a scan and a projection; nothing is
shuffled, and a hot source or group of copies costs no more than other rows.

Defined results: a null text has no words and fails; an empty text likewise;
an empty table gives no row; repeated rows each get their own equal result; a
ratio equal to a bound lies within it; a text or word of any length is one row,
read in time linear in its length but for the sort of its word windows; other
columns pass through ``rate`` untouched unless a measure has the same name,
which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

BLANK = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for with as on be are this by was or from at",
    "de": "der die das und in zu den mit von für auf ist im sich des dem nicht ein eine als",
    "fr": "de la le les et des en un une du que est pour dans par sur ou au ce il",
    "es": "de la que el en y los se del las un por con no una para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """A bound on one ratio; a text whose ratio lies outside is not kept."""

    ratio: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios of the texts that are kept.
RULES = (
    Rule("mean_word_chars", 2.0, 18.0),
    Rule("symbols_per_word", None, 0.4),
    Rule("marked_words", None, 0.5),
    Rule("upper_words", None, 0.6),
    Rule("stop_word_share", 0.005, None),
    Rule("dup_line_share", None, 0.6),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def at(found: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            twice = F.filter(found, lambda x, i: same(F.get(found, i - 1), x) | same(F.get(found, i + 1), x))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, at), width))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of all counts and ratios of one text."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column, found: Column) -> Column:
        n = F.size(words)
        share = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            share(F.size(F.filter(words, lambda w: w.isin(stops)))).alias("stop_word_share"),
            share(F.size(F.filter(words, lambda w: w.rlike("[#*$%&|<>]|!!")))).alias("marked_words"),
            share(F.size(F.filter(words, lambda w: ~w.rlike(r"\p{Ll}") & w.rlike(r"\p{Lu}\P{Lu}*+\p{Lu}")))).alias("upper_words"),
        )

    return let(_words(text), lambda w: let(lines, lambda x: of(w, x)))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every ratio lies within its bounds."""
    ratios = {
        "mean_word_chars": F.col("word_chars") / F.col("n_words"),
        "symbols_per_word": F.col("n_symbols") / F.col("n_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    held = F.lit(True)
    for r in rules:
        value = ratios.get(r.ratio, F.col(r.ratio))
        if r.low is not None:
            held = held & (value >= r.low)
        if r.high is not None:
            held = held & (value <= r.high)
    return held


def rate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    m = docs.withColumn("__el_m", measures(F.col(text_col)))
    names = m.schema["__el_m"].dataType.names
    m = m.withColumns({n: F.col("__el_m")[n] for n in names}).drop("__el_m")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(compile_rules(rules)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    [w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS ws,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
tri AS (
  SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM (
  SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT k, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM twice GROUP BY k),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    len([w for w in ws if w IN ({_quoted(sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))})]) AS n_stop,
    len([w for w in ws if regexp_matches(w, '[#*$%&|<>]|!!')]) AS n_marked,
    len([w for w in ws if regexp_matches(w, '^\P{{Ll}}*\p{{Lu}}\P{{Ll}}*\p{{Lu}}\P{{Ll}}*$')]) AS n_upper
  FROM d LEFT JOIN rep ON d.k = rep.k),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE
    word_chars / n_words BETWEEN 2.0 AND 18.0 AND n_symbols / n_words <= 0.4 AND n_marked / n_words <= 0.5
    AND n_upper / n_words <= 0.6 AND n_stop / n_words >= 0.005 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 END AS kept
FROM f
"""
