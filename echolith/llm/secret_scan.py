"""Secret scans with corpus-wide ownership frequency.

One projection finds candidate spans in every text. Candidate hashes are then
counted by distinct owner and repository over the whole corpus: a value that
many owners carry is a copied example, one that few carry looks live. A private
key is one span from BEGIN through END and is counted by its body. Only
candidates travel; texts stay where they were read. Counts are summed before
they are shuffled, and the rows of a value that very many hold are dealt over
several tasks when they meet its verdict.

Defined results: a null or empty text has no span; an empty table gives no
row; repeated rows (same id and text) get equal results; ties of a start are
ordered by kind; a null owner is one owner, a null repository one repository;
a text of any length is one row, its matches summed in runs; columns besides
the named ones are not read, and ``redact`` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, durable, heavy_keys, let, table, with_key

# The patterns of the three base kinds and of well-known key formats.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VENDOR = (
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}"
    r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
# What follows the header of a private key, the last of VENDOR: all through END; without an END, headers and lines of base64.
BODY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\\[nr]|\s)*+[A-Za-z-]+:\x20[^\n\\]*+)*+(?:(?:\\[nr]|[\s>*#|\"'+,])*+[A-Za-z0-9+/]{32,}+={0,2})*+(?:(?<=[A-Za-z0-9+/]{32})(?:\\[nr]|[\s>*#|\"'+,])++[A-Za-z0-9+/]{1,31}+(?:={1,2}|(?=\s*+(?:\n|\z))))?+)"
)
WHOLE = VENDOR + BODY
#: What does not belong to a private key's own text, so that copies with other line ends are equal.
AROUND = r"-----[A-Z ]*-----|\\[nr]|[^A-Za-z0-9+/=]"
KINDS = ("assign", "access", "hex", "vendor")
VALUE = "struct<k:int,s:int,e:int,h:string>"
#: A value that more owners than this carry is a widely copied example.
MAX_OWNERS = 3
#: Matches of a text whose lengths are summed at once.
RUN = 256


def _owned(value: Column) -> Column:
    """What is counted by owner: of a private key the body, if it has one."""
    body = F.regexp_replace(value, AROUND, "")
    return F.when(value.startswith("-----BEGIN") & (F.length(body) > 0), body).otherwise(value)


def _spans(text: Column, kind: int, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """Spans of the matches, from the lengths of what lies between them.

    Lengths are summed within runs of RUN matches and then over the runs, so that
    no array grows by one element for each match of a long text.
    """

    def prefix(lengths: Column) -> Column:
        """The sum of the elements before each, and behind it the sum of all."""
        start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out"))

        def step(acc: Column, n: Column) -> Column:
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))

        return F.aggregate(lengths, start, step)["out"]

    def of(match: Column, gap: Column) -> Column:
        sizes = F.transform(match, lambda m, i: F.length(F.get(gap, i)) + F.length(m))
        runs = let(sizes, lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(RUN)), lambda i: prefix(F.slice(x, i, RUN))))

        def placed(inner: Column, outer: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                e = F.get(outer, F.floor(i / RUN).cast("int")) + F.get(F.get(inner, F.floor(i / RUN).cast("int")), i % RUN + 1)
                value = F.regexp_extract(m, pattern, value_group) if value_group else m
                return F.struct(F.lit(kind).alias("k"), (e - F.length(m)).alias("s"), e.alias("e"), F.sha2(_owned(value) if pattern == WHOLE else value, 256).alias("h"), F.length(value).alias("n"))

            kept = F.filter(F.transform(match, span), lambda x: x["n"] >= least)
            return F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["h"].alias("h")).cast(VALUE))

        ends = lambda r: prefix(F.transform(r, lambda x: F.element_at(x, -1)))
        return let(runs, lambda r: let(ends(r), lambda o: placed(r, o)))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern), lambda g: of(m, g)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{VALUE}>"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    found = F.concat(_spans(t, 0, ASSIGN, 2, 6), _spans(t, 1, ACCESS), _spans(t, 2, HEX), _spans(t, 3, WHOLE))
    by_start = F.sort_array(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["h"].alias("h"))))
    return F.transform(by_start, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["h"].alias("h")))


def ownership(found: DataFrame, repo_col: str, owner_col: str, max_owners: int = MAX_OWNERS, max_repos: int | None = None) -> DataFrame:
    """(h, n_owners, n_repos, n, live) for each candidate hash; found has array column cands.

    A value is live that at most max_owners owners carry, in at most max_repos
    repositories where that is given: an owner who copies an example into all of
    their repositories does not make it a credential. n counts its occurrences.
    """
    rows = found.filter(F.size("cands") > 0).select(F.explode(F.transform("cands", lambda x: x["h"])).alias("h"), F.col(owner_col).alias("o"), F.col(repo_col).alias("r"))
    by_owner = rows.groupBy("h", "o", "r").agg(F.count("*").alias("n")).groupBy("h", "o").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    out = by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n"))
    few = F.lit(True) if max_repos is None else F.col("n_repos") <= max_repos
    return out.withColumn("live", (F.col("n_owners") <= max_owners) & few)


def judged(found: DataFrame, verdicts: DataFrame, id_col: str) -> DataFrame:
    """(id, __el_k, spans, n_live, n_example) of the rows that have candidates.

    Only the values that are not live are looked up; occurrences of one that very many rows hold are dealt over tasks.
    """
    copied = durable(verdicts.filter(~F.col("live")).select("h", "n"), "examples")
    rows = found.filter(F.size("cands") > 0).dropDuplicates([id_col, "__el_k"]).select(id_col, "__el_k", F.explode("cands").alias("c"))
    rows = rows.withColumn("h", F.col("c.h"))
    marked = dealt_join(rows, copied.select("h", F.lit(False).alias("live")), "h", heavy_keys(copied, "h"), [id_col, "__el_k", "c"], "left").fillna(True, ["live"])
    keep = (F.col("c.k") < 3) | F.col("live")
    span = F.struct(F.col("c.s").alias("s"), F.col("c.k").alias("k"), F.col("c.e").alias("e"))
    return marked.groupBy(id_col, "__el_k").agg(
        F.sort_array(F.collect_list(F.when(keep, span))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_repos: int | None = None) -> DataFrame:
    """One row per row of docs: id, _k, cands, spans, n_live, n_example."""
    names = list(dict.fromkeys([id_col, owner_col, repo_col, "__el_k"]))
    found = durable(with_key(docs, id_col, text_col).select(*names, candidates(F.col(text_col)).alias("cands")), "secrets")
    marks = judged(found, ownership(found, repo_col, owner_col, max_repos=max_repos), id_col).withColumnsRenamed({id_col: "__el_i", "__el_k": "__el_j"})
    joined = found.join(marks, found[id_col].eqNullSafe(marks["__el_i"]) & (found["__el_k"] == marks["__el_j"]), "left").drop("__el_i", "__el_j")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return joined.withColumn("spans", F.coalesce("spans", none)).fillna(0, ["n_live", "n_example"])


def _kind(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, KINDS)), k)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _kind(x["k"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """docs with every span masked in the text.

    Rows without candidates pass straight through; only the others meet their spans.
    """
    keyed = with_key(docs, id_col, text_col)
    cand = any_candidate(F.col(text_col))
    hit = keyed.filter(cand)
    names = list(dict.fromkeys([id_col, owner_col, repo_col, "__el_k"]))
    found = durable(hit.select(*names, candidates(F.col(text_col)).alias("cands")), "secrets")
    marks = judged(found, ownership(found, repo_col, owner_col), id_col).select(F.col(id_col).alias("__el_i"), F.col("__el_k").alias("__el_j"), F.col("spans").alias("__el_spans"))
    both = hit.join(marks, hit[id_col].eqNullSafe(marks["__el_i"]) & (hit["__el_k"] == marks["__el_j"]), "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, out).otherwise(acc["out"]).alias("out"))

    def done(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    masked = F.when(F.col("__el_spans").isNull(), text).otherwise(F.aggregate("__el_spans", start, step, done))
    return keyed.filter(~cand).select(*docs.columns).unionByName(both.withColumn(text_col, masked).select(*docs.columns))


def any_candidate(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(ASSIGN) | t.rlike(ACCESS) | t.rlike(HEX) | t.rlike(VENDOR)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    base = F.filter("cands", lambda x: x["k"] < 3)
    count = lambda k: F.size(F.filter("cands", lambda x: x["k"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT k, {kind} AS kind, s, s + length(m) AS e, v FROM (
    SELECT k, m, v, CAST(sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT k, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
      SELECT k, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS gs FROM d) WHERE len(ms) > 0)
    WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE length(v) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(_sql_spans(*x) for x in ((0, ASSIGN, 2, 6), (1, ACCESS, 0, 1), (2, HEX, 0, 1), (3, VENDOR, 0, 1)))}),
v AS (SELECT v, count(DISTINCT coalesce(source, '~')) <= {MAX_OWNERS} AS live FROM c JOIN d USING (k) GROUP BY v),
n AS (SELECT c.*, live, ['assign', 'access', 'hex', 'vendor'][kind + 1] || ':' || s || ':' || e AS x FROM c JOIN v USING (v)),
g AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM n GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (k)
"""
