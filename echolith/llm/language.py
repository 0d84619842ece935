"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams (1 to 3, lower case, from the whole text) are hashed into
BINS. The model is fit on about PER_LANG training rows of each language, of
SAMPLE_CHARS characters at most, chosen by a hash of the id at a rate set from
the language's count, so its size is bounded however large the corpus; the
priors are the languages' shares of all training rows. The log-probability
matrix (BINS x languages, at most LANGS) is broadcast; batches of texts are
scored as sparse rows: their bins are gathered from the matrix and summed
between the texts' offsets, CHUNK characters at once.

Defined results: null texts and texts without a letter (Unicode's categories
L*) are ``und`` with score 0; without any labelled row every text is ``und``;
of equally likely languages the first by name is taken; repeated rows get equal
results and count once in the sample; a very long text is summed in pieces,
none left out; an empty table gives no row; columns named lang_pred or score
are replaced, others pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fitting import SAMPLE_CHARS, fit_once

BINS = 1 << 16
PER_LANG = 1500
#: Most languages; more are refused.
LANGS = 2000
#: Characters whose n-grams are scored at once.
CHUNK = 1 << 17


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)


def ngrams(text: str) -> np.ndarray:
    return _bins(_codes(text), len(text.lower()))


def _bins(a: np.ndarray, n: int) -> np.ndarray:
    """The bins of the n-grams that begin at one of the first n characters."""
    m = np.uint32(0x9E3779B1)
    b = a * np.uint32(0x85EBCA6B) + np.uint32(1)
    two = b[:-1] * m + b[1:]
    three = two[:-1] * m + b[2:]
    h = np.concatenate([b[:n], two[:n], three[:n]])
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def fit(data: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities of the bins and log-priors; data has n, the language's training rows."""
    langs = sorted(set(data["lang"]))
    counts = np.zeros((BINS, len(langs)))
    rows = np.zeros(len(langs))
    for text, lang, n in zip(data["text"], data["lang"], data["n"], strict=True):
        rows[langs.index(lang)] = n
        if isinstance(text, str):
            counts[:, langs.index(lang)] += np.bincount(ngrams(text), minlength=BINS)
    p = (counts + 0.1) / (counts.sum(0) + 0.1 * BINS)
    return langs, np.log(p).astype(np.float32), np.log(rows / max(rows.sum(), 1))


def train(docs: DataFrame):
    rows = docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGS + 1)
    if counts.count() > LANGS:
        raise ValueError(f"more than {LANGS} languages")
    part = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.join(F.broadcast(counts), "lang").filter((part * F.col("n") < float(PER_LANG)) & (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS))
    return fit_once(sample.select("doc_id", "lang", "text", "n").distinct(), fit)


def log_scores(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """(text, language): the sums of the log-probabilities of all n-grams of each text."""
    out = np.zeros((len(texts), logp.shape[1]))
    rows, parts, held = [], [], 0

    def add() -> None:
        if parts:
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            np.add.at(out, rows, np.add.reduceat(logp[np.concatenate(parts)], at, axis=0, dtype=np.float64))
            rows.clear()
            parts.clear()

    for k, t in enumerate(texts):
        a = _codes(t)
        for lo in range(0, len(a), CHUNK):
            n = min(CHUNK, len(a) - lo)
            rows.append(k)
            parts.append(_bins(a[lo : lo + n + 2], n))
            held += n
            if held >= CHUNK:
                add()
                held = 0
    add()
    return out


def predict(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        langs, logp, prior = model.value
        names, score = ["und"] * len(text), np.zeros(len(text))
        some = [k for k, t in enumerate(text) if langs and isinstance(t, str) and any(map(str.isalpha, t))]
        if some:
            x = log_scores([text.iloc[k] for k in some], logp) + prior
            best = x.argmax(1)
            score[some] = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
            for k, b in zip(some, best, strict=True):
                names[k] = langs[b]
        return pd.DataFrame({"lang_pred": names, "score": score})

    return docs.withColumn("__el_l", of(F.col(text_col))).withColumn("lang_pred", F.col("__el_l.lang_pred")).withColumn("score", F.col("__el_l.score")).drop("__el_l")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
