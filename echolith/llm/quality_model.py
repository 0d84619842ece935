"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Features of a text, hashed into BINS: words, word pairs, and n-grams up to
three of the words' shapes (runs of capitals, letters, digits and marks), each
as its share of the text's words, as well as words equal to their
predecessor. Training is sequential over a bounded sample of labelled rows
(PER_CLASS of each label) in one task; the weights (BINS floats) are
broadcast, and a score is a sparse dot product. Whole texts are read.

Defined results: a null or empty text has only the bias and gets its score; an
empty table gives no row; repeated rows get equal scores; without any labelled
row all weights are 0 and every score is 0.5; of several labels or texts of an
id the least is learned from; a score equal to the threshold passes; a very
long text is one row of features; a column named score is replaced, others pass
through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fitting import Memo, fit_once, labelled_sample, sigmoid

BINS = 1 << 18
PER_CLASS = 2500
EPOCHS = 4
THRESHOLD = 0.7
#: Shares are this many times as large, so that one word of a text can decide.
SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5

RUNS = re.compile(r"([^\W\d_]+)|(\d+)|([^\w\s]|_)\3*")


def _shape(word: str) -> str:
    out = []
    for letters, digits, mark in RUNS.findall(word):
        if letters:
            out.append("A" if letters.isupper() and len(letters) > 1 else "a")
        elif digits:
            out.append("0")
        else:
            out.append(mark)
    return "".join(out)


def _pair(word: str) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest("\0" + _shape(word))


def _bins(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(46)).astype(np.int64)


def features(text: str | None, memo: Memo) -> tuple[np.ndarray, int]:
    """The bins of all features of a text, with repetitions, and its number of words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0
    both = np.array([memo[w] for w in words], np.uint64)
    w, s = both[:, 0], both[:, 1]
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [w, s, w[:-1] * a + w[1:] * b, s[:-1] * a + s[1:] * b, (s[:-2] * a + s[1:-1]) * b + s[2:]]
    again = np.full(int((w[:-1] == w[1:]).sum()), 12345, np.uint64)
    return _bins(np.concatenate([*parts, again])), n


def fit(data: pd.DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    memo, rows = Memo(_pair), []
    for text, y in zip(data["text"], data["y"], strict=True):
        ids, n = features(text, memo)
        ids, counts = np.unique(ids, return_counts=True)
        rows.append((np.append(ids, BINS), np.append(SCALE * counts / max(n, 1), 1.0), float(y)))
    z, g2, w = np.zeros(BINS + 1), np.zeros(BINS + 1), np.zeros(BINS + 1)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            wi = np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2))
            w[i] = wi
            g = (sigmoid(wi @ x) - y) * x
            sigma = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA
            z[i] += g - sigma * wi
            g2[i] += g * g
    return w[:BINS].astype(np.float32), float(w[BINS])


def scores(docs: DataFrame, model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column of scores, in the place of one of its name."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        (w, bias), memo = model.value, _MEMO
        x = np.empty(len(text))
        for k, t in enumerate(text):
            ids, n = features(t, memo)
            x[k] = bias + (SCALE * float(w[ids].sum(dtype=np.float64)) / n if n else 0.0)
        return pd.Series(sigmoid(x))

    return docs.withColumn(out, score(F.col(text_col)))


_MEMO = Memo(_pair, 300_000)


def train(docs: DataFrame, labels: DataFrame):
    return fit_once(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, PER_CLASS), fit)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    return scores(docs, train(docs, labels), out="__el_score").filter(F.col("__el_score") >= THRESHOLD).select(*docs.columns)
