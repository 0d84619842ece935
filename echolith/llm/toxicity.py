"""Toxicity: maximum-scoring segment search over token log-odds with Dirichlet priors.

Units are words and their prefixes of 3 to 8 letters, so inflected forms of a
stem count together. Each unit's log-odds between toxic and other texts has a
Dirichlet prior in proportion to its frequency; units whose z-score reaches
MIN_Z make up the lexicon, whose size the sample bounds. An occurrence counts
once for each distinct pair of neighbours, so copied texts don't vote many
times. All other words score OTHER. A linear scan finds all maximal segments;
their scores get extreme-value p-values by the length of the text, with lambda
solved from the word scores and the constant K, a bound that makes p-values
conservative (K fitted to the best scores of other texts is far less, and
held-out texts are then told apart worse); a logistic calibration maps the
text's evidence to 0..1.

The model is fit on a bounded sample (PER_CLASS labelled rows of each label, of
SAMPLE_CHARS characters at most) in one task and broadcast. Whole texts are
scored.

Defined results: null and empty texts have no segment and get the score of no
evidence; an empty table gives no row; repeated rows get equal scores; without
labels every score is the same; labels other than 0 and 1 are not read, of
several labels or texts of an id the least is learned from; a very long text
is one scan; of equal segments the earlier stays apart; columns named score or
passages are replaced, others pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fitting import LETTERS, Memo, fit_once, labelled_sample, sigmoid

PER_CLASS = 3000
PRIOR = 0.05
MIN_Z = 2.5
OTHER = -0.5
K = 0.5
SIGNIFICANT = 0.05


def units(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in range(3, min(len(word), 8) + 1))]


def _counts(texts: list[list[int]], n_words: int) -> np.ndarray:
    """Occurrences of each word id with distinct neighbours."""
    keys, ids = [], []
    for t in texts:
        a = np.array([0, *t, 0], np.uint64)
        keys.append((a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:])
        ids.append(a[1:-1].astype(np.int64))
    if not keys:
        return np.zeros(n_words + 1)
    _, first = np.unique(np.concatenate(keys), return_index=True)
    return np.bincount(np.concatenate(ids)[first], minlength=n_words + 1).astype(float)


def fit(data: pd.DataFrame) -> dict:
    ids: dict[str, int] = {}
    split = [[ids.setdefault(w, len(ids) + 1) for w in LETTERS.findall((t or "").lower())] for t in data["text"]]
    toxic = [t for t, y in zip(split, data["y"], strict=True) if y]
    other = [t for t, y in zip(split, data["y"], strict=True) if not y]
    both = np.stack([_counts(toxic, len(ids)), _counts(other, len(ids))])
    total = both.sum(1)
    by_unit: dict[str, list[float]] = {}
    for w, k in ids.items():
        for u in units(w):
            x = by_unit.setdefault(u, [0.0, 0.0])
            x[0] += both[0, k]
            x[1] += both[1, k]
    lexicon = {}
    if total.min() > 0:
        y = np.array(list(by_unit.values()))
        prior = PRIOR * y.sum(1)
        prior0 = PRIOR * total.sum()
        logit = lambda c, n: np.log((c + prior) / np.maximum(n + prior0 - c - prior, 1e-9))
        delta = logit(y[:, 0], total[0]) - logit(y[:, 1], total[1])
        z = delta / np.sqrt(1 / (y[:, 0] + prior) + 1 / (y[:, 1] + prior))
        names = list(by_unit)
        lexicon = {names[i]: float(delta[i]) for i in np.flatnonzero((z >= MIN_Z) & (delta > 1.5))}
    model = {"lexicon": lexicon, "lam": 1.0, "k": K, "a": 1.0, "b": -3.0}
    score = Memo(lambda w: max((lexicon[u] for u in units(w) if u in lexicon), default=OTHER), 10**7)
    values = np.array([score[w] for w in ids])
    weight = both[1, 1:] + 1e-3 * (both[0, 1:] > 0)
    if lexicon and weight.sum() > 0:
        low, high = 1e-3, 20.0
        for _ in range(60):  # sum of p * exp(lam * s) = 1
            mid = (low + high) / 2
            low, high = (mid, high) if (weight * np.exp(mid * values)).sum() < weight.sum() else (low, mid)
        model["lam"] = low
    x = np.array([evidence(LETTERS.findall((t or "").lower()), model, score)[0] for t in data["text"]])
    y = data["y"].to_numpy(float)
    if len(set(y)) == 2:
        w = np.array([model["b"], model["a"]])
        design = np.column_stack([np.ones_like(x), x])
        for _ in range(30):
            p = sigmoid(design @ w)
            hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
            w = w - np.linalg.solve(hess, design.T @ (p - y) + 1e-2 * w)
        model["b"], model["a"] = map(float, w)
    return model


def segments(values: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a text, in linear time.

    values: the positions and scores of the positive tokens; all between score OTHER.
    """
    stack: list[list] = []  # start, end, left sum, right sum
    total, last = 0.0, -1
    for at, v in values:
        total += OTHER * (at - last - 1)
        left, right = total, total + v
        total, last = right, at
        new = [at, at + 1, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(s[3] - s[2], s[0], s[1]) for s in stack]


def evidence(words: list[str], model: dict, score: Memo) -> tuple[float, list[tuple[float, int, int]]]:
    """Sum of -ln p over the significant passages (the best one counts anyway), and these passages."""
    hits = [(i, v) for i, v in enumerate([score[w] for w in words]) if v > 0]
    if not hits:
        return 0.0, []
    found, total, best = [], 0.0, 0.0
    room = model["k"] * max(len(words), 2)
    for s, start, end in segments(hits):
        e = room * math.exp(-min(model["lam"] * s, 700.0))
        p = -math.expm1(-e) if e < 50 else 1.0
        best = max(best, -math.log(max(p, 1e-300)))
        if p <= SIGNIFICANT:
            total += -math.log(max(p, 1e-300))
            found.append((s, start, end))
    return math.log1p(max(total, best)), found


_SCORES: dict[int, Memo] = {}


def scores(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with score, and passages: the significant ones as word ranges with their scores."""

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,score:double>>")
    def score(text: pd.Series) -> pd.DataFrame:
        m = model.value
        lexicon = m["lexicon"]
        memo = _SCORES.get(id(lexicon))
        if memo is None:
            _SCORES.clear()
            memo = _SCORES[id(lexicon)] = Memo(lambda w: max((lexicon[u] for u in units(w) if u in lexicon), default=OTHER), 300_000)
        out, spans = np.empty(len(text)), []
        for k, t in enumerate(text):
            x, found = evidence(LETTERS.findall((t or "").lower()), m, memo)
            out[k] = sigmoid(m["a"] * x + m["b"])
            spans.append([{"start": b, "end": e, "score": s} for s, b, e in found])
        return pd.DataFrame({"score": out, "passages": spans})

    return docs.withColumn("__el_s", score(F.col(text_col))).withColumn("score", F.col("__el_s.score")).withColumn("passages", F.col("__el_s.passages")).drop("__el_s")


def train(docs: DataFrame, labels: DataFrame):
    return fit_once(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, PER_CLASS), fit)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
