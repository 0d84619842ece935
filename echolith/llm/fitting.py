"""Fitting on a bounded sample in one task, and the words that the classifiers read."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


class Memo(dict):
    """value for each distinct key, forgotten when there are too many."""

    def __init__(self, make: Callable, most: int = 1_000_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: Texts of more characters are not in a sample, so that its size in one task has a bound.
SAMPLE_CHARS = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int) -> DataFrame:
    """(doc_id, y, text): at most per_class training rows of each label, chosen by a hash of the id.

    The chosen ids have that proven bound, so they are broadcast. Of several labels
    of an id the least is taken, of several texts the least, so that a task that
    runs again gives the same rows.
    """
    rows = labels.filter(training & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    pick = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    whole = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    return whole.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit_once(sample: DataFrame, fit: Callable[[pd.DataFrame], object]):
    """fit() over the bounded sample, in one task; the model comes back and is broadcast."""

    columns = sample.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        data = pd.concat(got).sort_values(columns).reset_index(drop=True) if got else pd.DataFrame({c: [] for c in columns})
        yield pd.DataFrame({"model": [pickle.dumps(fit(data))]})

    row = sample.repartition(1).mapInPandas(run, "model binary").head()  # none where the sample has no partition
    model = pickle.loads(row[0]) if row else fit(pd.DataFrame({c: [] for c in columns}))
    return sample.sparkSession.sparkContext.broadcast(model)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


LETTERS = re.compile(r"[^\W\d_]+")
