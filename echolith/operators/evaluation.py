"""Scores of predictions and of clusters against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.sources.durable import cut

from .clusters import MAX_UNITS

#: Groups that folds are dealt to one after another, in one task.
MAX_GROUPS = 20_000
#: Most cells of a table of clusters by labels, and most clusters that are sent to the executors.
MAX_CELLS = 1_000_000
MAX_CLUSTERS = 10_000


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, n, n_predicted, n_correct, recall, precision, f1) of each true label; a ratio without cases is 0.

    Rows without a prediction count as wrong, rows without a truth are left out.
    """
    x = df.filter(F.col(truth).isNotNull())
    sides = x.groupBy(truth, predicted).agg(F.count("*").alias("c"))
    same = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    rows = sides.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t")))).alias("s"), "c", same.alias("same"))
    n = rows.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.t") == 1, F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(F.col("s.t") == 0, F.col("c")).otherwise(0)).alias("n_predicted"),
        F.sum(F.when((F.col("s.t") == 1) & F.col("same"), F.col("c")).otherwise(0)).alias("n_correct"),
    ).filter("n > 0")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.withColumns({
        "recall": ratio(F.col("n_correct"), F.col("n")), "precision": ratio(F.col("n_correct"), F.col("n_predicted")),
        "f1": ratio(2 * F.col("n_correct"), F.col("n") + F.col("n_predicted")),
    })


def headline(scores: DataFrame) -> DataFrame:
    """(n, n_classes, balanced_accuracy, macro_f1, chance, skill) of class_scores(); skill is 0 at chance and 1 if all is right."""
    one = scores.agg(F.sum("n").alias("n"), F.count("*").alias("n_classes"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    chance = F.try_divide(F.lit(1.0), F.col("n_classes"))
    return one.withColumn("chance", chance).withColumn("skill", F.try_divide(F.col("balanced_accuracy") - F.col("chance"), 1 - F.col("chance")))


def balanced_folds(df: DataFrame, label: str, group: str, folds: int, at_once: int = MAX_GROUPS) -> DataFrame:
    """(group, fold): whole groups in folds whose shares of each label are as even as a greedy deal makes them.

    Groups come in order of how uneven their labels are; each goes where the
    labels' shares then vary least, to the smaller fold of equals. More than
    ``at_once`` groups are cut by a hash into parts of about as many, each dealt
    by a task of its own; then the parts' folds are put together, part by part,
    by the same rule, so no task holds the groups of more than one part.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("c")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string"), "c"))).alias("m"))
    counts = cut(counts)
    parts = -(-counts.count() // at_once)
    kind = df.schema[group].dataType.simpleString()

    def matrix(maps) -> np.ndarray:
        maps = [dict(m) for m in maps]
        labels = sorted({k for m in maps for k in m})
        return np.array([[m.get(k, 0) for k in labels] for m in maps], float)

    def cost(held: np.ndarray, total: np.ndarray, n: np.ndarray, k: int) -> tuple:
        held[k] += n
        out = (round(float((held / total).std(0).mean()), 12), held[k].sum(), k)
        held[k] -= n
        return out

    def deal(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(group).reset_index(drop=True)
        n = matrix(d["m"])
        total, held, fold = n.sum(0), np.zeros((folds, n.shape[1])), np.zeros(len(d), int)
        for i in np.argsort(-n.std(1), kind="stable"):
            fold[i] = min(cost(held, total, n[i], k) for k in range(folds))[2]
            held[fold[i]] += n[i]
        return pd.DataFrame({group: d[group], "fold": fold})

    def one(batches):
        if got := [b for b in batches if len(b)]:
            yield deal(pd.concat(got))

    if parts < 2:
        return counts.repartition(1).mapInPandas(one, f"`{group}` {kind}, fold int")

    def match(batches):
        got = [b for b in batches if len(b)]
        d = pd.concat(got).sort_values(["_part", "fold"]).reset_index(drop=True)
        n = matrix(d["m"])
        total, held = n.sum(0), np.zeros((folds, n.shape[1]))
        for part, rows in d.groupby("_part").groups.items():
            free, to = set(range(folds)), {}
            for i in sorted(rows, key=lambda i: (-n[i].sum(), i)):
                k = min(cost(held, total, n[i], k) for k in free)[2]
                free.remove(k)
                held[k] += n[i]
                to[int(d["fold"][i])] = k
            yield pd.DataFrame({"_part": part, "_own": list(to), "fold": list(to.values())})

    part = F.pmod(F.xxhash64(group, F.lit(11)), F.lit(parts)).cast("int")
    dealt = cut(counts.withColumn("_part", part).repartition(parts, "_part").groupBy("_part").applyInPandas(lambda k, d: deal(d).assign(_part=k[0]), f"`{group}` {kind}, fold int, _part int"))
    sums = dealt.join(counts.select(F.col(group).alias("_g"), F.explode("m").alias("l", "c")), F.col(group).eqNullSafe(F.col("_g"))).groupBy("_part", "fold", "l").agg(F.sum("c").alias("c"))
    sums = sums.groupBy("_part", "fold").agg(F.map_from_entries(F.collect_list(F.struct("l", "c"))).alias("m"))
    to = sums.repartition(1).mapInPandas(match, "_part int, _own int, fold int")
    return dealt.withColumnRenamed("fold", "_own").join(to, ["_part", "_own"]).select(group, "fold")


def _expected(a: int, b: int, n: int) -> float:
    """Mean of c/n ln(n c / (a b)) over the hypergeometric c; terms beyond 14 deviations of the mean are below rounding."""
    low, high = max(0, a + b - n), min(a, b)
    mean, spread = a * b / n, (a * b * (n - a) * (n - b) / (n * n * max(n - 1, 1))) ** 0.5
    c = np.arange(max(low, int(mean - 14 * spread) - 40), min(high, int(mean + 14 * spread) + 40) + 1, dtype=float)
    step = np.log((a - c[:-1]) * (b - c[:-1])) - np.log((c[:-1] + 1) * (n - a - b + c[:-1] + 1))
    p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(p - p.max())
    some = c > 0
    return float((p[some] * c[some] / n * np.log(n * c[some] / (a * b))).sum() / p.sum())


def adjusted_information(cells: np.ndarray) -> tuple[float, float, float]:
    """(mutual information, its mean by chance, adjusted mutual information) of a table of counts."""
    cells = cells[cells.sum(1) > 0][:, cells.sum(0) > 0]
    n, rows, columns = float(cells.sum()), cells.sum(1), cells.sum(0)
    if cells.shape in ((0, 0), (1, 1)) or (cells.shape[0] == cells.shape[1] == n):
        return 0.0, 0.0, 1.0
    i, j = np.nonzero(cells)
    mutual = float((cells[i, j] / n * np.log(n * cells[i, j] / (rows[i] * columns[j]))).sum())
    # equal margins have equal means
    (ra, rc), (ca, cc) = np.unique(rows, return_counts=True), np.unique(columns, return_counts=True)
    chance = sum(_expected(int(a), int(b), int(n)) * x * y for a, x in zip(ra, rc, strict=True) for b, y in zip(ca, cc, strict=True))
    entropy = lambda m: -float((m / n * np.log(m / n)).sum())
    room = (entropy(rows) + entropy(columns)) / 2 - chance
    room = np.copysign(max(abs(room), np.finfo(float).eps), room)
    return mutual, chance, (mutual - chance) / room


def mutual_information(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(n, mutual_information, by_chance, adjusted): one row, none for no rows; nulls of either column are left out.

    All rows are counted in Spark; the table of counts, of at most MAX_CELLS
    cells, is scored in one task. All but n are null for a single row.
    """
    cells = df.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(cluster).cast("string").alias("a"), F.col(label).cast("string").alias("b")).agg(F.count("*").alias("c"))

    def run(batches):
        got = [b for b in batches if len(b)]
        if not got:
            return
        d = pd.concat(got)
        if len(d) > MAX_CELLS or d["a"].nunique() * d["b"].nunique() > 20 * MAX_CELLS:
            raise ValueError(f"over {MAX_CELLS} cells")
        n = int(d["c"].sum())
        if n < 2:
            yield pd.DataFrame({"n": [n], "mutual_information": [None], "by_chance": [None], "adjusted": [None]})
            return
        table = np.zeros((d["a"].nunique(), d["b"].nunique()))
        table[np.unique(d["a"], return_inverse=True)[1], np.unique(d["b"], return_inverse=True)[1]] = d["c"]
        mutual, chance, adjusted = adjusted_information(table)
        yield pd.DataFrame({"n": [n], "mutual_information": [mutual], "by_chance": [chance], "adjusted": [adjusted]})

    return cells.limit(MAX_CELLS + 1).repartition(1).mapInPandas(run, "n long, mutual_information double, by_chance double, adjusted double")


def silhouettes(df: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """(key, cluster, silhouette) by cosine distance, over all rows and without pairs.

    The mean distance of a unit vector to a cluster is one less its product with
    the cluster's mean, so the sums of unit vectors of at most MAX_CLUSTERS
    clusters are all that a row is compared with. A cluster of one row has 0,
    as has everything if there is one cluster.
    """
    v = df.select(key, cluster, F.transform(vector, lambda x: x.cast("double")).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    u = v.select(key, cluster, F.transform("_v", lambda x: x / F.greatest(norm, F.lit(1e-9))).alias("_u"))
    parts = u.select(cluster, F.posexplode("_u").alias("k", "x")).groupBy(cluster, "k").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = parts.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda p: p["s"]).alias("s"), F.max("n").alias("n"))
    got = sums.orderBy(cluster).limit(MAX_CLUSTERS + 1).collect()
    if len(got) > MAX_CLUSTERS:
        raise ValueError(f"over {MAX_CLUSTERS} clusters")
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["s"] for r in got], float), np.array([r["n"] for r in got], float)))
    place = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(got) for x in (r[cluster], k))), F.col(cluster)) if got else F.lit(0)

    @F.pandas_udf("double")
    def score(x: pd.Series, at: pd.Series) -> pd.Series:
        s, n = shared.value
        if len(n) < 2 or not len(x):
            return pd.Series(np.zeros(len(x)))
        x, at = np.stack(x.to_numpy()).astype(float), at.to_numpy().astype(int)
        i = np.arange(len(x))
        far = n - x @ s.T  # sums of distances
        own = (far[i, at] - (1 - (x * x).sum(1))) / np.maximum(n[at] - 1, 1)
        mean = far / n
        mean[i, at] = np.inf
        other = mean.min(1)
        out = (other - own) / np.maximum(np.maximum(own, other), 1e-300)
        return pd.Series(np.where(n[at] > 1, out, 0.0))

    return u.select(key, cluster, score("_u", place).alias("silhouette"))


def label_silhouette(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(n, silhouette): mean over a pool of at most MAX_UNITS rows by Euclidean distance of standardised features; null if labels are no fewer than rows, no row for no rows."""
    from .density import standard_matrix

    def run(batches):
        got = [b for b in batches if len(b)]
        if not got:
            return
        d = pd.concat(got)
        if len(d) > MAX_UNITS:
            raise ValueError(f"over {MAX_UNITS} units: sample before scoring")
        names, at = np.unique(d[label], return_inverse=True)
        if len(names) < 2 or len(names) >= len(d):
            yield pd.DataFrame({"n": [len(d)], "silhouette": [None]})
            return
        x = standard_matrix(d[features].to_numpy(float))
        n, out = np.bincount(at).astype(float), np.zeros(len(d))
        for i in range(len(d)):
            far = np.bincount(at, np.sqrt(((x - x[i]) ** 2).sum(1)), len(n))
            own = far[at[i]] / max(n[at[i]] - 1, 1)
            far[at[i]] = np.inf
            other = (far / n).min()
            if n[at[i]] > 1:
                out[i] = (other - own) / max(own, other, 1e-300)
        yield pd.DataFrame({"n": [len(d)], "silhouette": [out.mean()]})

    rows = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias(label), *(F.col(f).cast("double").alias(f) for f in features))
    return rows.limit(MAX_UNITS + 1).repartition(1).mapInPandas(run, "n long, silhouette double")


def means_clusters(df: DataFrame, key: str, features: list[str], k: int, starts: int = 3, seed: int = 0) -> DataFrame:
    """(key, cluster): the k-means of the least cost among the starts, on standardised features, over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    x = df.select(key, *(F.col(f).cast("double").alias(f) for f in features))
    names = [f"_{f}" for f in features]
    x = Imputer(inputCols=features, outputCols=names, strategy="median").fit(x).transform(x)
    x = VectorAssembler(inputCols=names, outputCol="_x").transform(x)
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(x).transform(x)
    fits = [KMeans(k=k, featuresCol="_z", predictionCol="cluster", seed=seed + i).fit(x) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(x).select(key, "cluster")


def typical(df: DataFrame, cluster: str, key: str, distance: str, start: str, end: str, most: int = 3) -> DataFrame:
    """(cluster, rank, key): the nearest units to each cluster's centre that do not overlap in time.

    Each round takes the nearest unit that overlaps none taken before: one
    minimum a cluster, so no cluster is gathered in a task. Taken units, at
    most ``most`` a cluster, are joined back.
    """
    x = df.filter(F.col(cluster) != -1).select(cluster, F.struct(F.col(distance).alias("d"), F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e")).alias("u"))
    taken = x.groupBy(cluster).agg(F.array(F.min("u")).alias("t"))
    for _ in range(most - 1):
        free = ~F.exists("t", lambda p: (F.col("u.s") < p["e"]) & (p["s"] < F.col("u.e"))) & ~F.exists("t", lambda p: p["key"] == F.col("u.key"))
        more = x.join(taken, cluster).groupBy(cluster).agg(F.first("t").alias("t"), F.min(F.when(free, F.col("u"))).alias("u"))
        taken = more.select(cluster, F.when(F.col("u").isNotNull(), F.concat("t", F.array("u"))).otherwise(F.col("t")).alias("t"))
    return taken.select(cluster, F.posexplode("t").alias("k", "p")).select(cluster, (F.col("k") + 1).alias("rank"), F.col("p.key").alias(key))


def scorecard(df: DataFrame, key: str, unit: str, cluster: str, vector: str, label: str) -> DataFrame:
    """One row: n, n_units, n_clusters, unassigned, silhouette of assigned rows, adjusted mutual information with the label."""
    base = df.agg(
        F.count("*").alias("n"), F.countDistinct(unit).alias("n_units"), F.countDistinct(F.when(F.col(cluster) != -1, F.col(cluster))).alias("n_clusters"),
        F.avg(F.when(F.col(cluster) == -1, 1.0).otherwise(0.0)).alias("unassigned"),
    )
    held = df.filter(F.col(cluster) != -1)
    s = silhouettes(held, key, vector, cluster).agg(F.when(F.countDistinct(cluster) > 1, F.avg("silhouette")).alias("silhouette"))
    m = mutual_information(held, cluster, label).select("adjusted")
    return base.join(s, F.lit(True), "left").join(m, F.lit(True), "left")  # one row each


def leave_out_summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, coverage, balanced_accuracy, skill) of verdicts of two labels; undecided rows are wrong by half in the skill."""
    decided = F.coalesce(F.col(predicted) != "uncertain", F.lit(False))
    per = df.groupBy(truth).agg(F.count("*").alias("n"), F.count_if(decided).alias("d"), F.count_if(decided & (F.col(predicted) == F.col(truth))).alias("c"))
    recall, cover = F.try_divide("c", "d"), F.col("d") / F.col("n")
    per = per.withColumns({"r": recall, "gain": cover * F.coalesce(recall, F.lit(0.5)) + (1 - cover) * 0.5})
    return per.agg(F.sum("n").alias("n"), (F.sum("d") / F.sum("n")).alias("coverage"), F.avg("r").alias("balanced_accuracy"), ((F.avg("gain") - 0.5) / 0.5).alias("skill"))



def decision_windows(df: DataFrame, day: str, t_us: str, truth: str, predicted: str, labels: tuple[str, str], minutes: list[int]) -> DataFrame:
    """Held-out predictions of two labels as they are (``window``) and by clock-aligned blocks of a day: a row a label and an overall row.

    A block's prediction is the strict majority of its decided rows, its truth
    the more frequent label, the least of equals; rows whose prediction is
    neither label are undecided, those whose truth is neither are not read.
    Ratios without cases are null, as is an f1 with a part of 0; recalls, f1s
    and gains over both labels are averaged where they exist, and undecided
    rows are worth half in the skill.
    """
    yes, no = labels
    x = df.filter(F.col(truth).isin(yes, no)).select(F.col(day).alias("_d"), F.col(t_us).alias("_t"), F.col(truth).alias("_y"), F.when(F.col(predicted).isin(yes, no), F.col(predicted)).alias("_p"))
    single = x.select(F.lit("window").alias("decision_window"), "_y", "_p")
    wide = x.select("*", F.explode(F.array(*map(F.lit, minutes))).alias("_m"))
    n = lambda c, v: F.count_if(F.col(c) == v)
    blocks = wide.groupBy("_m", "_d", F.floor(F.col("_t") / (F.col("_m") * F.lit(60_000_000).cast("long"))).alias("_b")).agg(n("_y", yes).alias("ty"), n("_y", no).alias("tn"), n("_p", yes).alias("py"), n("_p", no).alias("pn"))
    true = F.when(F.col("ty") > F.col("tn"), yes).when(F.col("ty") < F.col("tn"), no).otherwise(min(labels))
    voted = blocks.select(F.concat("_m", F.lit("min")).alias("decision_window"), true.alias("_y"), F.when(F.col("py") > F.col("pn"), yes).when(F.col("py") < F.col("pn"), no).alias("_p"))
    both = single.unionByName(voted)
    aggs = [F.count("*").alias("n")]
    for k, v in enumerate(labels):
        is_true, said = F.col("_y") == v, F.coalesce(F.col("_p") == v, F.lit(False))
        aggs += [F.count_if(is_true).alias(f"n{k}"), F.count_if(is_true & F.col("_p").isNotNull()).alias(f"d{k}"), F.count_if(is_true & said).alias(f"c{k}"), F.count_if(said).alias(f"s{k}")]
    t = both.groupBy("decision_window").agg(*aggs)
    rows, recalls, f1s, gains = [], [], [], []
    none = F.lit(None).cast("double")
    for k, v in enumerate(labels):
        size, decided, right, called = (F.col(f"{a}{k}") for a in "ndcs")
        cover, recall, precision, accuracy = (F.try_divide(a, b) for a, b in ((decided, size), (right, size), (right, called), (right, decided)))
        f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))
        rows.append(F.struct(F.lit(v).alias("class"), size.alias("n_blocks"), cover.alias("coverage"), recall.alias("recall"), precision.alias("precision"), accuracy.alias("accuracy_when_predicted"), f1.alias("f1"), none.alias("skill")))
        recalls.append(recall)
        f1s.append(f1)
        gains.append(F.when(size > 0, cover * F.coalesce(accuracy, F.lit(0.5)) + (1 - cover) * 0.5))
    mean = lambda cs: F.try_divide(F.coalesce(cs[0], F.lit(0.0)) + F.coalesce(cs[1], F.lit(0.0)), cs[0].isNotNull().cast("int") + cs[1].isNotNull().cast("int"))
    decided, right = F.col("d0") + F.col("d1"), F.col("c0") + F.col("c1")
    rows.append(F.struct(
        F.lit("overall").alias("class"), F.col("n").alias("n_blocks"), F.try_divide(decided, F.col("n")).alias("coverage"), mean(recalls).alias("recall"), none.alias("precision"),
        F.try_divide(right, decided).alias("accuracy_when_predicted"), mean(f1s).alias("f1"), ((mean(gains) - 0.5) / 0.5).alias("skill"),
    ))
    return t.select("decision_window", F.inline(F.array(*rows)))
