"""Queries that fit, cluster or transform signals; no SQL gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from echolith.operators import acoustics, clusters, density, features, models, network, recluster
from echolith.functions.scalars import US
from echolith.operators.predictions import block_vectors, cap_per_group

from . import mapping as M

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def forest_cross_validation(spark, d):
    """Leave one group out: forests on the capped rows of the other groups, every row of the group scored."""
    params = models.ForestParams(trees=30, batch=10, max_per_group=300)
    li = M.read(spark, d, "lineitem").withColumn("g", (F.col("l_suppkey") % 4).cast("int")).withColumn("gl", F.concat_ws("@", "g", "l_returnflag"))
    train = cap_per_group(li, "gl", [F.xxhash64("l_orderkey", "l_linenumber")], params.max_per_group)
    folds = [0, 1, 2, 3]
    fitted = models.fit_folds(train, _FEATURES, "l_returnflag", "g", folds, params)
    out = models.predict(li, fitted, _FEATURES, "g")
    return out.groupBy("g", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("l_returnflag")).alias("n_correct"))


def cluster_verdicts(spark, d):
    c = M.clustered(spark, d).withColumn("yes", F.col("label") % 2 == 0)
    return clusters.binary_verdicts(c, "cluster", "unit", "yes")


def unit_clusters(spark, d):
    """Clusters of all units, of a pool as large as all pairs allow first."""
    e = M.read(spark, d, "embeddings")
    return clusters.cluster_units(e, "vec_id", "embedding", 0.7, 5)


def contour_shapes(spark, d):
    """Measures of contours made of each vector: frequencies about 8 kHz, a point each 10.7 ms."""
    e = M.read(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x, i: i * 0.0107).alias("times"), F.transform("embedding", lambda x: 8000 + 4000 * x.cast("double")).alias("freqs"), F.lit(0.0107).alias("s")
    )
    return e.withColumn("m", acoustics.contour_column("times", "freqs", "s")).select("vec_id", "m.*").filter("duration_s IS NOT NULL")


def click_spectra(spark, d):
    e = M.read(spark, d, "embeddings").select("vec_id", F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("waves"))
    return e.select("vec_id", acoustics.click_spectrum_column("waves", 128).alias("level")).filter("level IS NOT NULL").select("vec_id", F.posexplode("level").alias("bin", "db"))


def click_measures(spark, d):
    e = M.read(spark, d, "embeddings").select("vec_id", acoustics.click_measures_column("embedding", 96_000.0).alias("m"))
    return e.select("vec_id", "m.*").filter("peak_hz IS NOT NULL")


def _sounds(spark, d):
    """Each vector as the contour, and the click, of a detection: 64 points 1024 samples apart."""
    start = F.col("vec_id") * F.lit(300_000)
    return M.read(spark, d, "embeddings").select(
        F.col("vec_id").alias("contour_id"), (F.col("vec_id") % 5).alias("event"), start.alias("start_us"), (start + 680_000).alias("end_us"),
        F.transform("embedding", lambda x, i: i / 96.0).alias("times"), F.transform("embedding", lambda x: 8000 + 4000 * x.cast("double")).alias("freqs"), F.col("embedding").alias("wave"),
    )


def _long_features(df):
    return df.select(*(c for c in df.columns if c != "features"), F.posexplode("features").alias("bin", "share")).withColumn("share", F.round("share", 6))


def whistle_frames(spark, d):
    return _long_features(features.whistle_frames(_sounds(spark, d), "event", 4 * US, 4 * US)).withColumn("density", F.round("density", 6)).filter("share > 0")


def click_frames(spark, d):
    return _long_features(features.click_frames(_sounds(spark, d), "event", 4 * US, 4 * US, 96_000.0, fft_len=128))


def window_features(spark, d):
    s = _sounds(spark, d)
    low, high = F.array_min("freqs"), F.array_max("freqs")
    s = s.withColumns({"duration_s": F.lit(0.68), "snr_db": F.col("contour_id") % 7, "slice_s": F.lit(1 / 96.0), "min_freq_hz": low, "max_freq_hz": high})
    s = s.withColumn("points", F.zip_with("times", "freqs", lambda t, f: F.struct(t.alias("t"), f.alias("f"))))
    w = s.groupBy(F.floor(F.col("start_us") / (4 * US)).alias("window")).agg(F.count("*").alias("_n")).select("window", (F.col("window") * 4 * US).alias("w_start"), ((F.col("window") + 1) * 4 * US).alias("w_end"))
    out = features.window_features(w, s, "window", ("w_start", "w_end"), ["min_freq_hz", "max_freq_hz"], 4 * US, bins=4)
    return out.withColumns({c: F.round(c, 4) for c, t in out.dtypes if t == "double"})


def stacked_cross_validation(spark, d):
    """Forests over block vectors of two detectors, leaving one group of events out."""
    types = ["click", "whistle"]
    p = M.predictions(spark, d).withColumn("block_us", F.col("t_us") - F.pmod("t_us", F.lit(86_400 * US)))
    truth = p.groupBy("grp", "block_us").agg(F.mode("true_class", True).alias("truth"))
    v = block_vectors(p, [F.col("grp"), F.col("block_us")], types, M.CLASSES).join(truth, ["grp", "block_us"])
    names = [f"f{k}" for k in range(len(types) * (len(M.CLASSES) + 1))]
    v = v.select("grp", "block_us", "truth", *(F.col(f"`{c}`").cast("double").alias(n) for n, c in zip(names, [f"{t}|{c}" for t in types for c in M.CLASSES] + [f"has_{t}" for t in types], strict=True)))
    v = v.withColumn("fold", (F.xxhash64("grp") % 4 + 4).cast("int") % 4).withColumn("gl", F.concat_ws("@", "fold", "truth"))
    params = models.ForestParams(trees=20, batch=10, node_size=5, max_per_group=200)
    train = cap_per_group(v, "gl", [F.xxhash64("grp", "block_us"), F.col("grp"), F.col("block_us")], params.max_per_group)
    out = models.predict(v, models.fit_folds(train, names, "truth", "fold", [0, 1, 2, 3], params), names, "fold")
    return out.groupBy("fold", "truth").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("n_correct"))


def _frames(spark, d):
    """Each vector is a frame of one of the groups of its label."""
    e = M.read(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return e.withColumn("grp", F.concat_ws("_", "label", F.col("vec_id") % 7))


def _folded(spark, d):
    f = _frames(spark, d)
    return f.join(network.group_folds(f, "label", "grp", 3), "grp")


def grouped_folds(spark, d):
    return network.group_folds(_frames(spark, d), "label", "grp", 3)


def bootstrap_rows(spark, d):
    """Capped, balanced rows of each fold and bootstrap with their validation mark."""
    out = network.bootstraps(_folded(spark, d), "vec_id", "label", "grp", "fold", [0, 1, 2], network.ResamplingParams(max_per_group=20, bootstraps=2))
    return out.select("held_out", "bootstrap", "vec_id", "label", "validation")


def pruned_rows(spark, d):
    """Rows of each class without the tenth that lies farthest from its centre in the main plane."""
    li = density.prune_outliers(M.read(spark, d, "lineitem"), _FEATURES, "l_returnflag", 0.1)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"))


def outlying_units(spark, d):
    """Clusters without the units whose nearest member in another block is too far."""
    e = M.read(spark, d, "embeddings")
    units = e.select("vec_id", "embedding", F.col("label").alias("cluster"), (F.col("vec_id") % 9).alias("block"))
    return density.outlying(units, "cluster", "block", "vec_id", "embedding").select("vec_id", "cluster")


def network_cross_validation(spark, d):
    """Groups dealt over three folds; networks learn on capped, balanced bootstraps of the other folds."""
    resampling = network.ResamplingParams(max_per_group=20, bootstraps=2)
    f = _folded(spark, d)
    samples = network.bootstraps(f, "vec_id", "label", "grp", "fold", [0, 1, 2], resampling)
    scored, _ = network.cross_validate(f, "vec_id", "label", "fold", samples, "x", network.NetworkParams(epochs=6, batch=8, rate=2e-3))
    return scored.groupBy("fold", "label").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("n_correct"))


def density_clusters(spark, d):
    """Map and density clusters of all units, of a pool as large as all pairs allow first."""
    e = M.read(spark, d, "embeddings")
    wide = e.select("vec_id", *(F.get("embedding", F.lit(k)).alias(f"f{k}") for k in range(16)))
    return density.map_and_cluster(wide, "vec_id", [f"f{k}" for k in range(16)], 0.95, 15, 5)


def hybrid_clusters(spark, d):
    """Clusters of all units on features weighted by their labels, of a pool as large as all pairs allow first."""
    e = M.read(spark, d, "embeddings")
    units = e.select("vec_id", "embedding", F.when(F.col("vec_id") % 3 > 0, F.col("label").cast("string")).alias("label"), (F.col("vec_id") % 9).alias("block"))
    return recluster.hybrid_clusters(units, "vec_id", "embedding", "label", "block", recluster.HybridParams(cut=0.8, least=5, trees=30))


def leave_out_reclustered(spark, d):
    """Two detectors' units, clustered anew without each day, predicted by forests of the other days."""
    e = M.read(spark, d, "embeddings")
    units = e.select(
        F.when(F.col("vec_id") % 2 == 0, "click").otherwise("whistle").alias("detector"), (F.col("vec_id") % 5).alias("unit"), F.col("label").alias("block"), "embedding",
        F.concat(F.lit("L"), F.col("label") % 3).alias("label"),
    )
    out = recluster.leave_out_reclustered(units, "detector", "unit", "block", "embedding", "label", recluster.HybridParams(cut=0.8, least=5, trees=15), trees=30)
    return out.groupBy("unit", "truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("n_correct"))


def new_class_candidates(spark, d):
    c = M.clustered(spark, d).withColumn("labelled", (F.col("vec_id") % 8 != 3) & (F.col("label") < 8))
    return density.candidate_new(c, "cluster", "labelled", "unit", 5)


QUERIES = {f.__name__: f for f in (forest_cross_validation, cluster_verdicts, unit_clusters, contour_shapes, click_spectra, network_cross_validation, density_clusters, new_class_candidates, grouped_folds, bootstrap_rows, pruned_rows, outlying_units, click_measures, whistle_frames, click_frames, window_features, stacked_cross_validation, hybrid_clusters, leave_out_reclustered)}
_FOLDS = """f AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, label || '_' || (vec_id % 7) AS grp FROM embeddings),
gl AS (SELECT DISTINCT grp, label FROM f), fd AS (SELECT grp, CAST((row_number() OVER (ORDER BY label, md5(grp), grp) - 1) % 3 AS INTEGER) AS fold FROM gl)"""

_SOUNDS = """WITH c AS (SELECT vec_id AS id, vec_id % 5 AS event, vec_id * 300000 AS s, vec_id * 300000 + 680000 AS e, [8000 + 4000 * CAST(v AS DOUBLE) FOR v IN embedding] AS freqs FROM embeddings)"""

SQL: dict[str, str] = {
    "whistle_frames": f"""{_SOUNDS}, b AS (SELECT *, min(s) OVER (PARTITION BY event) AS t0, max(e) OVER (PARTITION BY event) AS t1 FROM c),
m AS (SELECT DISTINCT id, event, s, freqs, t0, k AS frame FROM (SELECT *, unnest([(s - t0) // 4000000, (e - t0) // 4000000]) AS k FROM b) WHERE t0 + k * 4000000 < t1),
n AS (SELECT event, frame, count(*) AS n, sum(len(freqs)) / 384.0 AS density FROM m GROUP BY ALL),
p AS (SELECT event, frame, s - t0 - frame * 4000000 AS off, unnest(range(0, 64)) AS i, unnest(freqs) AS f FROM m),
h AS (SELECT event, frame, CAST(floor((f - 2000) / 100) AS INTEGER) // 2 AS bin, count(*) AS c FROM p WHERE off / 1000000.0 + i / 96.0 >= 0 AND f >= 2000 AND f < 20000 GROUP BY ALL)
SELECT event, CAST(frame AS BIGINT) AS frame, t0 + frame * 4000000 AS frame_start, n AS n_detections, round(density, 6) AS density, bin, round(c / sum(c) OVER (PARTITION BY event, frame), 6) AS share
FROM h JOIN n USING (event, frame) JOIN (SELECT DISTINCT event, t0 FROM b) USING (event) WHERE density >= 0.05""",
    "window_features": f"""{_SOUNDS}, w AS (SELECT DISTINCT s // 4000000 AS win FROM c),
p AS (SELECT win, id, s, freqs, list_min(freqs) AS lo, list_max(freqs) AS hi FROM w JOIN c ON s < (win + 1) * 4000000 AND e > win * 4000000),
a AS (SELECT win, count(*) AS n_contours, avg(id % 7) AS snr_db_mean, avg(lo) AS l, stddev_samp(lo) AS ls, avg(hi) AS h, stddev_samp(hi) AS hs, arg_min(lo, s) AS ll, arg_min(hi, s) AS lh FROM p GROUP BY win),
x AS (SELECT win, f FROM (SELECT win, s + CAST(floor(i / 96.0 * 1000000) AS BIGINT) AS t, f FROM (SELECT win, s, unnest(range(0, 64)) AS i, unnest(freqs) AS f FROM p)) WHERE t >= win * 4000000 AND t < (win + 1) * 4000000),
g AS (SELECT win, count(*) / 96.0 AS tonal, avg(f) AS m, stddev_samp(f) AS sd, quantile_cont(f, 0.1) AS q1, quantile_cont(f, 0.9) AS q9, count(*) FILTER (f < 4600) / count(*) AS b0, count(*) FILTER (f >= 4600 AND f < 8400) / count(*) AS b1, count(*) FILTER (f >= 8400 AND f < 12200) / count(*) AS b2, count(*) FILTER (f >= 12200) / count(*) AS b3 FROM x GROUP BY win)
SELECT win AS "window", win * 4000000 AS w_start, (win + 1) * 4000000 AS w_end, n_contours, round(snr_db_mean, 4) AS snr_db_mean, round(l, 4) AS min_freq_hz_mean, round(h, 4) AS max_freq_hz_mean, round(ls, 4) AS min_freq_hz_std, round(hs, 4) AS max_freq_hz_std,
0.68 AS lc_duration_s, round(ll, 4) AS lc_min_freq_hz, round(lh, 4) AS lc_max_freq_hz, round(tonal, 4) AS tonal_s, round(m, 4) AS pts_mean_freq_hz, round(sd, 4) AS pts_std_freq_hz, round(b0, 4) AS prof_800_4600, round(b1, 4) AS prof_4600_8400, round(b2, 4) AS prof_8400_12200, round(b3, 4) AS prof_12200_16000,
round(q1, 4) AS pts_q10_hz, round(q9, 4) AS pts_q90_hz, round(tonal / 4, 4) AS occupancy FROM a JOIN g USING (win) WHERE n_contours >= 2""",
    "grouped_folds": f"WITH {_FOLDS} SELECT grp, fold FROM fd",
    "bootstrap_rows": f"""WITH {_FOLDS}, b AS (SELECT f.*, fold, bootstrap, md5(vec_id || ':' || bootstrap) AS o FROM f JOIN fd USING (grp), (SELECT unnest([0, 1]) AS bootstrap)),
c AS (SELECT *, row_number() OVER (PARTITION BY bootstrap, grp ORDER BY o, vec_id) AS place FROM b QUALIFY place <= 20),
h AS (SELECT c.*, held_out FROM c, (SELECT unnest([0, 1, 2]) AS held_out) WHERE held_out <> fold),
n AS (SELECT held_out, bootstrap, label, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT held_out, bootstrap, min(n) AS least FROM n GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT label) FROM f)),
k AS (SELECT h.*, least, row_number() OVER (PARTITION BY held_out, bootstrap, label ORDER BY place, o, vec_id) AS seat FROM h JOIN m USING (held_out, bootstrap) QUALIFY seat <= least)
SELECT CAST(held_out AS INTEGER) AS held_out, CAST(bootstrap AS INTEGER) AS bootstrap, vec_id, label,
row_number() OVER (PARTITION BY held_out, bootstrap, label ORDER BY md5(vec_id || ':' || bootstrap || ':v'), vec_id) <= round_even(CAST(least * 0.33 AS DOUBLE), 0) AS validation FROM k""",
}
