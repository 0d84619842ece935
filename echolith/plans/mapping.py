"""The library's entities drawn from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions.scalars import US, micros

CLASSES = ["C1", "C2", "C3"]
TYPES = ["click", "whistle", "other"]
CALL_US = 300 * US


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections_of(read(spark, sf_dir, "events"))


def detections_of(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "whistle").otherwise("other")
    start = micros("ts")
    return events.select(
        F.col("event_id").alias("detection_id"), F.col("user_id").alias("grp"), start.alias("t_us"), (start + (F.col("event_id") % 10 + 1) * US).alias("end_us"),
        kind.alias("voc_type"), "event_type", "value", "props",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).filter("event_type = 'purchase'")
    return d.select(F.col("detection_id").alias("call_id"), F.col("t_us").alias("c_start"), (F.col("t_us") + CALL_US).alias("c_end"), F.concat(F.lit("L"), F.col("detection_id") % 4).alias("call_label"))


def _weights() -> list:
    return [((F.col("detection_id") * (7 + 6 * k) + F.col("grp") * 3) % 97) + 1 for k in (1, 2, 3)]


def wide_of(d: DataFrame) -> DataFrame:
    """The class probabilities of detections as columns."""
    w = _weights()
    return d.select("detection_id", "grp", "t_us", "voc_type", *((x / (w[0] + w[1] + w[2])).alias(c) for c, x in zip(CLASSES, w, strict=True)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table; the three class weights of a detection lie side by side, so it needs no shuffle."""
    d, w = detections(spark, sf_dir), _weights()
    total = w[0] + w[1] + w[2]
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (x / total).alias("probability")) for c, x in zip(CLASSES, w, strict=True))))
    return d.select("detection_id", "grp", "t_us", "voc_type", F.concat(F.lit("C"), 1 + F.col("grp") % 3).alias("true_class"), rows.alias("_p")).select("*", "_p.class", "_p.probability").drop("_p")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.groupBy("detection_id", "grp", "t_us", "voc_type", "true_class").pivot("class", CLASSES).agg(F.first("probability"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a cluster, a unit (day of the number) and a label, from the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding", (F.col("vec_id") % 8).alias("cluster"), (F.col("vec_id") % 5).alias("unit"), F.col("label").cast("long").alias("label"))


EV = """ev AS (SELECT event_id AS detection_id, user_id AS grp, epoch_us(ts) AS t_us, epoch_us(ts) + (event_id % 10 + 1) * 1000000 AS end_us,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'whistle' ELSE 'other' END AS voc_type, event_type, value, props FROM events)"""
CALLS = EV + """, calls AS (SELECT detection_id AS call_id, t_us AS c_start, t_us + 300000000 AS c_end, 'L' || (detection_id % 4) AS call_label FROM ev WHERE event_type = 'purchase')"""
PRED = EV + """, pw AS (SELECT ev.*, 'C' || (1 + grp % 3) AS true_class, (detection_id * 13 + grp * 3) % 97 + 1 AS w1, (detection_id * 19 + grp * 3) % 97 + 1 AS w2, (detection_id * 25 + grp * 3) % 97 + 1 AS w3 FROM ev),
wide AS (SELECT detection_id, grp, t_us, voc_type, true_class, w1 / (w1 + w2 + w3) AS C1, w2 / (w1 + w2 + w3) AS C2, w3 / (w1 + w2 + w3) AS C3 FROM pw),
pred AS (SELECT detection_id, grp, t_us, voc_type, true_class, 'C1' AS class, C1 AS probability FROM wide UNION ALL SELECT detection_id, grp, t_us, voc_type, true_class, 'C2', C2 FROM wide UNION ALL SELECT detection_id, grp, t_us, voc_type, true_class, 'C3', C3 FROM wide)"""
EVENTS_PRED = PRED + """, es AS (SELECT grp, sum(C1) AS a, sum(C2) AS b, sum(C3) AS c, count(*) AS n_detections, min(true_class) AS true_class FROM wide GROUP BY grp),
ep AS (SELECT grp, a / (a + b + c) AS C1, b / (a + b + c) AS C2, c / (a + b + c) AS C3, n_detections, true_class FROM es),
e AS (SELECT *, CASE WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END AS predicted,
  list_reverse_sort([C1, C2, C3])[1] * (list_reverse_sort([C1, C2, C3])[1] - list_reverse_sort([C1, C2, C3])[2]) AS score FROM ep)"""
CL = "cl AS (SELECT vec_id, embedding, vec_id % 8 AS cluster, vec_id % 5 AS unit, CAST(label AS BIGINT) AS label FROM embeddings)"
