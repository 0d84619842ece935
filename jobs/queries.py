"""The jobs as queries: each runs twice into one new folder, so that the second run must leave the result as it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from echolith.plans import mapping as M
from echolith.sources.durable import shared_folder
from jobs import live_blocks, training_selection


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_training_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "training-selection")
    for _ in range(2):
        rows = training_selection.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return rows


def job2_live_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "live-blocks")
    for _ in range(2):
        rows = live_blocks.run(spark, f"{sf_dir}/events.parquet", out)
    return rows.select("day", "grp", "block_us", *M.CLASSES, "n_detections", "score", "decision")


QUERIES = {"job1_training_selection": job1_training_selection, "job2_live_blocks": job2_live_blocks}

_SCORE = "list_reverse_sort([C1, C2, C3])[1] * (list_reverse_sort([C1, C2, C3])[1] - list_reverse_sort([C1, C2, C3])[2])"
ORACLE_SQL = {
    "job1_training_selection": r"""WITH l AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1),
r AS (SELECT md5(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5, d.doc_id, coalesce(source, 'n/a') AS source, coalesce(lang, 'n/a') AS lang,
  CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END || CASE WHEN toxic = 1 THEN '_toxic' ELSE '' END AS label, CAST(length(text) AS BIGINT) AS n_chars FROM documents d JOIN l USING (doc_id) WHERE text IS NOT NULL),
u AS (SELECT *, count(*) OVER (PARTITION BY text_md5) AS n_copies FROM r QUALIFY row_number() OVER (PARTITION BY text_md5 ORDER BY doc_id, source, lang, label, n_chars) = 1),
e AS (SELECT * FROM u WHERE label IN (SELECT label FROM u GROUP BY label HAVING count(DISTINCT source) >= 2)),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, text_md5) <= 50),
g AS (SELECT source, min(label) AS gl FROM k GROUP BY source), s AS (SELECT *, row_number() OVER (PARTITION BY gl ORDER BY md5(source), source) AS seat FROM g),
b AS (SELECT gl, coalesce(sum(n) OVER (ORDER BY gl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT gl, count(*) AS n FROM s GROUP BY gl))
SELECT k.doc_id, text_md5, lang, k.source, n_chars, n_copies, CAST((before + seat - 1) % 5 AS INTEGER) AS fold, label FROM k JOIN s ON k.source = s.source JOIN b ON s.gl = b.gl""",
    "job2_live_blocks": f"""WITH {M.PRED},
t AS (SELECT grp, t_us // 21600000000 * 21600000000 AS block_us, voc_type, avg(C1) AS a, avg(C2) AS b, avg(C3) AS c, count(*) AS n FROM wide WHERE t_us IS NOT NULL GROUP BY ALL),
x AS (SELECT grp, block_us, avg(a / (a + b + c)) AS p1, avg(b / (a + b + c)) AS p2, avg(c / (a + b + c)) AS p3, CAST(sum(n) AS BIGINT) AS n_detections FROM t GROUP BY ALL),
y AS (SELECT grp, block_us, round(p1, 6) AS C1, round(p2, 6) AS C2, round(p3, 6) AS C3, n_detections FROM x)
SELECT strftime(make_timestamp(block_us), '%Y%m%d') AS day, grp, block_us, C1, C2, C3, n_detections, round({_SCORE}, 6) AS score,
CASE WHEN round({_SCORE}, 6) < 0.05 THEN 'uncertain' WHEN C1 >= C2 AND C1 >= C3 THEN 'C1' WHEN C2 >= C3 THEN 'C2' ELSE 'C3' END AS decision FROM y""",
}
