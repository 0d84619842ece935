"""Shared pieces of the training-data operators: durable tables, row keys, folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a plain local session may go without the setting (tests); a temporary
    folder of this machine is then used.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="echolith-"))
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage and survives lost executors. The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def let(value: Column, body) -> Column:
    """Evaluate value once for each row and hand it to body, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns named __el_* are the operators' own; no input has them.

    Add __el_k: rows with the same id and text share it, and so share every result."""
    return docs.withColumn("__el_k", F.xxhash64(F.col(id_col), F.col(text_col)))


#: A key of more rows than this, and of more than 1 / KEYS of all rows, is dealt over several tasks.
ROWS = 2000
#: Most keys that are dealt so; their hashes are broadcast.
KEYS = 1 << 16


def heavy_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame | None:
    """(__el_h, __el_s): the hashes of the keys that are too frequent for a task, and into how many parts each goes.

    counts has one row for each key with its number of rows; it is read again
    where the result is used. At most KEYS keys can have more than 1 / KEYS of all
    rows, so the result has that proven bound.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).head()
    least = max(ROWS, (total or 0) // KEYS)
    if (most or 0) <= least:
        return None
    parts = F.least(F.ceil(F.col(n) / least), F.lit(1 << 20)).cast("int")
    return counts.filter(F.col(n) > least).groupBy(F.xxhash64(key).alias("__el_h")).agg(F.max(parts).alias("__el_s"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, key), where left's rows of a heavy key are dealt into parts by a hash of the columns ``by``.

    right's rows of a heavy key are repeated for each part. Keys with the hash of
    a heavy one are dealt alike on both sides, so no match is lost.
    """
    if heavy is None:
        return left.join(right, key, how)
    at = lambda df: df.withColumn("__el_h", F.xxhash64(key)).join(F.broadcast(heavy), "__el_h", "left").drop("__el_h")
    part = F.coalesce(F.pmod(F.xxhash64(*by, F.lit(7)), F.col("__el_s").cast("long")), F.lit(0))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("__el_s", F.lit(1)) - 1))
    rows = at(left).withColumn("__el_part", part.cast("int")).drop("__el_s")
    copies = at(right).withColumn("__el_part", parts).drop("__el_s")
    return rows.join(copies, [key, "__el_part"], how).drop("__el_part")
