"""Writers: tables as Parquet or CSV, and models and libraries as tables with a manifest."""

from __future__ import annotations

import json
import math
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "echolith-library/1"


def plain(value: Any) -> Any:
    """A value of Python and JSON only: arrays become lists, numbers that are not finite become None."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_table(df: DataFrame, path: str, kind: str = "parquet", drop_prefix: tuple[str, ...] = ()) -> None:
    """df without the columns of some prefixes; CSV has a header, and arrays and maps as JSON."""
    df = df.drop(*(c for c in df.columns if drop_prefix and c.startswith(drop_prefix)))
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def ragged_union(tables: list[DataFrame], drop: tuple[str, ...] = ()) -> DataFrame:
    """All rows with the union of all columns; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.drop(*drop) for t in tables])


def save_library(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict) -> None:
    """Each table as Parquet below path, then the manifest, which marks the whole as complete."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"format": FORMAT, "tables": sorted(tables), **plain(manifest)}, sort_keys=True)
    spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_library(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest", wholetext=True).head()[0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"{path}: not of the format {FORMAT}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}, manifest


def forest_nodes(spark: SparkSession, models: dict) -> DataFrame:
    """The nodes of fitted forests, a row each: what fit_folds() gives, as a table that any program can read."""
    rows = [
        (None if fold is None else str(fold), k, i, int(t["left"][i]), int(t["right"][i]), int(t["feature"][i]), float(t["threshold"][i]), [float(p) for p in t["probs"][i]], int(t["size"][i]))
        for fold, (_, _, trees) in models.items() for k, t in enumerate(trees) for i in range(len(t["left"]))
    ]
    return spark.createDataFrame(rows, "fold string, tree int, node int, left int, right int, feature int, threshold double, probs array<double>, size long")


def save_forest(spark: SparkSession, path: str, fitted: tuple, features: list[str]) -> None:
    """One fitted forest: its nodes, classes and medians."""
    classes, medians, _ = fitted
    save_library(spark, path, {"nodes": forest_nodes(spark, {None: fitted})}, {"classes": list(classes), "medians": medians, "features": features})


def load_forest(spark: SparkSession, path: str) -> tuple[dict, list[str]]:
    """(models for predict(), features)."""
    tables, manifest = load_library(spark, path)
    nodes = tables["nodes"].orderBy("tree", "node").toPandas()
    trees = [
        {**{c: g[c].to_numpy() for c in ("left", "right", "feature", "threshold", "size")}, "probs": np.stack([np.asarray(p) for p in g["probs"]])}
        for _, g in nodes.groupby("tree", sort=True)
    ]
    medians = np.array([np.nan if m is None else m for m in manifest["medians"]], np.float32)
    return {None: (manifest["classes"], medians, trees)}, manifest["features"]
