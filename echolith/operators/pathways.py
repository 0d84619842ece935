"""Decisions in layers: a layer tells groups of classes apart, a group may have a layer of its own, to any depth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.functions import scalars as S

#: Decisions that end a path without adding to it.
OPEN = ("uncertain", "no_detections", "no_data", "n/a")


@dataclass(frozen=True)
class Layer:
    """groups: {group: its classes}; classes outside all groups are no evidence in this layer."""

    name: str
    groups: dict[str, tuple[str, ...]]
    min_score: float = 0.0
    children: dict[str, Layer] = field(default_factory=dict)


def layers(tree: Layer) -> Iterator[Layer]:
    yield tree
    for child in tree.children.values():
        yield from layers(child)


def check(tree: Layer, classes: list[str]) -> None:
    """Layer names differ, groups of a layer are disjoint and known, children hang on groups and divide their classes."""
    names = [layer.name for layer in layers(tree)]
    if len(set(names)) < len(names):
        raise ValueError("two layers have one name")
    for layer in layers(tree):
        held = [c for group in layer.groups.values() for c in group]
        if len(layer.groups) < 2 or len(set(held)) < len(held) or not set(held) <= set(classes):
            raise ValueError(f"layer {layer.name}: groups must be two or more, disjoint and of known classes")
        for group, child in layer.children.items():
            if group not in layer.groups or not {c for g in child.groups.values() for c in g} <= set(layer.groups[group]):
                raise ValueError(f"layer {child.name}: not within a group of {layer.name}")


def labels(value: Column, layer: Layer) -> Column:
    """The group of a class in this layer, else ``none``."""
    out = F.lit(None).cast("string")
    for group, held in layer.groups.items():
        out = F.coalesce(out, F.when(value.isin(*held), group))
    return F.coalesce(out, F.lit("none"))


def descend(df: DataFrame, tree: Layer, classes: list[str]) -> DataFrame:
    """df with a decision for each layer, ``path`` and ``decision``, the deepest confident one.

    Class probabilities are columns. A layer sees its own classes only, their
    sum made 1, and is ``n/a`` where its group was not decided; all layers are
    one projection.
    """
    check(tree, classes)

    def walk(layer: Layer, reached: Column) -> tuple[dict[str, Column], Column, Column]:
        sums = [sum((F.coalesce(F.col(c), F.lit(0.0)) for c in held[1:]), F.coalesce(F.col(held[0]), F.lit(0.0))) for held in layer.groups.values()]
        total = sum(sums[1:], sums[0])
        shares = [F.when(total > 0, s / total) for s in sums]
        own = S.decide(shares, list(layer.groups), layer.min_score)
        sure = reached & ~own.isin(*OPEN)
        columns = {layer.name: F.when(reached, own).otherwise("n/a")}
        path, decision = F.when(sure, own).otherwise(""), own
        for group, child in layer.children.items():
            at = sure & (own == group)
            below, deeper, last = walk(child, at)
            columns |= below
            path = F.when(at & (deeper != ""), F.concat(F.lit(f"{group} > "), deeper)).otherwise(path)
            decision = F.when(at & ~last.isin(*OPEN), last).otherwise(decision)
        return columns, path, decision

    columns, path, decision = walk(tree, F.lit(True))
    return df.withColumns({**columns, "path": path, "decision": decision})


def summaries(df: DataFrame, tree: Layer, truth: str) -> DataFrame:
    """(layer, n, n_decided, n_correct) of each layer over the rows that reach it and belong to one of its groups; one pass."""
    rows = [
        F.struct(F.lit(layer.name).alias("layer"), F.col(layer.name).alias("d"), labels(F.col(truth), layer).alias("t"))
        for layer in layers(tree)
    ]
    x = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("t <> 'none' AND d <> 'n/a'")
    decided = ~F.col("d").isin(*OPEN)
    return x.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(decided).alias("n_decided"), F.count_if(decided & (F.col("d") == F.col("t"))).alias("n_correct"))
