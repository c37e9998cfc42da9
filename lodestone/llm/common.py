"""What the operators of this subpackage share: scratch tables, packing of rows, components of a graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch, written

__all__ = ["components", "forest", "fresh", "partitions", "scratch", "written"]


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, lengthened until no column of the lists bears it, whatever its case."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs that join the same rows: each row with the smallest id of its group."""
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    more = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[more]], ids[more]


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``; component is the smallest id that links reach.

    Minimum labels travel along edges and along label pointers, so chains shorten
    geometrically. Labels are written at the end of each round; sums and joins are by node,
    with partial aggregation before the exchange, and large nodes are left to AQE's skew join.
    Loops, repeated edges and null ends are allowed (nulls are dropped).
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", "b"), what)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), what)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component")
        best = labels.union(near).groupBy("id").agg(F.min("component").alias("c"))
        jump = written(best, what)
        point = jump.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = written(jump.join(point, "c", "left").select("id", F.least("c", "up").alias("component")), what)
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
