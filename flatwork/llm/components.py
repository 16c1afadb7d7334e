"""Connected components by alternating large and small stars, every round written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flatwork.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is linked with) for every node of the edges (a, b).

    A node with very many neighbours is a hot key: its minimum is combined before the shuffle, and the
    joins are plain inner joins, which Spark splits where they are skewed. The number of rounds grows with
    the logarithm of the longest path.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (seen["n"], seen["h"]) == last or not seen["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        last = (seen["n"], seen["h"])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = stored(small.select("e.*").where("a <> b").distinct())


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each item's smallest known companion, itself a fixed point) after joining items i and j."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != (again := labels[labels])).any():
            labels = again
