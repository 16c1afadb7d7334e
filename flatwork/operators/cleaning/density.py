"""DBSCAN as joins and aggregates over a grid.

Cells have side eps / sqrt(d), so all points of a cell are within eps of each other. A cell with
`min_samples` points or more is dense: all its points are core, and no distance in it is ever
computed. Every other cell holds fewer than `min_samples` points, so arrays of such points stay
short. Two dense cells are compared by bounding boxes that are halved only while undecided.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.operators.cleaning.neighbours import with_standardised
from flatwork.operators.ordered import with_position
from flatwork.sources.checkpoints import cut_lineage

MAX_ROUNDS = 100


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _adjacent(cells: DataFrame, eps: float, side: float, dimensions: int) -> DataFrame:
    """Pairs of different occupied cells that can hold points within eps of each other."""
    reach, leading = math.ceil(math.sqrt(dimensions)), min(dimensions, 2)
    moved = cells.select("cell")
    for i in range(leading):
        own = F.get("cell", F.lit(i))
        moved = moved.withColumn(f"a{i}", F.explode(F.sequence(own - reach, own + reach)))
    others = cells.select(F.col("cell").alias("other"), *[F.get("cell", F.lit(i)).alias(f"a{i}") for i in range(leading)])
    pairs = moved.join(others, [f"a{i}" for i in range(leading)]).where(F.col("cell") != F.col("other"))
    gaps = F.zip_with("cell", "other", lambda p, q: F.pow(F.greatest(F.abs(p - q) - 1, F.lit(0)) * side, F.lit(2.0)))
    nearest_corner = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)
    return pairs.where(nearest_corner <= eps * eps * (1 + 1e-9)).select("cell", "other")


def _asks(points: DataFrame, links: DataFrame) -> DataFrame:
    """For each cell, the points of neighbouring sparse cells: a short array per cell."""
    sent = points.join(links, "cell").select(F.col("other"), F.struct("cell", "x").alias("q"))
    return sent.groupBy(F.col("other").alias("cell")).agg(F.collect_list("q").alias("asks"))


def _answers(points: DataFrame, asks: DataFrame, eps: float) -> DataFrame:
    """Each asked point with each point within eps of it."""
    met = points.join(asks, "cell")
    near = F.filter("asks", lambda q: _squared(q["x"], F.col("x")) <= eps * eps)
    return met.withColumn("q", F.explode(near))


def _dense_edges(points: DataFrame, pairs: DataFrame, eps: float, side: float, dimensions: int) -> DataFrame:
    """Which pairs of dense cells hold two points within eps. Boxes are split until each pair is decided."""
    decided = None
    open_pairs = pairs.where(F.col("cell") < F.col("other")).select("cell", "other", F.lit(None).cast("array<bigint>").alias("sub"), F.lit(None).cast("array<bigint>").alias("other_sub"))
    for level in range(MAX_ROUNDS):
        size = side / 2**level
        subs = points.withColumn("sub", F.transform("x", lambda v: F.floor(v / size)))
        corners = [F.min(F.get("x", F.lit(i))).alias(f"lo{i}") for i in range(dimensions)]
        corners += [F.max(F.get("x", F.lit(i))).alias(f"hi{i}") for i in range(dimensions)]
        boxes = subs.groupBy("cell", "sub").agg(*corners)
        boxes = boxes.select(
            "cell", "sub", F.array(*[f"lo{i}" for i in range(dimensions)]).alias("lo"), F.array(*[f"hi{i}" for i in range(dimensions)]).alias("hi")
        )
        parent = F.transform("sub", lambda s: F.floor(s / 2)) if level else F.lit(None).cast("array<bigint>")
        left = boxes.withColumn("up", parent)
        right = left.select(*[F.col(c).alias(f"o_{c}") for c in left.columns])
        both = (
            open_pairs.withColumnsRenamed({"sub": "up_a", "other_sub": "up_b"})
            .join(left, [F.col("up").eqNullSafe(F.col("up_a")), open_pairs["cell"] == left["cell"]])
            .drop(left["cell"])
            .join(right, [F.col("o_up").eqNullSafe(F.col("up_b")), F.col("other") == F.col("o_cell")])
        )
        apart = F.zip_with(
            F.zip_with("lo", "o_hi", lambda a, b: a - b), F.zip_with("o_lo", "hi", lambda a, b: a - b),
            lambda p, q: F.greatest(p, q, F.lit(0.0)),
        )
        across = F.zip_with(
            F.zip_with("hi", "o_lo", lambda a, b: a - b), F.zip_with("o_hi", "lo", lambda a, b: a - b),
            lambda p, q: F.greatest(p, q),
        )
        square = lambda c: F.aggregate(F.transform(c, lambda v: v * v), F.lit(0.0), lambda s, v: s + v)
        judged = both.select("cell", "other", "sub", F.col("o_sub").alias("other_sub"), square(apart).alias("near"), square(across).alias("far"))
        judged = cut_lineage(judged.where(F.col("near") <= eps * eps))
        sure = judged.where(F.col("far") <= eps * eps).select("cell", "other").distinct()
        decided = sure if decided is None else decided.unionByName(sure)
        open_pairs = cut_lineage(judged.join(sure, ["cell", "other"], "left_anti").drop("near", "far"))
        if open_pairs.isEmpty():
            return decided
        ends = open_pairs.select("cell").union(open_pairs.select("other")).distinct()
        points = cut_lineage(points.join(ends, "cell", "left_semi"))
    raise RuntimeError("Pairs of dense cells stayed undecided.")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: node, label (the smallest node of the component).

    Each round takes the smallest label around a node, then follows labels one step, so chains
    shrink by more than half. Rounds are written out, so lineage stays short.
    """
    both = edges.select(F.col("cell").alias("a"), F.col("other").alias("b"))
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select(F.col("cell").alias("node"), F.col("cell").alias("label")))
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.withColumnsRenamed({"node": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        lowered = labels.join(seen, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        ends = lowered.select(F.col("node").alias("via"), F.col("label").alias("end"))
        jumped = lowered.join(ends, F.col("label") == F.col("via"), "left").select(
            "node", "old", F.least("label", "end").alias("label")
        )
        step = cut_lineage(jumped)
        changed = not step.where(F.col("old") != F.col("label")).isEmpty()
        labels = step.drop("old")
        if not changed:
            return labels
    raise RuntimeError("Components did not settle.")


def dbscan(
    df: DataFrame, columns: Sequence[str], eps: float = 0.5, min_samples: int = 5, key: Sequence[str] | None = None
) -> DataFrame:
    """Density clusters on z-scores: cluster_label (-1 for noise) and anomaly_flag.

    Clusters are numbered from 0 by the smallest `key` of their core points (by position in space
    without a key). A point on the border of several clusters joins the lowest of them.
    """
    d, eps, need = len(columns), float(eps), int(min_samples)
    side = eps / math.sqrt(d)
    work = with_standardised(df, columns)
    order = F.struct(*[F.col(f"`{k}`") for k in key]) if key else F.struct(F.col("__x"))
    points = work.groupBy(F.col("__x").alias("x")).agg(F.count("*").alias("w"), F.min(order).alias("first_key"))
    points = cut_lineage(points.withColumn("cell", F.transform("x", lambda v: F.floor(v / side))))
    cells = cut_lineage(points.groupBy("cell").agg(F.sum("w").alias("held")).withColumn("dense", F.col("held") >= need))
    links = cut_lineage(_adjacent(cells, eps, side, d))

    tagged = points.join(cells, "cell")
    few = tagged.where(~F.col("dense"))
    counted = _answers(points, _asks(few, links), eps).groupBy(F.col("q.x").alias("x")).agg(F.sum("w").alias("around"))
    judged = few.join(counted, "x", "left").withColumn("core", F.col("held") + F.coalesce("around", F.lit(0)) >= need)
    columns_kept = ["x", "cell", "first_key", "dense"]
    core_few = judged.where("core").select(*columns_kept)
    core = cut_lineage(core_few.unionByName(tagged.where("dense").select(*columns_kept)))
    border = judged.where(~F.col("core")).select("x", "cell")

    # A sparse cell against any cell through short arrays; dense cells against each other by boxes.
    thin = core.where(~F.col("dense"))
    touching = _answers(core.select("x", "cell"), _asks(thin, links), eps)
    edges = touching.select(F.col("q.cell").alias("cell"), F.col("cell").alias("other")).distinct()
    thick = core.where("dense").select("x", "cell")
    full = cells.where("dense").select("cell")
    thick_pairs = links.join(full, "cell").join(full.withColumnRenamed("cell", "other"), "other").select("cell", "other")
    edges = edges.unionByName(_dense_edges(thick, thick_pairs, eps, side, d))
    labels = components(core.select("cell").distinct(), edges)

    named = core.join(labels, F.col("cell") == F.col("node")).drop("node")
    firsts = named.groupBy("label").agg(F.min("first_key").alias("k"))
    numbers = with_position(firsts, ["k"], out="cluster_label").select("label", "cluster_label")
    numbered = cut_lineage(named.join(numbers, "label").select("x", "cell", "cluster_label"))

    by_cell = numbered.groupBy("cell").agg(F.min("cluster_label").alias("cluster_label"))
    inside = border.join(by_cell, "cell").select("x", "cluster_label")
    reached = _answers(numbered, _asks(border, links), eps).select(F.col("q.x").alias("x"), "cluster_label")
    edge_labels = inside.unionByName(reached).groupBy("x").agg(F.min("cluster_label").alias("cluster_label"))
    found = numbered.select("x", "cluster_label").unionByName(edge_labels).withColumnRenamed("x", "__lx")
    joined = work.join(found, F.col("__x") == F.col("__lx"), "left").drop("__x", "__lx")
    labelled = joined.withColumn("cluster_label", F.coalesce("cluster_label", F.lit(-1)).cast("int"))
    return labelled.withColumn("anomaly_flag", (F.col("cluster_label") == -1).cast("int"))
