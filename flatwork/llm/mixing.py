"""Operator 12: mixing sources to target weights by systematic sampling.

Every document has an expected number of copies: its source's target size over the source's size. These are
prefix-summed within the source, one random offset is added, and a document is taken once for each integer
boundary that its stretch of the sum crosses. Documents stand in order of size, so neighbours of like size
stand in for each other and the words taken miss a target by about the longest document at most.

Expected copies are whole multiples of 2^-32 and the sums exact decimals, so the result depends neither on the
partitioning nor on the order of additions, and reruns agree. A document is never taken more often than `cap`.

A null text has size 0, and null is a source of its own, the last one. A source without words, and a table
without any, has target 0 and gives nothing. Rows that share an id count each; equal rows are interchangeable.
An empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.llm.common import look_up, stored
from flatwork.operators.joins import one_row
from flatwork.operators.ordered import running_total, with_position

#: A word: anything between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns.
WORD = r"[^\x20\x09-\x0D]+"
#: One copy, in the units of expected copies.
COPY = 1 << 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Add `weight`: the sources by code point, null last, take the weights in turn."""
    placed = with_position(sources.withColumn("none", F.col("source").isNull()), ["none", "source"], out="place")
    weights = F.array(*[F.lit(int(w)).cast("long") for w in cycle])
    return placed.withColumn("weight", F.get(weights, F.col("place") % len(cycle))).drop("none", "place")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Add `target` to sources with their `source_size` and `weight` (a positive whole number).

    All sizes are shared by weight. A target stops at `cap` times its source's size, and the excess is
    shared by weight among the others until none is above: the targets are min(cap * size, level * weight)
    for the one level at which they add up. The sources are sorted by size for their weight; prefix sums say for
    each what the larger ones share when all smaller ones are full, and the first that is not full sets the level.
    """
    if cap < 1:
        raise ValueError("Targets that stop below the sizes cannot share them all.")
    whole = "decimal(38,0)"
    limit = (F.lit(int(cap)) * F.col("source_size")).cast(whole)
    named = sources.withColumns({"limit": limit, "ratio": F.col("source_size") / F.col("weight"), "none": F.col("source").isNull()})
    order = ["ratio", "none", "source"]
    summed = running_total(running_total(named, "limit", order, out="limits"), "weight", order, out="weights")
    summed = stored(summed)
    every = summed.agg(F.sum("source_size").cast(whole).alias("size"), F.sum("weight").cast(whole).alias("weight"))
    every = one_row(every)
    left = (every["size"] - (F.col("limits") - F.col("limit"))).cast(whole)
    shared = (every["weight"] - (F.col("weights") - F.col("weight"))).cast(whole)
    level = summed.select(left.alias("left"), shared.alias("shared"), "limit", "weight", *order)
    level = level.where((F.col("left") * F.col("weight")).cast(whole) <= (F.col("limit") * F.col("shared")).cast(whole))
    level = one_row(level.agg(F.min_by(F.struct("left", "shared"), F.struct(*order)).alias("at")))["at"]
    full = (level["left"] * F.col("weight")).cast(whole) > (F.col("limit") * level["shared"]).cast(whole)
    part = level["left"].cast("double") * F.col("weight").cast("double") / level["shared"].cast("double")
    kept = [*sources.columns]
    return summed.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(part)).select(*kept, "target")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in the units of expected copies."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = ("doc_id",),
    cycle: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: int = 42,
) -> DataFrame:
    """How often the mix takes each document: the columns of `keep`, then source, size, source_size,
    target, copies and taken (words, repeats counted).

    Texts do not move: only `keep` does. Documents of one size stand in the order of `keep`, then of their hash.
    """
    names = {k: f"__keep_{i}" for i, k in enumerate(keep)}
    sized = docs.select(
        *[col(k).alias(n) for k, n in names.items()],
        col(source).cast("string").alias("source"),
        word_count(col(text)).alias("size"),
        F.xxhash64(col(text)).alias("tie"),
    )
    sized = stored(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    aimed = stored(targets(cycled_weights(sources, cycle), cap))
    share = F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))
    expected = F.when(F.col("source_size") > 0, F.floor(share * COPY)).otherwise(0).cast("decimal(20,0)")
    known = look_up(sized, aimed, ["source"], "n_docs").withColumn("expected", expected)
    summed = running_total(known, "expected", ["size", *names.values(), "tie"], ["source"], "upto")
    summed = summed.withColumns({"after": F.col("upto") + offset(F.col("source"), seed)})
    copies = F.expr(f"after DIV {COPY} - (after - expected) DIV {COPY}")
    return summed.withColumn("copies", copies).select(
        *[F.col(n).alias(k) for k, n in names.items()],
        *[c for c in ("source", "size", "source_size", "target", "copies") if c not in names],
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, text: str = "text", source: str = "source", cycle: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: the documents with all their columns, each as often as it is taken."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[col(c).alias(n) for c, n in names.items()])
    counted = mix(renamed, names[text], names[source], list(names.values()), cycle, cap, seed)
    each = counted.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(*[col(n).alias(c) for c, n in names.items()])
