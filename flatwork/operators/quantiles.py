"""Exact quantiles and modes that never gather a whole column or group in one task.

Quantiles go by rank selection. Numbers that round to the same leading bits form a range, and a group of few
rows is one range. Counts of the ranges tell which of them hold the wanted ranks; only these are opened, and again by
further bits as long as one of them holds too many rows. Their values are then counted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.operators.joins import join_on, one_row
from flatwork.sources.checkpoints import cut_lineage

#: Leading bits that the numbers of a range share, by level.
BITS = (9, 21, 37)
#: Rows of a range whose values are counted one by one.
OPEN_ROWS = 1 << 18
#: Ranges that may be sent to every task.
SENT_RANGES = 1 << 16


def leading(v: Column, bits: int) -> Column:
    """A double rounded to so many significant bits, by Veltkamp's splitting: it never falls where the double
    rises. Numbers from 2^960 stay as they are, since the product would overflow."""
    wide = v * float((1 << (53 - bits)) + 1)
    return F.when(F.abs(v) < 2.0**960, wide - (wide - v)).otherwise(v)


def _ranks(probs: Sequence[float]) -> Column:
    """The distinct ranks that the quantiles of `total` values interpolate between."""
    at = [f"{f}({float(p)!r}D * (total - 1))" for p in probs for f in ("floor", "ceil")]
    return F.expr(f"array_distinct(array({', '.join(at)}))")


def _placed(counts: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Add `upto`, the number of values up to and including this row."""
    upto = W.partitionBy(*group).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("upto", F.col("before") + F.sum("n").over(upto))


def _by_values(named: DataFrame, group: Sequence[str]) -> DataFrame:
    """The distinct values of groups of few rows: v, n, upto and total."""
    counts = named.groupBy(*group, "v").agg(F.count("*").alias("n")).withColumn("before", F.lit(0).cast("long"))
    return _placed(counts, group, "v").withColumn("total", F.sum("n").over(W.partitionBy(*group))).select(*group, "v", "n", "upto", "total")


def _by_ranges(named: DataFrame, group: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    """The distinct values of those ranges that hold wanted ranks: v, n, upto and total."""
    first = named.groupBy(*group, leading(F.col("v"), BITS[0]).alias("p0")).agg(F.count("*").alias("n"))
    first = first.withColumns({"total": F.sum("n").over(W.partitionBy(*group)), "before": F.lit(0).cast("long")})
    ranges = _placed(first, group, "p0")
    for level in range(len(BITS)):
        prefix = [f"p{i}" for i in range(level + 1)]
        held = F.exists(_ranks(probs), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        wanted = cut_lineage(ranges.where(held).select(*group, *prefix, (F.col("upto") - F.col("n")).alias("before"), "total", "n"))
        size = wanted.agg(F.count("*").alias("ranges"), F.max("n").alias("most")).first()
        last = level + 1 == len(BITS) or (size["most"] or 0) <= limit
        value = "v" if last else f"p{level + 1}"
        rows = named.select(*group, *[leading(F.col("v"), BITS[i]).alias(p) for i, p in enumerate(prefix)], F.col("v") if last else leading(F.col("v"), BITS[level + 1]).alias(value))
        if size["ranges"] <= SENT_RANGES:
            joined = join_on(rows, wanted.drop("n"), [*group, *prefix], bounded=True)
            opened = joined.groupBy(*group, *prefix, "before", "total", value).agg(F.count("*").alias("n"))
        else:
            # All values are counted before they meet the ranges, so one that many rows hold is one row per task.
            opened = join_on(rows.groupBy(*group, *prefix, value).agg(F.count("*").alias("n")), wanted.drop("n"), [*group, *prefix])
        ranges = _placed(opened, [*group, *prefix], value)
        if last:
            return ranges.select(*group, "v", "n", "upto", "total")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), limit: int = OPEN_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of double columns: one row per group, groups without a value included.

    The result holds `by` and, for each column, the array `q_<column>` in the order of `probs`. `limit` is the
    number of rows above which a range is cut further. Infinities are numbers here; NaN counts as missing.
    """
    # Grouping columns get neutral names inside, so no name of a table can clash.
    keys = [f"__by_{i}" for i in range(len(by))]
    cells = [F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    named = df.select(*[col(b).alias(k) for k, b in zip(keys, by)], F.explode(F.array(*cells)).alias("__cell")).select(*keys, "__cell.*")
    named = named.where("v IS NOT NULL AND NOT isnan(v)")
    group = [*keys, "c"]
    if not keys:
        ranked = _by_ranges(named, group, probs, limit)
    else:
        # A group of few rows is one range. There is one large group for every `limit` rows at most.
        large = cut_lineage(named.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > limit).drop("n"))
        count = large.count()
        ranked = _by_values(named, group)
        if count:
            sent = large if count > SENT_RANGES else F.broadcast(large)
            same = lambda: reduce(and_, [named[g].eqNullSafe(large[g]) for g in group])
            few, many = named.join(sent, same(), "left_anti"), named.join(sent, same(), "left_semi")
            ranked = _by_values(few, group).unionByName(_by_ranges(many, group, probs, limit))
    # One expression text per column: building these from single Column calls takes longer than small data.
    aggs = []
    for i in range(len(columns)):
        found = []
        for p in probs:
            at = f"({float(p)!r}D * (total - 1))"
            low, high = (f"max(CASE WHEN c = {i} AND {f}({at}) >= upto - n AND {f}({at}) < upto THEN v END)" for f in ("floor", "ceil"))
            share = f"max(CASE WHEN c = {i} THEN {at} - floor({at}) END)"
            found.append(f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * {share} END")
        aggs.append(F.expr(f"array({', '.join(found)})").alias(f"q{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    if keys:
        out = join_on(df.select(*[col(b).alias(k) for k, b in zip(keys, by)]).distinct(), out, keys, "left")
    none = F.array(*[F.lit(None).cast("double") for _ in probs])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *[F.coalesce(f"q{i}", none).alias(f"q_{c}") for i, c in enumerate(columns)])


def quantile_scalars(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[Column]]:
    """Whole-table quantiles as scalar subqueries, to be used inside any expression."""
    row = one_row(quantiles(df, columns, probs))
    return {c: [F.get(row[f"q_{c}"], F.lit(i)) for i in range(len(probs))] for c in columns}


def modes(df: DataFrame, column: str, by: Sequence[str] = (), out: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest of tied values, with its count.

    Counting per value comes first, so a group is reduced to one row per value before it meets
    in one place, and the last step keeps a single struct.
    """
    counts = df.where(col(column).isNotNull()).groupBy(*[col(b) for b in by], col(column)).agg(
        F.count("*").alias("__n")
    )
    best = F.min(F.struct((-F.col("__n")).alias("n"), col(column).alias("v")))
    return (
        counts.groupBy(*[col(b) for b in by])
        .agg(best.alias("__best"))
        .select(*[col(b) for b in by], F.col("__best.v").alias(out), (-F.col("__best.n")).alias(f"{out}_count"))
    )
