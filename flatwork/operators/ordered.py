"""Operators that depend on row order: positions, fills, interpolation, rolling means.

A window over a whole table is one task. Here rows are first cut into contiguous key ranges by
`repartitionByRange`, as many as the session has shuffle partitions, and stored with their range
number. Windows run inside a range, and what a range must know of its neighbours travels as one small
row per range. A partition key only leads the sort key, so one huge partition is spread over many
ranges as well. `order_by` (with `partition_by`) must identify a row; ties have no defined order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col
from flatwork.operators.joins import join_on
from flatwork.sources.checkpoints import cut_lineage

ROWS_PER_BLOCK = 1 << 16


def _struct(names: Sequence[str]) -> Column:
    return F.struct(*[col(n) for n in names])


def _sort_key(names: Sequence[str]) -> Column:
    """One value that sorts like the columns. A plain column lets max_by run as a hash aggregate."""
    return col(names[0]) if len(names) == 1 else _struct(names)


def _ranged(df: DataFrame, keys: Sequence[str], ranges: int | None) -> DataFrame:
    """The rows with the number of their key range. They are stored, so every use agrees on it; the sample that
    Spark draws for the bounds affects balance only."""
    columns = [col(k) for k in keys]
    split = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return cut_lineage(split.withColumn("__range", F.spark_partition_id()))


def with_position(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "position", ranges: int | None = None
) -> DataFrame:
    """Add the 0-based row position in `order_by`, per partition."""
    return _position(_ranged(df, [*partition_by, *order_by], ranges), order_by, partition_by, out).drop("__range")


def _position(ranged: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], out: str) -> DataFrame:
    counted = _total(ranged.withColumn("__one", F.lit(1).cast("long")), "__one", order_by, partition_by, out)
    return counted.withColumn(out, F.col(out) - 1).drop("__one")


def running_total(
    df: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str] = (), out: str = "total", ranges: int | None = None
) -> DataFrame:
    """Add the sum of `value` over all rows up to and including each row, per partition."""
    return _total(_ranged(df, [*partition_by, *order_by], ranges), value, order_by, partition_by, out).drop("__range")


def _total(ranged: DataFrame, value: str, order_by: Sequence[str], partition_by: Sequence[str], out: str) -> DataFrame:
    parts = [col(p) for p in partition_by]
    inside = (
        W.partitionBy("__range", *parts).orderBy(*[col(o) for o in order_by]).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    placed = ranged.withColumn(out, F.sum(col(value)).over(inside))
    sums = ranged.groupBy("__range", *parts).agg(F.sum(col(value)).alias("__sum"))
    # A partition has at most one row per range here.
    earlier = W.partitionBy(*parts).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.sum("__sum").over(earlier)).drop("__sum").where("__offset is not null")
    # Only the first partition of a range can have begun before it: at most one row per range.
    joined = join_on(placed, offsets, ["__range", *partition_by], "left", bounded=True)
    return joined.withColumn(out, F.col(out) + F.coalesce("__offset", F.lit(0))).drop("__offset")


def _last_present(
    ranged: DataFrame, value: Column, order_by: Sequence[str], partition_by: Sequence[str], out: str, backward: bool
) -> DataFrame:
    """Add the last non-null `value` up to and including each row (or the next one, backward)."""
    parts = [col(p) for p in partition_by]
    way = (lambda c: c.desc()) if backward else (lambda c: c.asc())
    valued = ranged.withColumn("__value", value)
    upto = W.partitionBy("__range", *parts).orderBy(*[way(col(o)) for o in order_by]).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = valued.withColumn(out, F.last("__value", ignorenulls=True).over(upto))

    # One row per range: the partition it ends in, with the last value present there.
    order = _sort_key(order_by)
    pick = F.min_by if backward else F.max_by
    tails = (
        valued.groupBy("__range", *parts)
        .agg(pick("__value", F.when(F.col("__value").isNotNull(), order)).alias("__tail"))
    )
    if parts:
        edge = F.min if backward else F.max
        edges = valued.groupBy("__range").agg(edge(_struct(partition_by)).alias("__edge"))
        edges = edges.select("__range", *[F.col("__edge")[p].alias(p) for p in partition_by])
        tails = join_on(tails, edges, ["__range", *partition_by])
    number = way(F.col("__range"))
    chain = W.partitionBy(*parts).orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = tails.withColumns(
        {
            "__carry": F.last("__tail", ignorenulls=True).over(chain),
            # One row per range is left here, so this one-task window is small.
            "__next": F.lead("__range").over(W.orderBy(number)),
        }
    ).select(F.col("__next").alias("__range"), *parts, "__carry")
    joined = join_on(filled, carried.where("__range is not null"), ["__range", *partition_by], "left", bounded=True)
    return joined.withColumn(out, F.coalesce(col(out), F.col("__carry"))).drop("__value", "__carry")


def _fill(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str], ranges: int | None, backward: bool) -> DataFrame:
    ranged = _ranged(df, [*partition_by, *order_by], ranges)
    filled = _last_present(ranged, col(column), order_by, partition_by, "__fill", backward)
    return filled.withColumn(column, F.col("__fill")).drop("__fill", "__range")


def forward_fill(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Replace a missing value by the last present one before it."""
    return _fill(df, column, order_by, partition_by, ranges, False)


def backward_fill(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Replace a missing value by the next present one after it."""
    return _fill(df, column, order_by, partition_by, ranges, True)


def interpolate_linear(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Fill gaps on the straight line between their neighbours, by row position.

    Leading gaps stay, trailing gaps take the last present value.
    """
    placed = _position(_ranged(df, [*partition_by, *order_by], ranges), order_by, partition_by, "__pos")
    point = F.when(col(column).isNotNull(), F.struct(F.col("__pos").alias("p"), col(column).cast("double").alias("v")))
    before = _last_present(placed, point, order_by, partition_by, "__lo", False)
    both = _last_present(before, point, order_by, partition_by, "__hi", True)
    slope = F.try_divide(
        F.col("__hi.v") - F.col("__lo.v"), (F.col("__hi.p") - F.col("__lo.p")).cast("double")
    )
    on_line = F.col("__lo.v") + slope * (F.col("__pos") - F.col("__lo.p"))
    value = F.when(col(column).isNotNull(), col(column).cast("double")).when(
        F.col("__hi").isNull(), F.col("__lo.v")
    ).otherwise(on_line)
    return both.withColumn(column, value).drop("__pos", "__lo", "__hi", "__range")


def rolling_mean(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    window: int = 3,
    partition_by: Sequence[str] = (),
    out: str | None = None,
    ranges: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Mean of the present values among the current and the `window - 1` rows before it.

    Rows are cut into blocks by position. The last `window - 1` rows of a block are copied into the
    next one as context, so each block computes on its own.
    """
    window = max(1, int(window))
    block = max(rows_per_block, window)
    placed = with_position(df, order_by, partition_by, "__pos", ranges)
    number = F.floor(F.col("__pos") / block)
    copies = F.when(
        F.pmod(F.col("__pos"), F.lit(block)) >= block - (window - 1), F.array(number, number + 1)
    ).otherwise(F.array(number))
    blocks = placed.withColumn("__block", F.explode(copies))
    frame = (
        W.partitionBy("__block", *[col(p) for p in partition_by]).orderBy("__pos").rowsBetween(-(window - 1), 0)
    )
    rolled = blocks.withColumn("__mean", F.avg(col(column)).over(frame)).where(F.col("__block") == number)
    return rolled.withColumn(out or f"{column}_rolling", F.col("__mean")).drop("__pos", "__block", "__mean")


def first_value(column: str, order_by: Sequence[str]) -> Column:
    """Aggregate: first present value in the given order."""
    return F.min_by(col(column), F.when(col(column).isNotNull(), _sort_key(order_by)))


def last_value(column: str, order_by: Sequence[str]) -> Column:
    """Aggregate: last present value in the given order."""
    return F.max_by(col(column), F.when(col(column).isNotNull(), _sort_key(order_by)))
