"""Grouped measures, ranking and the tables behind grouped charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col, column_type, is_numeric, num, ts
from flatwork.operators.ordered import first_value, last_value
from flatwork.operators.projection import clamp
from flatwork.operators.joins import join_on, one_row
from flatwork.operators.quantiles import quantiles
from flatwork.sources.checkpoints import cut_lineage

# The accepted spellings of each aggregation.
AGGREGATION_ALIASES = {
    "sum": "sum",
    "total": "sum",
    "mean": "mean",
    "avg": "mean",
    "average": "mean",
    "median": "median",
    "count": "count",
    "nunique": "nunique",
    "unique_count": "nunique",
    "count_distinct": "nunique",
    "distinct_count": "nunique",
    "std": "std",
    "stddev": "std",
    "standard_deviation": "std",
    "var": "var",
    "variance": "var",
    "min": "min",
    "max": "max",
    "first": "first",
    "last": "last",
}
ASCENDING = ("asc", "ascending", "smallest", "low_to_high", "low to high", "a-z", "oldest")


#: Parts that a group is ranked in before its best rows meet.
PARTS_OF_A_GROUP = 16


def aggregation_name(raw: str | None) -> str:
    return AGGREGATION_ALIASES.get((raw or "sum").strip().lower(), "sum")


def is_ascending(raw: str | None) -> bool:
    return (raw or "descending").strip().lower() in ASCENDING


def _simple(name: str, value: Column) -> Column:
    return {
        "sum": F.when(F.count(value) > 0, F.sum(value)),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "var": F.var_samp(value),
        "min": F.min(value),
        "max": F.max(value),
    }[name]


def aggregate(
    df: DataFrame,
    by: Sequence[str],
    measures: Sequence[tuple[str | None, str, str]],
    order_by: Sequence[str] = (),
    count_rows: bool = True,
) -> DataFrame:
    """All measures (column, aggregation, output name) of each group in one aggregate.

    `count` counts rows in a chart and present values in a single figure (`count_rows=False`).
    Numeric measures are coerced; medians are exact and joined from the quantile operator.
    """
    work = df.select(
        *[col(b) for b in by],
        *[col(o).alias(f"__o{i}") for i, o in enumerate(order_by)],
        *[col(c).alias(f"__raw{i}") for i, (c, _, _) in enumerate(measures) if c],
        *[num(df, c).alias(f"__num{i}") for i, (c, _, _) in enumerate(measures) if c],
    )
    order = [f"__o{i}" for i in range(len(order_by))]
    aggs, medians = [], {}
    for i, (column, how, out) in enumerate(measures):
        how, raw, value = aggregation_name(how), col(f"__raw{i}"), col(f"__num{i}")
        if column is None or (how == "count" and count_rows):
            aggs.append(F.count("*").alias(out))
        elif how == "count":
            aggs.append(F.count(raw).alias(out))
        elif how == "nunique":
            aggs.append(F.count_distinct(raw).alias(out))
        elif how == "median":
            medians[f"__num{i}"] = out
        elif how in ("first", "last"):
            if not order:
                raise ValueError(f"'{how}' needs order_by.")
            aggs.append((first_value if how == "first" else last_value)(f"__raw{i}", order).alias(out))
        else:
            aggs.append(_simple(how, value).alias(out))
    names = [out for _, _, out in measures]
    keys = [col(b) for b in by]
    if not medians:
        return work.groupBy(*keys).agg(*aggs).select(*keys, *[col(n) for n in names])
    middle = quantiles(work, list(medians), [0.5], by)
    middle = middle.select(*keys, *[F.get(col(f"q_{c}"), F.lit(0)).alias(out) for c, out in medians.items()])
    if not aggs:
        return middle.select(*keys, *[col(n) for n in names])
    plain = work.groupBy(*keys).agg(*aggs)
    if by:
        joined = join_on(plain, middle, by)
    else:
        stats = one_row(middle)
        joined = plain.withColumns({out: stats[out] for out in medians.values()})
    return joined.select(*keys, *[col(n) for n in names])


def top_n(df: DataFrame, value: str, n: int, keys: Sequence[str], ascending: bool = False) -> DataFrame:
    """The n largest (or smallest) rows by value, ties by key; missing values fill no place.

    When the table holds no more than n rows it is returned whole, missing values included.
    """
    rank = col(value).asc_nulls_last() if ascending else col(value).desc_nulls_last()
    order = [rank, *[col(k).asc_nulls_last() for k in keys]]
    # n + 1 rows tell whether anything was left out; the window runs over those alone.
    head = df.orderBy(*order).limit(n + 1)
    numbered = head.withColumns({"__at": F.row_number().over(W.orderBy(*order)), "__of": F.count("*").over(W.partitionBy())})
    kept = numbered.where((F.col("__at") <= n) & ((F.col("__of") <= n) | col(value).isNotNull()))
    return kept.drop("__at", "__of")


def top_per_group(df: DataFrame, group: str, value: str, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The best k rows of each group. One huge group is ranked in parts first, and each part passes on its best
    k rows, whatever k is."""
    order = [col(value).desc_nulls_last(), *[col(c) for c in keys]]
    part = F.pmod(F.xxhash64(*[col(c) for c in (keys or df.columns)]), F.lit(PARTS_OF_A_GROUP)).alias("__part")
    parts = df.where(col(group).isNotNull()).select("*", part)
    for split in (["__part"], []):
        rank = F.row_number().over(W.partitionBy(col(group), *split).orderBy(*order))
        parts = parts.withColumn("__at", rank).where(F.col("__at") <= k).drop("__at")
    return parts.drop("__part")


def with_other(df: DataFrame, x: str, value: str, n=10, label: str = "Other") -> DataFrame:
    """Keep the top n (2..15) categories and add the sum of the rest when it is positive."""
    n = clamp(n, 2, 15, 10)
    # One row per category, used three times below: aggregate the data once.
    text = cut_lineage(df.withColumn(x, col(x).cast("string")))
    # At most 15 rows: safe to send to every task.
    top = text.where(col(value).isNotNull()).orderBy(col(value).desc(), col(x)).limit(n)
    few = text.agg((F.count("*") <= n).alias("few"))
    rest = text.join(F.broadcast(top.select(col(x).alias("__x"))), col(x) == F.col("__x"), "left_anti")
    other = rest.agg(F.sum(col(value)).alias(value)).where(col(value) > 0)
    other = other.select(*[
        F.lit(label).alias(c) if c == x else (col(value) if c == value else F.lit(None).cast(text.schema[c].dataType).alias(c))
        for c in text.columns
    ])
    few_flag = few.scalar()
    return top.union(rest.where(few_flag)).union(other.where(~few_flag))


def _needs_fallback(df: DataFrame, column: str | None, how: str) -> bool:
    return (
        column is not None
        and aggregation_name(how) not in ("count", "nunique")
        and not is_numeric(column_type(df, column))
    )


def grouped_chart(
    df: DataFrame,
    x: str,
    measures: Sequence[tuple[str | None, str]] = (),
    color: str | None = None,
    top: int | None = None,
    sort_by: str | None = None,
    sort_order: str = "descending",
    chart: str = "bar",
    rank_aggregation: str = "sum",
) -> DataFrame:
    """The table of a bar, line, area, combo, pie or donut chart.

    Every measure of every series comes from one aggregate over (x, color). Missing x is dropped,
    a missing color is a group of its own. A measure without a single number counts its present values.
    """
    by = [x] + ([color] if color and color != x else [])
    series = [(c, aggregation_name(a), c or "row_count") for c, a in measures] or [(None, "count", "row_count")]
    series = [(c, how, f"{out}_{how}" if out in by else out) for c, how, out in series]
    work = df.where(col(x).isNotNull())
    specs, checks = list(series), []
    for i, (c, how, _) in enumerate(series):
        if _needs_fallback(df, c, how):
            checks.append((i, c))
            specs.append((c, "count_present", f"__present{i}"))
    grouped = aggregate(work, by, [s for s in specs if s[1] != "count_present"])
    if checks:
        counts = work.groupBy(*[col(b) for b in by]).agg(*[F.count(col(c)).alias(f"__present{i}") for i, c in checks])
        totals = one_row(work.agg(*[F.count(num(df, c)).alias(f"__numbers{i}") for i, c in checks]))
        grouped = join_on(grouped, counts, by)
        for i, _ in checks:
            present = F.when(col(f"__present{i}") > 0, col(f"__present{i}").cast("double"))
            out = series[i][2]
            grouped = grouped.withColumn(out, F.when(totals[f"__numbers{i}"] == 0, present).otherwise(col(out)))
        grouped = grouped.drop(*[f"__present{i}" for i, _ in checks])
    names = [out for _, _, out in series]
    for c, how, out in series:
        if how == "nunique":
            grouped = grouped.withColumn(out, F.when(col(out) > 0, col(out)))
    grouped = grouped.where(F.coalesce(*[col(n).cast("string") for n in names]).isNotNull())

    rank = names[0]
    if sort_by and sort_by != rank:
        if sort_by in grouped.columns:
            rank = sort_by
        elif sort_by in df.columns:
            how = rank_aggregation if rank_aggregation in ("sum", "mean", "min", "max", "median") else "sum"
            ranks = aggregate(work, [x], [(sort_by, how, "__rank")])
            grouped, rank = join_on(grouped, ranks, [x], "left"), "__rank"

    up = is_ascending(sort_order)
    if chart in ("pie", "donut") and not color:
        return with_other(grouped, x, rank, min(top or 10, 10)).drop("__rank")
    if top:
        n = clamp(top, 1, 100, 20)
        if rank == "__rank" and color:
            # Rank whole categories, then keep all colors of the kept ones: at most 100 rows travel.
            best = top_n(grouped.select(col(x), F.col("__rank")).distinct(), "__rank", n, [x], up)
            best = best.select(col(x).alias("__x"))
            grouped = grouped.join(F.broadcast(best), col(x) == F.col("__x"), "left_semi")
        else:
            grouped = top_n(grouped, rank, n, by, up)
    keys = [col(b).asc_nulls_last() for b in by]
    if chart in ("line", "area", "combo"):
        ordered = grouped.orderBy(*keys)
    else:
        first = col(rank).asc_nulls_last() if up else col(rank).desc_nulls_last()
        ordered = grouped.orderBy(first, *keys)
    return ordered.drop("__rank")


def sort_table(df: DataFrame, by: str, keys: Sequence[str] = (), sort_order: str = "descending") -> DataFrame:
    """Sort by number where the column is numeric text or a number, else by text; missing last."""
    value = num(df, by)
    up = is_ascending(sort_order)
    way = (lambda c: c.asc_nulls_last()) if up else (lambda c: c.desc_nulls_last())
    return df.orderBy(way(value), way(col(by)), *[col(k) for k in keys])


def limit_rows(df: DataFrame, n, default: int, maximum: int, keys: Sequence[str] = ()) -> DataFrame:
    ordered = df.orderBy(*[col(k) for k in keys]) if keys else df
    return ordered.limit(clamp(n, 1, maximum, default))


def kpi(df: DataFrame, column: str, how: str = "sum", title: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One figure over the whole table; `count` counts present values."""
    name = aggregation_name(how)
    figure = aggregate(df, [], [(column, name, "value")], order_by, count_rows=False)
    return figure.select(F.lit(title or f"{name.title()} of {column}").alias("metric"), "value")


def with_share(df: DataFrame, value: str, out: str = "percentage") -> DataFrame:
    """Each row's percentage of the column total."""
    total = df.agg(F.sum(col(value))).scalar()
    return df.withColumn(out, F.try_divide(col(value) * 100.0, total))


def period_label(df: DataFrame, column: str, granularity: str = "auto") -> Column:
    """A day, month, quarter or year label; `auto` is the month."""
    when = ts(df, column)
    if granularity == "day":
        return F.date_format(when, "yyyy-MM-dd")
    if granularity == "quarter":
        return F.concat(F.year(when).cast("string"), F.lit("Q"), F.quarter(when).cast("string"))
    if granularity == "year":
        return F.date_format(when, "yyyy")
    return F.date_format(when, "yyyy-MM")


def period_chart(df: DataFrame, date: str, measures, granularity: str = "auto", color: str | None = None, chart: str = "line") -> DataFrame:
    """Grouped chart over calendar periods."""
    labelled = df.withColumn("period", period_label(df, date, granularity))
    return grouped_chart(labelled, "period", measures, color, chart=chart)


def _pivot_values(df: DataFrame, column: str, maximum: int) -> list:
    values = [r[0] for r in df.select(col(column)).distinct().orderBy(col(column)).limit(maximum + 1).collect()]
    if len(values) > maximum:
        raise ValueError(f"'{column}' has more than {maximum} values; a matrix cannot have that many columns.")
    return values


def cells(df: DataFrame, x: str, group: str, value: str | None = None, how: str = "count") -> DataFrame:
    """The filled cells of an x by group matrix."""
    how = aggregation_name(how) if value else "count"
    work = df.where(col(x).isNotNull() & col(group).isNotNull())
    out = aggregate(work, [x, group], [(value, how, "value")], count_rows=value is None)
    return out.where("value is not null") if how not in ("count", "nunique") else out


def pivot_table(
    df: DataFrame, x: str, group: str, value: str | None = None, how: str = "count", maximum: int = 10_000, values: Sequence | None = None
) -> DataFrame:
    """Wide matrix, one column per group value, empty cells 0.

    Columns are part of the plan, so their values are needed before it runs: `values` names them, and cells of other
    groups and rows without a cell among them are left out. Without it they are looked up, at most `maximum`.
    """
    filled = cells(df, x, group, value, how)
    if values is None:
        values = _pivot_values(filled, group, maximum)
    else:
        values = list(dict.fromkeys(values))
        filled = filled.where(col(group).isin(values))
    wide = filled.withColumnRenamed(group, "__group").groupBy(col(x)).pivot("__group", values).agg(F.first("value"))
    return wide.select(col(x), *[F.coalesce(col(c), F.lit(0)).alias(c) for c in wide.columns if c != x])


#: Group values of a matrix that stand together, on average.
BLOCK_VALUES = 64


def heatmap(df: DataFrame, x: str, group: str, value: str | None = None, how: str = "count") -> DataFrame:
    """Long matrix: every x with every group value, empty cells 0.

    The matrix is kept sparse until its last step. A hash deals the group values to blocks of about BLOCK_VALUES; the
    filled cells of an x in a block are one short map, and a row per x and block meets the block's values there. So no
    task ever holds all group values, and a join moves a row per block, not one per cell.
    """
    filled = cut_lineage(cells(df, x, group, value, how).select(col(x).alias("x"), col(group).cast("string").alias("g"), "value"))
    found = filled.select("g").distinct()
    blocks = max(1, math.ceil(found.count() / BLOCK_VALUES))
    salts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("g"), F.lit(blocks))
    # Every x asks for every block, so a block is laid out once for each salt and its askers spread over them.
    salt = F.pmod(F.xxhash64("x"), F.lit(salts))
    names = found.groupBy(block.alias("block")).agg(F.collect_list("g").alias("names"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rows = filled.groupBy("x", block.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("g", "value"))).alias("held"))
    grid = filled.select("x").distinct().select("x", salt.alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    asked = join_on(join_on(grid, names, ["block", "salt"]), rows, ["x", "block"], "left")
    shown = asked.select("x", "held", F.explode("names").alias("g"))
    return shown.select(F.col("x").alias(x), F.col("g").alias(group), F.coalesce(F.col("held")[F.col("g")], F.lit(0)).alias("value"))


def totals_matrix(
    df: DataFrame, x: str, group: str, value: str, how: str = "sum", top: int | None = None, sort_order: str = "descending", values: Sequence | None = None
) -> DataFrame:
    """Pivot with a row total, sorted and cut by it."""
    wide = pivot_table(df, x, group, value, how, values=values)
    names = [c for c in wide.columns if c != x]
    first = col(names[0])
    summed = wide.withColumn("total", F.aggregate(F.array(*[col(n) for n in names[1:]]), first, lambda a, v: a + v) if names[1:] else first)
    up = is_ascending(sort_order)
    if top:
        return top_n(summed, "total", clamp(top, 1, 100, 20), [x], up)
    return summed.orderBy(F.col("total").asc() if up else F.col("total").desc(), col(x))


def location_map(df: DataFrame, location: str, value: str | None = None, how: str = "sum", limit=500, maximum: int = 2000) -> DataFrame:
    """One value per location; a value without numbers counts rows."""
    chart = grouped_chart(df, location, [(value, how)] if value else [])
    named = chart.withColumnRenamed(chart.columns[-1], "value")
    return top_n(named, "value", clamp(limit, 1, maximum, 500), [location])


def insight(df: DataFrame, category: str, value: str) -> DataFrame:
    """Highest and lowest category of a result table."""
    number = num(df, value)
    return df.where(number.isNotNull()).agg(
        F.count("*").alias("rows_analyzed"),
        F.min(F.struct((-number).alias("v"), col(category).alias("c")))["c"].alias("top_category"),
        F.max(number).alias("top_value"),
        F.min(F.struct(number.alias("v"), col(category).alias("c")))["c"].alias("low_category"),
        F.min(number).alias("low_value"),
    )


def dominance(df: DataFrame, bucket: str, count: str) -> DataFrame:
    """The strongest bucket: its share, its lead over the second, and whether it dominates."""
    total = df.agg(F.sum(col(count))).scalar()
    order = [col(count).desc_nulls_last(), col(bucket)]
    # Two rows are enough; the window runs over those alone.
    two = df.orderBy(*order).limit(2).withColumn("__second", F.lead(col(count)).over(W.orderBy(*order)))
    first = two.orderBy(*order).limit(1)
    share = F.try_divide(col(count) * 100.0, total)
    return first.select(
        col(bucket).alias("top_bucket"),
        col(count).alias("top_count"),
        F.round(share, 1).alias("share"),
        F.round(F.try_divide(col(count) * 1.0, F.col("__second")), 1).alias("ratio_to_second"),
        (share >= 30).alias("dominates"),
    )


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each present value of each column occurs: column_name, value (text), n.

    One shuffle for any number of columns, already combined in the map tasks.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("cell"))
        .select("cell.*")
        .where("value is not null")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )


def top_frequencies(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The n most frequent values of each column."""
    return top_frequencies_of(frequencies(df, columns), n)


def top_frequencies_of(counts: DataFrame, n: int = 5) -> DataFrame:
    order = W.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("column_name", "rank", "value", "n")


def extreme_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n lowest and n highest present values."""
    values = df.select(num(df, column).alias("value")).where("value is not null")
    low = values.orderBy("value").limit(n).select(F.lit("lowest").alias("side"), "value")
    high = values.orderBy(F.desc("value")).limit(n).select(F.lit("highest").alias("side"), "value")
    return low.unionByName(high)
