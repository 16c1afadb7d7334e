"""Previews, tables, samples and column checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from flatwork.functions.coerce import col, num, present, report_safe

# Column names whose sample values are hidden.
SENSITIVE_NAME = (
    r"(email|e-mail|phone|mobile|address|account|acct|customer[_\s-]*name|full[_\s-]*name"
    r"|transaction[_\s-]*id|user[_\s-]*id|uuid|ssn|aadhaar|pan|passport)"
)
MASK = "[masked]"


def clamp(value, low: int, high: int, default: int) -> int:
    """`value` as an int within bounds; `default` when it is absent or not a number."""
    try:
        value = default if value in (None, "") else int(value)
    except (TypeError, ValueError):
        value = default
    return min(max(value, low), high)


def known_columns(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    return [n for n in names or [] if n in df.columns]


def split_columns(df: DataFrame, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Requested columns as (present, absent)."""
    return known_columns(df, names), [n for n in names if n not in df.columns]


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Schema contract: the required columns a second table lacks."""
    return sorted(set(required) - set(df.columns))


def contract_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: present or not. Reads no data."""
    spark = df.sparkSession
    rows = [(c, c in df.columns) for c in dict.fromkeys(required)]
    return spark.createDataFrame(rows, "column_name string, present boolean")


def distinct_names(names: Sequence[str]) -> list[int]:
    """Positions of the first occurrence of each column name."""
    return [i for i, n in enumerate(names) if n not in names[:i]]


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns that share a name."""
    keep = distinct_names(df.columns)
    tagged = df.toDF(*[f"{n}__{i}" for i, n in enumerate(df.columns)])
    return tagged.select(*[col(f"{df.columns[i]}__{i}").alias(df.columns[i]) for i in keep])


def preview(df: DataFrame, limit=20, columns: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows (1..100, 20 by default) of the chosen columns; none chosen means all."""
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    chosen = known_columns(df, columns) or df.columns
    return report_safe(ordered.limit(clamp(limit, 1, 100, 20)).select(*[col(c) for c in chosen]))


def table_chart(df: DataFrame, columns=None, limit=50, order_by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Chosen columns (the first 25 when none) of the first rows (1..500, 50 by default)."""
    chosen = known_columns(df, columns) or df.columns[:25]
    keys = [col(c).desc() if descending else col(c) for c in order_by]
    ordered = df.orderBy(*keys) if keys else df
    return ordered.limit(clamp(limit, 1, 500, 50)).select(*[col(c) for c in chosen])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return present(df, known_columns(df, columns))


def sample_order(key: Sequence[str]) -> Column:
    """A repeatable random order: the md5 of the seed and the row key."""
    return F.md5(F.concat(F.lit("42"), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key]))


#: Samples of up to so many rows are ranked in one pass, in which every task sends at most the sample.
RANKED_ROWS = 10_000
#: Letters of the md5 by which rows are counted: 16^4 counts at most.
COUNTED_LETTERS = 4


def sample_rows(df: DataFrame, n, key: Sequence[str]) -> DataFrame:
    """At most n random rows, repeatable; "full" and "auto" keep the table. `key` identifies a row.

    The sample is the n rows that come first by `sample_order`, whatever n is. A large one is never sorted: counts of
    the first letters of that order find where the n-th row lies, rows before it stay by a filter, and only the few
    rows that share its letters are ranked.
    """
    if n in (None, "", "full", "auto"):
        return df
    n, order = max(1, int(n)), sample_order(key)
    ties = [col(k) for k in key]
    if n <= RANKED_ROWS:
        return df.orderBy(order, *ties).limit(n)
    hashes, prefix, before = df.select(order.alias("h")), "", 0
    while len(prefix) < 32:
        letters = F.substring("h", 1, len(prefix) + COUNTED_LETTERS).alias("p")
        counts = hashes.where(F.col("h").startswith(prefix)).groupBy(letters).agg(F.count("*").alias("n"))
        placed = counts.withColumn("upto", F.sum("n").over(W.orderBy("p")) + before)
        cut = placed.where(F.col("upto") >= n).orderBy("p").first()
        if cut is None:
            return df  # no more than n rows
        prefix, before = cut["p"], cut["upto"] - cut["n"]
        if cut["n"] <= RANKED_ROWS:
            break
    last = df.where(order.startswith(prefix)).orderBy(order, *ties).limit(n - before)
    return df.where(order < prefix).union(last)


def scatter(
    df: DataFrame,
    x: str,
    y: str,
    key: Sequence[str],
    size: str | None = None,
    color: str | None = None,
    limit=500,
    maximum: int = 1000,
    bubble: bool = False,
) -> DataFrame:
    """Numeric points, sampled to at most `limit`."""
    if bubble and not size:
        raise ValueError("A bubble chart needs a size column.")
    names = list(dict.fromkeys(c for c in (x, y, size) if c))
    ordered = df.withColumn("__order", sample_order(key))
    points = present(ordered.withColumns({n: num(df, n) for n in names}), [x, y])
    shown = list(dict.fromkeys([*names, *([color] if color else [])]))
    return points.orderBy("__order").limit(clamp(limit, 1, maximum, 500)).select(*[col(c) for c in shown])


def first_points(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], limit=1000, maximum: int = 5000, numeric=()) -> DataFrame:
    """The first rows in order where every numeric column is present."""
    points = present(df.withColumns({n: num(df, n) for n in numeric}), list(numeric))
    ordered = points.orderBy(*[col(c) for c in order_by])
    return ordered.limit(clamp(limit, 1, maximum, 1000)).select(*[col(c) for c in columns])


def is_sensitive(name: str, semantic_type: str | None = None) -> bool:
    return bool(re.search(SENSITIVE_NAME, name.lower())) or (semantic_type or "").lower() in ("id", "identifier")


def masked_sample(df: DataFrame, order_by: Sequence[str], limit: int = 10, semantic_types: dict | None = None) -> DataFrame:
    """A small sample with sensitive columns hidden."""
    types = semantic_types or {}
    shown = [F.lit(MASK).alias(c) if is_sensitive(c, types.get(c)) else col(c) for c in df.columns]
    return df.orderBy(*[col(c) for c in order_by]).limit(limit).select(*shown)


#: Rows that are looked at before the whole table is, for each value that is wanted of a column.
LEADING_ROWS = 20
#: Cells of a column that each further pass for distinct values ranks.
PASS_CELLS = 100


def _cells(columns: Sequence[str], at: Column, skip: dict[str, list[str]] | None = None) -> Column:
    """The present cells of a row as an array of (column_name, value, at), values in `skip` left out."""
    cells = []
    for c in columns:
        value = col(c).cast("string")
        known = (skip or {}).get(c)
        wanted = value.isNotNull() & ~value.isin(known) if known else value.isNotNull()
        cells.append(F.when(wanted, F.struct(F.lit(c).alias("column_name"), value.alias("value"), at.alias("at"))))
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def _first_cells(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int, from_end: bool, distinct: bool) -> DataFrame:
    """The first n present cells (or distinct values) of each column in row order; ties by value.

    The first rows of the table, ranked as whole rows, settle most columns. Only columns that show too few values there
    are looked up in all rows. For distinct values that goes pass by pass: the values known by then are skipped, and
    each pass adds one at least or ends a column, so no task holds or sends more than PASS_CELLS cells of a column.
    """
    columns, wanted = list(dict.fromkeys(columns)), LEADING_ROWS * n
    at = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    direction = (lambda c: c.desc()) if from_end else (lambda c: c.asc())
    rank = F.row_number().over(W.partitionBy("column_name").orderBy(direction(F.col("at")), "value"))
    found: dict[str, list[str]] = {c: [] for c in columns}

    def take(cells: DataFrame, limit: int) -> dict[str, int]:
        ranked = cells.select(F.explode("cells").alias("c")).select("c.*").withColumn("rank", rank).where(F.col("rank") <= limit)
        seen = dict.fromkeys(columns, 0)
        for r in ranked.select("column_name", "value", "rank").orderBy("column_name", "rank").collect():
            seen[r["column_name"]] += 1
            values = found[r["column_name"]]
            if len(values) < n and not (distinct and r["value"] in values):
                values.append(r["value"])
        return seen

    # Rows that tie with the last of the leading ones may be missing, so those count only up to it.
    kept = list(dict.fromkeys([*columns, *order_by]))
    rows = df.select(*[col(c) for c in kept]).orderBy(*[direction(col(c)) for c in order_by]).limit(wanted)
    whole = W.partitionBy(F.lit(0))
    edge = (F.min("at") if from_end else F.max("at")).over(whole)
    known = rows.select(at.alias("at"), _cells(columns, at).alias("cells")).withColumns({"edge": edge, "n": F.count("*").over(whole)})
    inside = F.col("at") > F.col("edge") if from_end else F.col("at") < F.col("edge")
    take(known.where((F.col("n") < wanted) | inside), wanted)
    missing = [c for c in columns if len(found[c]) < n]
    if not distinct:
        found.update((c, []) for c in missing)
    while missing:
        limit = PASS_CELLS if distinct else n
        seen = take(df.select(_cells(missing, at, found).alias("cells")), limit)
        missing = [c for c in missing if distinct and len(found[c]) < n and seen[c] == limit]
    out = [(c, i + 1, v) for c in columns for i, v in enumerate(found[c])]
    return df.sparkSession.createDataFrame(out, "column_name string, rank int, value string")


def edge_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 5, from_end: bool = False) -> DataFrame:
    """First (or last) n present values of each column, in row order: column_name, rank, value."""
    return _first_cells(df, columns, order_by, n, from_end, distinct=False)


def random_values(df: DataFrame, columns: Sequence[str], key: Sequence[str], n: int = 5) -> DataFrame:
    """n repeatable random present values of each column."""
    return edge_values(df.withColumn("__h", sample_order(key)), columns, ["__h", *key], n)


def first_distinct_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n distinct present values of each column in row order."""
    return _first_cells(df, columns, order_by, n, from_end=False, distinct=True)
