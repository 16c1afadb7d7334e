"""Joins of data with small statistics, and one-row results as scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", bounded: bool = False) -> DataFrame:
    """Equi join on named keys where null matches null; the keys appear once.

    `bounded` says that the right side has a fixed maximum size and may go to every task.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [col(k).eqNullSafe(col(f"__r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(F.broadcast(renamed) if bounded else renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct: a scalar subquery, computed once per query."""
    return df.select(F.struct(*[col(c) for c in df.columns])).scalar()
