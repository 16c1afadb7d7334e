"""Forecast and what-if tables. Only names are given by the product; the meanings are stated here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col, num, ts
from flatwork.operators.aggregate import aggregate
from flatwork.operators.joins import join_on


def forecast(df: DataFrame, date: str, value: str, periods: int = 6, window: int = 3, grain: str = "month") -> DataFrame:
    """Period totals, then `periods` future ones at the mean of the last `window` totals."""
    periods, window = max(1, int(periods)), max(1, int(window))
    start = F.date_trunc(grain, ts(df, date)).cast("date")
    history = df.select(start.alias("period"), num(df, value).alias("v")).where("period is not null and v is not null")
    history = history.groupBy("period").agg(F.sum("v").alias("value"))
    recent = history.orderBy(F.desc("period")).limit(window)
    level = recent.agg(F.avg("value").alias("value"), F.max("period").alias("last"))
    step = {"day": "1 day", "week": "7 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}[grain]
    ahead = F.expr(f"transform(sequence(1, {periods}), i -> cast(last + i * interval {step} as date))")
    future = level.where("last is not null").select(F.explode(ahead).alias("period"), "value")
    return history.withColumn("is_forecast", F.lit(False)).unionByName(future.withColumn("is_forecast", F.lit(True)))


def what_if(
    df: DataFrame, variable: str, change: str, amount: float, measure: str, how: str = "sum", by: Sequence[str] = ()
) -> DataFrame:
    """A measure before and after changing a column by a percentage or an amount."""
    if change not in ("percentage", "percent", "amount", "absolute"):
        raise ValueError(f"Unknown change: {change}")
    moved = num(df, variable) * (1 + amount / 100.0) if change.startswith("percent") else num(df, variable) + float(amount)
    scenario = df.withColumn(variable, moved)
    before = aggregate(df, by, [(measure, how, "baseline")])
    after = aggregate(scenario, by, [(measure, how, "scenario")])
    if by:
        joined = join_on(before, after, by)
    else:
        joined = before.withColumn("scenario", after.scalar())
    return joined.select(*[col(b) for b in by], "baseline", "scenario", (F.col("scenario") - F.col("baseline")).alias("change"))
