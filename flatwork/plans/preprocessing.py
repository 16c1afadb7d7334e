"""Preprocessing plans: a list of steps that can be replayed over any table with the same columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col, num
from flatwork.operators.cleaning.impute import impute
from flatwork.operators.cleaning.outliers import handle_outliers, transform
from flatwork.operators.features import apply_rule
from flatwork.operators.projection import contract_report, missing_columns


def required_columns(plan: Sequence[dict], target: str | None = None) -> list[str]:
    """Columns the steps read from the source table, without those earlier steps made; no target."""
    made: set[str] = set()
    out: list[str] = []
    for step in plan:
        for c in [step.get("column"), *(step.get("columns") or [])]:
            if c and c not in made and c != target and c not in out:
                out.append(c)
        made.add(step.get("new_column"))
    return out


def contract(df: DataFrame, plan: Sequence[dict], target: str | None = None) -> DataFrame:
    """Which required columns a table has."""
    return contract_report(df, required_columns(plan, target))


#: Imputations that read a column as numbers; so do all outlier methods and transforms.
NUMERIC_IMPUTATIONS = {
    "mean_imputation", "median_imputation", "interpolation_linear", "group_median_imputation", "group_mean_imputation",
    "rolling_mean_imputation", "knn_imputation", "model_based_imputation", "mice_imputation",
}


def _usable(df: DataFrame, step: dict) -> Column:
    """Whether a step can work with a present value of its column."""
    value = num(df, step["column"])
    if step.get("transform") in ("log_transform", "boxcox_transform"):
        return F.coalesce(value > 0, F.lit(False))
    if step.get("transform") == "sqrt_transform":
        return F.coalesce(value >= 0, F.lit(False))
    if "transform" in step or "outliers" in step or step.get("impute") in NUMERIC_IMPUTATIONS:
        return value.isNotNull()
    return F.lit(True)


def check(df: DataFrame, plan: Sequence[dict]) -> DataFrame:
    """Whether a table suits a plan, by its values: a row per step, from one aggregate over the table.

    step (from 1), column_name, present (or made by an earlier step), missing_count, unusable_count (present values that
    the step cannot work with: no number, or outside the domain of a transform) and fits: its columns are there and
    some value is usable. Counts are null for a column that is absent or made by a step, as its values are not known yet.
    """
    aggregates, rows, made = [F.count(F.lit(1)).alias("n")], [], set()
    for i, step in enumerate(plan):
        name, group = step["column"], step.get("group_column")
        there = all(c in df.columns or c in made for c in (name, group) if c)
        counts = [F.lit(None).cast("long")] * 2
        fits = F.lit(there)
        if name in df.columns and name not in made:
            given = col(name).isNotNull()
            aggregates += [F.count_if(~given).alias(f"m{i}"), F.count_if(given & ~_usable(df, step)).alias(f"u{i}")]
            counts = [F.col(f"m{i}"), F.col(f"u{i}")]
            fits = F.lit(there) & (F.col("n") > counts[0] + counts[1])
        values = [F.lit(i + 1), F.lit(name), F.lit(name in df.columns or name in made), *counts, fits]
        names = ["step", "column_name", "present", "missing_count", "unusable_count", "fits"]
        rows.append(F.struct(*[v.alias(n) for v, n in zip(values, names)]))
        made.add(step.get("new_column"))
    if not rows:
        return df.sparkSession.createDataFrame(
            [], "step int, column_name string, present boolean, missing_count long, unusable_count long, fits boolean"
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def replay(df: DataFrame, plan: Sequence[dict], order_by: Sequence[str] | None = None) -> DataFrame:
    """Run the steps in order; raises when a required column is absent."""
    absent = missing_columns(df, required_columns(plan))
    if absent:
        raise ValueError(f"Missing columns: {', '.join(absent)}")
    for step in plan:
        if "rule" in step:
            df = apply_rule(df, step["column"], step["new_column"], step["rule"])
        elif "impute" in step:
            df = impute(df, step["column"], step["impute"], step.get("custom_value"), step.get("group_column"), order_by=order_by)
        elif "outliers" in step:
            df = handle_outliers(df, step["column"], step["outliers"], step.get("params"))
        elif "transform" in step:
            df = transform(df, step["column"], step["transform"], step.get("new_column"), step.get("power"))
        else:
            raise ValueError(f"Unknown plan step: {sorted(step)}")
    return df
