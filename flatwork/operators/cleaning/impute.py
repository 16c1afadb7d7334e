"""Filling missing values. Statistics enter as scalar subqueries or joined group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flatwork.functions.coerce import col, column_type, is_numeric, num, present
from flatwork.operators import ordered
from flatwork.operators.features import rare_grouping
from flatwork.operators.joins import one_row
from flatwork.operators.quantiles import modes, quantile_scalars, quantiles

# The methods offered per kind of column.
IMPUTATION_METHODS = {
    "numeric": (
        "mean_imputation", "median_imputation", "mode_imputation", "fill_zero", "custom_value", "drop_rows",
        "drop_column", "missing_indicator", "forward_fill", "backward_fill", "interpolation_linear",
        "group_median_imputation", "group_mean_imputation", "rolling_mean_imputation", "knn_imputation",
        "model_based_imputation", "mice_imputation",
    ),
    "categorical": (
        "mode_imputation", "missing_category", "custom_value", "drop_rows", "drop_column", "missing_indicator",
        "rare_category_grouping", "group_mode_imputation", "predictive_imputation",
    ),
    "numeric_categorical": (
        "mode_imputation", "missing_category", "custom_value", "drop_rows", "drop_column", "missing_indicator",
    ),
    "text": ("empty_string", "missing_token", "custom_value", "drop_rows", "drop_column", "missing_indicator"),
    "datetime": ("forward_fill", "backward_fill", "custom_value", "drop_rows", "drop_column", "missing_indicator"),
    "id_like": ("keep_missing", "missing_indicator", "drop_rows", "drop_column"),
    "review": ("manual_review", "custom_value", "drop_rows", "drop_column", "missing_indicator"),
}
CONSTANTS = {"fill_zero": 0, "missing_category": "Missing", "empty_string": "", "missing_token": "MISSING"}


def _statistic_source(df: DataFrame, column: str) -> DataFrame:
    return df.select(num(df, column).alias("__v"))


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    """Missing as a given value; a text value turns a non-text column into text."""
    dtype = column_type(df, column)
    if isinstance(dtype, T.StringType):
        return df.withColumn(column, F.coalesce(col(column), F.lit(str(value))))
    if is_numeric(dtype) and isinstance(value, (int, float)) and not isinstance(value, bool):
        kept = dtype if float(value).is_integer() else T.DoubleType()
        return df.withColumn(column, F.coalesce(col(column).cast(kept), F.lit(value).cast(kept)))
    fitted = F.lit(value).try_cast(dtype)
    if df.sparkSession.range(1).select(fitted.isNull()).first()[0]:
        return df.withColumn(column, F.coalesce(col(column).cast("string"), F.lit(str(value))))
    return df.withColumn(column, F.coalesce(col(column), fitted))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    mean = _statistic_source(df, column).agg(F.avg("__v")).scalar()
    return df.withColumn(column, F.coalesce(col(column).cast("double"), mean))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    median = quantile_scalars(_statistic_source(df, column), ["__v"], [0.5])["__v"][0]
    return df.withColumn(column, F.coalesce(col(column).cast("double"), median))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest of tied ones."""
    mode = modes(df.select(col(column)), column).select("mode").scalar()
    return df.withColumn(column, F.coalesce(col(column), mode))


def fill_rolling_mean(df: DataFrame, column: str, order_by: Sequence[str], window: int = 3, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rolling mean, then the mean of the part-filled column."""
    numeric = df.withColumn("__v", num(df, column))
    rolled = ordered.rolling_mean(numeric, "__v", order_by, window, partition_by, "__rolling")
    part = rolled.withColumn(column, F.coalesce("__v", "__rolling")).drop("__v", "__rolling")
    mean = part.agg(F.avg(col(column))).scalar()
    return part.withColumn(column, F.coalesce(col(column), mean))


def _joined(df: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    return df.join(stats, col(group) == F.col("__g"), "left").drop("__g")


def fill_group_mean(df: DataFrame, column: str, group: str) -> DataFrame:
    """Group mean; rows without one take the mean of the part-filled column.

    That mean follows from the group sums, so the joined rows are not read a second time.
    """
    source = df.select(col(group).alias("__g"), num(df, column).alias("__v"))
    sums = source.groupBy("__g").agg(F.sum("__v").alias("s"), F.count("__v").alias("n"), F.count("*").alias("rows"))
    usable = F.col("__g").isNotNull() & (F.col("n") > 0)
    total = F.sum(F.when(usable, F.col("s") / F.col("n") * F.col("rows")).otherwise(F.coalesce("s", F.lit(0.0))))
    held = F.sum(F.when(usable, F.col("rows")).otherwise(F.col("n")))
    mean = sums.agg(F.try_divide(total, held)).scalar()
    means = sums.where(usable).select("__g", (F.col("s") / F.col("n")).alias("__m"))
    filled = F.coalesce(col(column).cast("double"), F.col("__m"), mean)
    return _joined(df, means, group).withColumn(column, filled).drop("__m")


def fill_group_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """Group median; rows without one take the median of the part-filled column."""
    source = df.where(col(group).isNotNull()).select(col(group).alias("__g"), num(df, column).alias("__v"))
    medians = quantiles(source, ["__v"], [0.5], ["__g"]).select("__g", F.get("q___v", F.lit(0)).alias("__m"))
    part = _joined(df, medians, group).withColumn(column, F.coalesce(col(column).cast("double"), F.col("__m"))).drop("__m")
    return fill_median(part, column)


def fill_group_mode(df: DataFrame, column: str, group: str) -> DataFrame:
    """Group mode; rows without one take the mode of the part-filled column."""
    source = df.where(col(group).isNotNull()).select(col(group).alias("__g"), col(column).alias("__v"))
    best = modes(source, "__v", ["__g"], "__m").drop("__m_count")
    part = _joined(df, best, group).withColumn(column, F.coalesce(col(column), F.col("__m"))).drop("__m")
    return fill_mode(part, column)


def missing_indicator(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_was_missing", col(column).isNull().cast("int"))


def _order(order_by: Sequence[str] | None, time_column: str | None, method: str) -> list[str]:
    keys = list(dict.fromkeys([*([time_column] if time_column else []), *(order_by or [])]))
    if not keys:
        raise ValueError(f"'{method}' depends on row order and needs order_by or a time column.")
    return keys


def impute(
    df: DataFrame,
    column: str,
    method: str,
    custom_value=None,
    group_column: str | None = None,
    time_column: str | None = None,
    order_by: Sequence[str] | None = None,
    params: dict | None = None,
) -> DataFrame:
    """Apply one imputation method to one column."""
    from flatwork.operators.cleaning import models

    params = params or {}
    for c in filter(None, (column, group_column, time_column)):
        if c not in df.columns:
            raise ValueError(f"Column '{c}' does not exist.")
    if method.startswith("group_") and not group_column:
        raise ValueError(f"'{method}' needs a group column.")
    if method == "mode_imputation" and df.where(col(column).isNotNull()).isEmpty():
        raise ValueError(f"Column '{column}' has no value to impute with.")
    if method in CONSTANTS:
        return fill_constant(df, column, CONSTANTS[method])
    match method:
        case "mean_imputation":
            return fill_mean(df, column)
        case "median_imputation":
            return fill_median(df, column)
        case "mode_imputation":
            return fill_mode(df, column)
        case "custom_value":
            if custom_value is None:
                raise ValueError("A custom value is needed.")
            return fill_constant(df, column, custom_value)
        case "forward_fill":
            return ordered.forward_fill(df, column, _order(order_by, time_column, method))
        case "backward_fill":
            return ordered.backward_fill(df, column, _order(order_by, time_column, method))
        case "interpolation_linear":
            numeric = df.withColumn(column, num(df, column))
            return ordered.interpolate_linear(numeric, column, _order(order_by, time_column, method))
        case "rolling_mean_imputation":
            return fill_rolling_mean(df, column, _order(order_by, time_column, method), params.get("window", 3))
        case "drop_rows":
            return present(df, [column])
        case "drop_column":
            return df.drop(col(column))
        case "missing_indicator":
            return missing_indicator(df, column)
        case "group_mean_imputation":
            return fill_group_mean(df, column, group_column)
        case "group_median_imputation":
            return fill_group_median(df, column, group_column)
        case "group_mode_imputation":
            return fill_group_mode(df, column, group_column)
        case "rare_category_grouping":
            return rare_grouping(df, column, column, params.get("minimum_frequency", 0.01))
        case "model_based_imputation" | "predictive_imputation":
            return models.fill_predicted(df, column, params["features"])
        case "mice_imputation":
            return models.fill_chained(df, [column, *params["features"]], params.get("rounds", 3))
        case "knn_imputation":
            return models.fill_nearest(df, column, params["features"], params.get("k", 5))
    raise ValueError(f"Imputation method '{method}' is not implemented.")


def imputed_value(df: DataFrame, column: str, method: str, custom_value=None) -> Column | None:
    """The single value a method fills in, as an aggregate result; None when it varies by row."""
    if method in CONSTANTS:
        return F.lit(CONSTANTS[method]).cast("string")
    if method == "custom_value":
        return F.lit(custom_value).cast("string")
    source = _statistic_source(df, column)
    if method == "mean_imputation":
        return one_row(source.agg(F.avg("__v").alias("v")))["v"].cast("string")
    if method == "median_imputation":
        return quantile_scalars(source, ["__v"], [0.5])["__v"][0].cast("string")
    if method == "mode_imputation":
        return modes(df.select(col(column)), column).select("mode").scalar().cast("string")
    return None
