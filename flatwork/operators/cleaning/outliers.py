"""Outliers of single columns: bounds, previews, flags, capping, removal and transforms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col, num
from flatwork.functions.stats import share
from flatwork.operators.joins import one_row
from flatwork.operators.quantiles import quantile_scalars

# The methods offered for a column, and the rule each one is based on.
OUTLIER_METHODS = (
    "iqr_detection", "zscore_detection", "modified_zscore_detection", "iqr_capping", "zscore_removal",
    "percentile_capping", "winsorization", "log_transform", "ignore",
)
BASE_RULE = {
    "iqr_capping": "iqr_detection",
    "zscore_removal": "zscore_detection",
    "winsorization": "percentile_detection",
    "percentile_capping": "percentile_detection",
}
RULES = ("iqr_detection", "zscore_detection", "modified_zscore_detection", "percentile_detection")
TRANSFORMS = ("log_transform", "sqrt_transform", "cube_root_transform", "boxcox_transform", "yeojohnson_transform")
NO_CHANGE = ("keep_review", "review_extreme_values", "ignore", "iqr_detection", "zscore_detection", "modified_zscore_detection")


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(num(df, column).alias("v"))


def _spread(values: DataFrame) -> tuple[Column, Column]:
    stats = one_row(values.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")))
    return stats["m"], stats["s"]


def _median_deviation(values: DataFrame) -> tuple[Column, Column]:
    median = quantile_scalars(values, ["v"], [0.5])["v"][0]
    deviations = values.select(F.abs(F.col("v") - median).alias("v"))
    return median, quantile_scalars(deviations, ["v"], [0.5])["v"][0]


def bounds(df: DataFrame, column: str, rule: str, params: dict | None = None) -> tuple[Column, Column]:
    """Lowest and highest value that is no outlier, as scalar columns; null where the rule cannot tell."""
    params, values = params or {}, _values(df, column)
    rule = BASE_RULE.get(rule, rule)
    if rule == "iqr_detection":
        q1, q3 = quantile_scalars(values, ["v"], [0.25, 0.75])["v"]
        reach = F.lit(float(params.get("iqr_multiplier", 1.5))) * F.nullif(q3 - q1, F.lit(0.0))
        return q1 - reach, q3 + reach
    if rule == "zscore_detection":
        mean, std = _spread(values)
        reach = F.lit(float(params.get("zscore_threshold", 3))) * F.nullif(std, F.lit(0.0))
        return mean - reach, mean + reach
    if rule == "modified_zscore_detection":
        median, mad = _median_deviation(values)
        reach = F.lit(float(params.get("modified_zscore_threshold", 3.5))) / 0.6745 * F.nullif(mad, F.lit(0.0))
        return median - reach, median + reach
    if rule == "percentile_detection":
        probs = [float(params.get("lower_percentile", 0.01)), float(params.get("upper_percentile", 0.99))]
        low, high = quantile_scalars(values, ["v"], probs)["v"]
        return low, high
    raise ValueError(f"Unsupported outlier rule: {rule}")


def _outside(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def preview_outliers(df: DataFrame, column: str, method: str, params: dict | None = None) -> DataFrame:
    """How many values a method would touch: one row. Transforms and `ignore` touch none."""
    rule = BASE_RULE.get(method, method)
    if rule in (*TRANSFORMS, "ignore"):
        low = high = F.lit(None).cast("double")
    else:
        low, high = bounds(df, column, rule, params)
    shown = rule in ("iqr_detection", "percentile_detection")
    return (
        _values(df, column)
        .where("v is not null")
        .withColumns({"low": low, "high": high})
        .agg(
            F.count_if(_outside(F.col("v"), F.col("low"), F.col("high"))).alias("outlier_count"),
            F.count("*").alias("total_count"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
        )
        .select(
            F.lit(method).alias("method"),
            F.lit(rule).alias("preview_method"),
            "outlier_count",
            share(F.col("outlier_count"), F.col("total_count")).alias("outlier_percentage"),
            (F.bround("low", 2) if shown else F.lit(None).cast("double")).alias("lower_bound"),
            (F.bround("high", 2) if shown else F.lit(None).cast("double")).alias("upper_bound"),
        )
    )


def flag_outliers(df: DataFrame, column: str, method: str = "iqr_detection", params: dict | None = None, out: str | None = None) -> DataFrame:
    """Add a 0/1 column; missing values are no outliers."""
    low, high = bounds(df, column, method, params)
    return df.withColumn(out or f"{column}_is_outlier", _outside(num(df, column), low, high).cast("int"))


def _clip(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def cap(df: DataFrame, column: str, method: str, params: dict | None = None) -> DataFrame:
    """Clip to the bounds of a rule. With no spread an IQR cap leaves the one value everything equals."""
    params, value = params or {}, num(df, column)
    if method == "iqr_capping":
        q1, q3 = quantile_scalars(_values(df, column), ["v"], [0.25, 0.75])["v"]
        reach = F.lit(float(params.get("iqr_multiplier", 1.5))) * (q3 - q1)
        return df.withColumn(column, _clip(value, q1 - reach, q3 + reach))
    low, high = bounds(df, column, method, params)
    return df.withColumn(column, _clip(value, low, high))


def remove_by_zscore(df: DataFrame, column: str, threshold: float = 3) -> DataFrame:
    """Drop rows beyond the threshold; missing values stay, and so does everything without spread."""
    mean, std = _spread(_values(df, column))
    z = F.abs(F.try_divide(num(df, column) - mean, std))
    return df.where(F.coalesce(z <= float(threshold), F.lit(True)))


def winsorize(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.01) -> DataFrame:
    """The lowest and highest shares of present values become the nearest kept value."""
    values = _values(df, column).where("v is not null")
    n = values.count()
    if n < 2:
        return df.withColumn(column, num(df, column))
    ranks = [math.floor(n * lower), n - math.floor(n * upper) - 1]
    near = quantile_scalars(values, ["v"], [r / (n - 1) for r in ranks])["v"]
    # The quantile sits on the order statistic up to rounding; take the value of the table itself.
    found = one_row(values.withColumns({"a": near[0], "b": near[1]}).agg(
        F.min_by("v", F.abs(F.col("v") - F.col("a"))).alias("low"), F.min_by("v", F.abs(F.col("v") - F.col("b"))).alias("high")
    ))
    return df.withColumn(column, _clip(num(df, column), found["low"], found["high"]))


def _boxcox(v: Column, p: float) -> Column:
    x = F.when(v > 0, v)
    return F.log(x) if abs(p) < 1e-9 else (F.pow(x, F.lit(p)) - 1) / p


def _yeojohnson(v: Column, p: float) -> Column:
    up = F.log1p(v) if abs(p) < 1e-9 else (F.pow(v + 1, F.lit(p)) - 1) / p
    down = -F.log1p(-v) if abs(p - 2) < 1e-9 else -(F.pow(1 - v, F.lit(2 - p)) - 1) / (2 - p)
    return F.when(v >= 0, up).otherwise(F.when(v < 0, down))


def best_power(df: DataFrame, column: str, kind: str) -> float | None:
    """The maximum-likelihood exponent, to half a hundredth.

    One aggregate gives the likelihood on a grid of 21 exponents. While the best one stands on the grid's edge the grid
    moves there and doubles its width, so any optimum ends up inside; then the grid becomes finer around it. None where
    no exponent has a likelihood (no or one value); an error where powers leave the range of doubles on the way.
    """
    transform = _boxcox if kind == "boxcox_transform" else _yeojohnson
    values = _values(df, column).where("v > 0" if kind == "boxcox_transform" else "v is not null")
    jacobian = F.log("v") if kind == "boxcox_transform" else F.signum("v") * F.log1p(F.abs("v"))
    center, step = 0.0, 0.5
    for _ in range(64):
        grid = [round(center + step * i, 3) for i in range(-10, 11)]
        row = values.agg(
            F.count("*").alias("n"), F.sum(jacobian).alias("j"),
            *[F.var_pop(transform(F.col("v"), p)).alias(f"g{i}") for i, p in enumerate(grid)],
        ).first()
        fits = [
            (-0.5 * row["n"] * math.log(row[f"g{i}"]) + (p - 1) * row["j"], i)
            for i, p in enumerate(grid) if row[f"g{i}"] and 0 < row[f"g{i}"] < math.inf
        ]
        if not fits:
            return None
        at = max(fits)[1]
        inside = {at - 1, at + 1} <= {i for _, i in fits}
        if not inside and (0 < at < len(grid) - 1 or step > 1e3):
            break
        center = grid[at]
        if not inside:
            step *= 2
        elif step <= 0.005:
            return center
        else:
            step = max(step / 10, 0.005)
    raise ValueError(f"The best power of '{column}' lies beyond what doubles can hold.")


def transform(df: DataFrame, column: str, method: str, out: str | None = None, power: float | None = None) -> DataFrame:
    """A shape-changing transform as a new column; values outside its domain become null."""
    v, out = num(df, column), out or f"{column}_{method.removesuffix('_transform')}"
    if method == "log_transform":
        return df.withColumn(out, F.when(v > 0, F.log(v)))
    if method == "sqrt_transform":
        return df.withColumn(out, F.when(v >= 0, F.sqrt(v)))
    if method == "cube_root_transform":
        return df.withColumn(out, F.cbrt(v))
    if method not in TRANSFORMS:
        raise ValueError(f"Unsupported transform: {method}")
    power = best_power(df, column, method) if power is None else power
    if power is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (_boxcox if method == "boxcox_transform" else _yeojohnson)(v, power))


def handle_outliers(df: DataFrame, column: str, method: str, params: dict | None = None) -> DataFrame:
    """Apply one method to one column. Detection, review and forwarded transforms change nothing."""
    params = params or {}
    if column not in df.columns:
        raise ValueError(f"Column '{column}' does not exist.")
    if method in (*NO_CHANGE, *TRANSFORMS):
        return df
    if method in ("iqr_capping", "percentile_capping"):
        return cap(df, column, method, params)
    if method == "zscore_removal":
        return remove_by_zscore(df, column, params.get("zscore_threshold", 3))
    if method == "winsorization":
        return winsorize(df, column, params.get("lower_limit", 0.01), params.get("upper_limit", 0.01))
    raise ValueError(f"Unsupported outlier method: {method}")


def extremes(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The n lowest and highest values of many columns: arrays, one row per column."""
    from pyspark.sql import Window as W

    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), num(df, c).alias("v")) for c in columns])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null")
    sides = []
    for name, order in (("lowest_values", F.col("v")), ("highest_values", F.desc("v"))):
        ranked = long.withColumn("rank", F.row_number().over(W.partitionBy("column_name").orderBy(order))).where(F.col("rank") <= n)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda s: F.bround(s["v"], 2))
        sides.append(ranked.groupBy("column_name").agg(listed.alias(name)))
    return sides[0].join(sides[1], "column_name")
