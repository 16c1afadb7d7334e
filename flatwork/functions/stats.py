"""Statistics with the small-sample conventions of the data-analysis world.

Spark's skewness and kurtosis are population values; the reports use the bias-corrected ones.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unbiased_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    corrected = F.when(
        F.stddev_pop(c) > 0, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    ).otherwise(0.0)
    return F.when(n > 2, corrected)


def unbiased_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    scale = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = F.when(F.stddev_pop(c) > 0, (n - 1) / scale * ((n + 1) * F.kurtosis(c) + 6)).otherwise(0.0)
    return F.when(n > 3, corrected)


def moments(c: Column) -> dict[str, Column]:
    """The single-pass statistics of one numeric column."""
    return {
        "count": F.count(c),
        "mean": F.avg(c),
        "std": F.stddev_samp(c),
        "variance": F.var_samp(c),
        "min": F.min(c),
        "max": F.max(c),
        "range": F.max(c) - F.min(c),
        "skewness": unbiased_skewness(c),
        "kurtosis": unbiased_kurtosis(c),
        "zero_count": F.count_if(c == 0),
        "negative_count": F.count_if(c < 0),
    }


def moments_sql(c: str) -> dict[str, str]:
    """The same statistics of a column as expression texts, for one aggregate over many columns."""
    n, spread = f"CAST(count({c}) AS DOUBLE)", f"stddev_pop({c}) > 0"
    skewness = f"skewness({c}) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0.0D)"
    kurtosis = f"({n} - 1) / nullif(({n} - 2) * ({n} - 3), 0.0D) * (({n} + 1) * kurtosis({c}) + 6)"
    return {
        "count": f"count({c})",
        "mean": f"avg({c})",
        "std": f"stddev_samp({c})",
        "variance": f"var_samp({c})",
        "min": f"min({c})",
        "max": f"max({c})",
        "range": f"max({c}) - min({c})",
        "skewness": f"CASE WHEN {n} > 2 THEN CASE WHEN {spread} THEN {skewness} ELSE 0.0D END END",
        "kurtosis": f"CASE WHEN {n} > 3 THEN CASE WHEN {spread} THEN {kurtosis} ELSE 0.0D END END",
        "zero_count": f"count_if({c} = 0)",
        "negative_count": f"count_if({c} < 0)",
    }


def share(part: Column, total: Column, digits: int = 2) -> Column:
    """Percentage with half-even rounding, 0 for an empty total."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, total), digits), F.lit(0.0))
