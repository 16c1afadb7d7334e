"""Before and after: the same statistics of two tables, matched by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flatwork.functions.coerce import col, num
from flatwork.functions.stats import share
from flatwork.operators import eda
from flatwork.operators.profile import missing_counts, summary
from flatwork.operators.joins import one_row
from flatwork.operators.quantiles import quantiles


def _sides(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full join of two small statistics tables, columns named *_before and *_after."""
    names = [c for c in before.columns if c not in on]
    left = before.withColumnsRenamed({c: f"{c}_before" for c in names})
    right = after.withColumnsRenamed({c: f"{c}_after" for c in names})
    return left.join(right, list(on), "full")


def missing_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing count and percentage per column, and how far the percentage fell."""
    stats = [missing_counts(d).drop("row_count") for d in (before, after)]
    gain = F.col("missing_percentage_before") - F.col("missing_percentage_after")
    return _sides(*stats, ["column_name"]).withColumn("improvement", gain)


def outlier_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """IQR outliers of each column and their share of present values."""
    plain = df.select(*[num(df, c).alias(c) for c in columns])
    wide = one_row(quantiles(plain, columns, [0.25, 0.75]))
    cells = []
    for c in columns:
        q1, q3 = F.get(wide[f"q_{c}"], F.lit(0)), F.get(wide[f"q_{c}"], F.lit(1))
        reach = 1.5 * (q3 - q1)
        cells.append(F.struct(F.lit(c).alias("column_name"), col(c).alias("v"), (q1 - reach).alias("low"), (q3 + reach).alias("high")))
    long = plain.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v is not null")
    outside = F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")))
    return long.groupBy("column_name").agg(outside.alias("outlier_count"), share(outside, F.count("*")).alias("outlier_percentage"))


def outlier_comparison(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    both = _sides(outlier_counts(before, columns), outlier_counts(after, columns), ["column_name"])
    return both.withColumn("change", F.col("outlier_count_after") - F.col("outlier_count_before"))


def distribution_change(before: DataFrame, after: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Counts of both tables over the same left-closed bins."""
    bins = eda.clamp(bins, 2, 100, 12)
    b, a = (d.select(num(d, column).alias("v")).where("v is not null") for d in (before, after))
    found = [r for r in (eda.value_range(b), eda.value_range(a)) if r]
    low, high = min((r[0] for r in found), default=0.0), max((r[1] for r in found), default=1.0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    number = eda.bin_number(F.col("v"), low, high, bins, closed_right=False)
    every = before.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    sides = [d.groupBy(number.alias("bin")).agg(F.count("*").alias(n)) for d, n in ((b, "count_before"), (a, "count_after"))]
    out = every.join(sides[0], "bin", "left").join(sides[1], "bin", "left").na.fill(0, ["count_before", "count_after"])
    step = F.lit((high - low) / bins)
    return out.withColumns({"bin_start": F.lit(low) + (F.col("bin") - 1) * step, "bin_end": F.lit(low) + F.col("bin") * step})


def correlation_shift(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson values of both tables and their difference."""
    sides = [eda.correlation(d, columns, undefined=None) for d in (before, after)]
    both = _sides(*sides, ["x_column", "y_column"])
    return both.withColumn("delta", F.col("value_after") - F.col("value_before"))


def feature_validation(before: DataFrame, after: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """New columns of `after`: missing, distinct, and their correlation with a numeric target."""
    names = list(features or [c for c in after.columns if c not in before.columns])
    row = after.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(c not in before.columns).alias("is_new"),
                 (F.col("rows") - F.col(f"n{i}")).alias("missing_count"), F.lit(i).alias("j"))
        for i, c in enumerate(names)
    ])
    rows = row.select(F.explode(cells).alias("c")).select("c.*")
    if target:
        # The target goes first, so its pairs are those with i = 0.
        work = after.select(num(after, target).alias("c0"), *[num(after, c).alias(f"c{i}") for i, c in enumerate(names, 1)])
        related = eda.pair_correlations(work, len(names) + 1).where("i = 0 AND j > 0")
        rows = rows.join(related.select((F.col("j") - 1).alias("j"), F.col("value").alias("target_correlation")), "j", "left")
    else:
        rows = rows.withColumn("target_correlation", F.lit(None).cast("double"))
    rows = rows.select("column_name", "is_new", "missing_count", "target_correlation")
    from flatwork.operators.aggregate import frequencies

    distinct = frequencies(after, names).groupBy("column_name").agg(F.count("*").alias("unique_count"))
    return rows.join(distinct, "column_name", "left").na.fill(0, ["unique_count"])


def validation_summary(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of both tables: rows, missing cells, duplicate rows, outliers, quality; and the quality gain."""
    def totals(df: DataFrame, stage: str) -> DataFrame:
        outliers = outlier_counts(df, columns).agg(F.coalesce(F.sum("outlier_count"), F.lit(0))).scalar()
        return summary(df).withColumns({"outliers": outliers, "stage": F.lit(stage)})

    rows = totals(before, "before").unionByName(totals(after, "after"))
    was = rows.agg(F.max(F.when(F.col("stage") == "before", F.col("quality_score")))).scalar()
    shown = ["stage", "row_count", "column_count", "total_missing_cells", "duplicate_row_count", "outliers", "quality_score"]
    return rows.select(*shown, (F.col("quality_score") - was).alias("quality_gain"))
