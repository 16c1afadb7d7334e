"""What to clean: issue lists and recommended actions, made from a profile.

Every function here but `outlier_report` works on profile rows, one per column of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col, is_numeric, num
from flatwork.functions.stats import moments
from flatwork.operators.cleaning.impute import IMPUTATION_METHODS
from flatwork.operators.cleaning.outliers import extremes
from flatwork.operators.profile import _first_of, duplicate_rows, local_copy, profile, with_approved
from flatwork.operators.projection import first_distinct_values
from flatwork.operators.quantiles import quantiles

# Approved types that allow or block outlier analysis, and their families.
OUTLIER_ALLOWED = [
    "continuous numeric", "numeric", "numerical", "float", "decimal", "currency / amount", "currency", "amount",
    "percentage", "ratio",
]
OUTLIER_BLOCKED = [
    "identifier", "id", "id like", "year", "month", "day", "date", "datetime", "time", "binary", "boolean",
    "categorical", "nominal", "ordinal", "ordinal / numeric category", "numeric category", "postal code", "zip code",
    "zipcode", "latitude", "longitude", "text", "review text", "ignore",
]
TYPE_FAMILIES = {
    "id_like": ["identifier", "id", "id like", "ignore"],
    "categorical": [
        "categorical", "category", "high cardinality categorical", "nominal", "postal code", "zip code", "zipcode",
        "city", "state", "country", "string", "binary", "boolean", "bool",
    ],
    "numeric_categorical": ["ordinal", "ordinal / numeric category", "numeric category", "discrete numeric"],
    "datetime": ["year", "month", "day", "date", "datetime", "datetime64[ns]", "time", "duration"],
    "text": [
        "text", "review text", "email", "phone", "url", "product code", "invoice number", "transaction id", "json",
        "mixed",
    ],
    "numeric": [
        "continuous numeric", "numeric", "numerical", "float", "float64", "integer", "int64", "decimal",
        "currency / amount", "currency", "amount", "percentage", "ratio", "latitude", "longitude",
    ],
}
POSTAL_HINTS = "zip|zipcode|zip_code|postal|postal_code|postcode|post_code|pincode|pin_code"


def _spelled(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_-]", " ")


def effective_type(approved: Column, detected: Column) -> Column:
    """The type cleaning works with: the approved one by family, else the detected one."""
    name = _spelled(F.coalesce(approved, detected))
    cases = [(name.isin(names), F.lit(family)) for family, names in TYPE_FAMILIES.items()]
    return _first_of(*cases, default=F.coalesce(detected, F.lit("review")))


def wants_outlier_check(approved: Column, detected: Column) -> Column:
    name = _spelled(F.coalesce(approved, detected))
    return F.when(name.isin(OUTLIER_BLOCKED), False).when(name.isin(OUTLIER_ALLOWED), True).otherwise(detected == "numeric")


def _approved(columns: DataFrame, overrides: DataFrame | None) -> DataFrame:
    if overrides is None:
        return columns.withColumn("approved_type", F.lit(None).cast("string"))
    return with_approved(columns, overrides).drop("effective_type")


def distribution_label(skewness: Column) -> Column:
    return _first_of(
        (skewness.isNull(), "Unknown"),
        (skewness >= 1, "Right Skewed"),
        (skewness >= 0.5, "Slight Right Skew"),
        (skewness <= -1, "Left Skewed"),
        (skewness <= -0.5, "Slight Left Skew"),
        default="Nearly Symmetric",
    )


def recommended_action(skewness: Column, kurtosis: Column, minimum: Column, percentage: Column) -> Column:
    """Keep, transform, cap or review, from the shape of a column and its outlier share."""
    bend, tail = F.abs(F.coalesce(skewness, F.lit(0.0))), F.coalesce(kurtosis, F.lit(0.0))
    return _first_of(
        ((percentage < 1) & (bend < 0.5) & (tail < 3), "keep_review"),
        ((skewness > 1) & (minimum > 0), "log_transform"),
        ((skewness > 1) & (minimum >= 0), "sqrt_transform"),
        (bend > 1, "yeojohnson_transform"),
        ((percentage > 10) & (tail >= 3), "winsorization"),
        default="review_extreme_values",
    )


# What the advice on a column with outliers is called, where it leads, why, and what else to use or avoid.
ACTION_LABELS = {
    "keep_review": "Keep / Review",
    "log_transform": "Forward Log Transform",
    "sqrt_transform": "Forward Square Root Transform",
    "yeojohnson_transform": "Forward Yeo-Johnson Transform",
    "winsorization": "Winsorize / Cap",
    "review_extreme_values": "Review Extremes",
}
OUTLIER_ADVICE = {
    "keep": (
        "Cleaning",
        "Low outlier percentage and almost symmetric distribution. Review only; no automatic deletion needed.",
        ("zscore_detection", "iqr_detection"),
        ("delete_outlier_rows",),
    ),
    "right": (
        "Feature Engineering",
        "Right-skewed distribution with outliers. Prefer transformation so information is preserved for modelling.",
        ("winsorization", "percentile_capping", "boxcox_transform"),
        ("delete_outlier_rows",),
    ),
    "left": (
        "Feature Engineering",
        "Left-skewed distribution. Use a transformation that can handle zero or negative values.",
        ("winsorization", "percentile_capping"),
        ("delete_outlier_rows",),
    ),
    "heavy": (
        "Cleaning",
        "High outlier share and heavy tails. Capping is safer than deleting many rows.",
        ("percentile_capping", "modified_zscore_detection"),
        ("delete_outlier_rows",),
    ),
    "review": (
        "Cleaning",
        "Outliers are present, but distribution statistics do not strongly justify automatic transformation or deletion. "
        "Confirm using min/max and extreme values.",
        ("iqr_detection", "zscore_detection", "winsorization"),
        ("delete_outlier_rows_without_review",),
    ),
}


def outlier_advice(action: Column, skewness: Column) -> dict[str, Column]:
    """What goes with a recommended action: label, destination, reason, alternatives and methods to avoid."""
    case = _first_of(
        (action == "keep_review", "keep"),
        (action == "winsorization", "heavy"),
        (action == "review_extreme_values", "review"),
        (skewness > 0, "right"),
        default="left",
    )
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    entries = [
        part
        for name, (place, reason, others, avoid) in OUTLIER_ADVICE.items()
        for part in (F.lit(name), F.struct(F.lit(place).alias("place"), F.lit(reason).alias("reason"), listed(others).alias("others"), listed(avoid).alias("avoid")))
    ]
    advice = F.create_map(*entries)[case]
    labels = F.create_map(*[F.lit(x) for pair in ACTION_LABELS.items() for x in pair])
    return {
        "recommended_label": labels[action],
        "recommended_destination": advice["place"],
        "recommendation_reason": advice["reason"],
        "alternative_methods": advice["others"],
        "avoid_methods": advice["avoid"],
    }


def outlier_method(kind: Column, skewness: Column, kurtosis: Column, percentage: Column) -> Column:
    """The method to preselect for a column."""
    return _first_of(
        (kind != "numeric", "ignore"),
        (percentage >= 30, "iqr_detection"),
        (F.abs(skewness) < 0.5, "zscore_detection"),
        (skewness.isNotNull(), "iqr_detection"),
        (kurtosis > 3, "modified_zscore_detection"),
        default="iqr_detection",
    )


def outlier_report(df: DataFrame, columns: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Numeric columns with values beyond the IQR fences, with figures, extremes and advice.

    Two passes over the data for all columns together: quantiles, then counts.
    """
    columns = local_copy(profile(df)) if columns is None else columns
    typed = _approved(columns, overrides)
    checked = typed.where(wants_outlier_check(F.col("approved_type"), F.col("detected_type")))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [r["column_name"] for r in checked.select("column_name").collect() if is_numeric(kinds[r["column_name"]])]
    if not names:
        rows = checked.limit(0).drop("outlier_count").withColumns({"low": F.lit(0.0), "high": F.lit(0.0), "outlier_count": F.lit(0).cast("long")})
        return _outlier_rows(rows.withColumns({c: F.array().cast("array<double>") for c in ("lowest_values", "highest_values")}))
    plain = df.select(*[num(df, c).alias(c) for c in names])
    quartiles = quantiles(plain, names, [0.25, 0.5, 0.75]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(f"q_{c}").alias("q")) for c in names
    ])).alias("f")).select("f.*")
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    fences = quartiles.where(q3 > q1).select(
        "column_name", F.get("q", F.lit(1)).alias("median"), (q1 - 1.5 * (q3 - q1)).alias("low"), (q3 + 1.5 * (q3 - q1)).alias("high")
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).alias("v")) for c in names])
    long = plain.select(F.explode(cells).alias("c")).select("c.*").where("v is not null")
    shape = moments(F.col("v"))
    # One row per column of the table: safe to send to every task.
    counts = (
        long.join(F.broadcast(fences), "column_name")
        .groupBy("column_name", "median", "low", "high")
        .agg(
            F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outlier_count"),
            *[shape[n].alias(n) for n in ("min", "max", "mean", "std", "variance", "skewness", "kurtosis")],
        )
        .where("outlier_count > 0")
    )
    kept = checked.select("column_name", "detected_type", "approved_type", "row_count")
    return _outlier_rows(kept.join(counts, "column_name").join(extremes(df, names), "column_name", "left"))


def _outlier_rows(rows: DataFrame) -> DataFrame:
    pct = F.try_divide(F.col("outlier_count") * 100.0, F.col("row_count"))
    action = recommended_action(F.col("skewness"), F.col("kurtosis"), F.col("min"), pct)
    return rows.select(
        "column_name", "detected_type", F.coalesce("approved_type", "detected_type").alias("schema_type"),
        F.lit("IQR").alias("method"), F.bround("low", 2).alias("lower_bound"), F.bround("high", 2).alias("upper_bound"),
        "outlier_count", F.bround(pct, 2).alias("outlier_percentage"),
        *[F.bround(c, 2).alias(n) for c, n in (("min", "min_value"), ("max", "max_value"))],
        *[F.bround(c, 2).alias(c) for c in ("mean", "median", "std", "variance", "skewness", "kurtosis")],
        "lowest_values", "highest_values",
        distribution_label(F.col("skewness")).alias("distribution_label"),
        action.alias("recommended_method"),
        *[c.alias(n) for n, c in outlier_advice(action, F.col("skewness")).items()],
        outlier_method(F.col("detected_type"), F.col("skewness"), F.col("kurtosis"), pct).alias("selected_method"),
    )


def _methods_of(kind: Column) -> Column:
    cases = [(kind == k, F.array(*[F.lit(m) for m in methods])) for k, methods in IMPUTATION_METHODS.items()]
    return _first_of(*cases, default=F.array(*[F.lit(m) for m in IMPUTATION_METHODS["review"]]))


def imputation_options(columns: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """For each column with missing values: the method to preselect and the ones on offer."""
    typed = _approved(columns, overrides).where("missing_count > 0")
    kind = effective_type(F.col("approved_type"), F.col("detected_type"))
    gap = F.abs(F.col("mean") - F.col("median")) / F.coalesce(F.nullif(F.abs("median"), F.lit(0.0)), F.lit(1.0))
    near = F.coalesce(gap < 0.25, F.lit(False)) & F.col("std").isNotNull()
    typed = typed.withColumn("kind", kind)
    k = F.col("kind")
    method = _first_of(
        (F.col("missing_percentage") >= 85, "missing_indicator"),
        ((k == "numeric") & near, "mean_imputation"),
        (k == "numeric", "median_imputation"),
        (k.isin("categorical", "numeric_categorical"), "mode_imputation"),
        (k == "text", "missing_token"),
        (k.isin("datetime", "id_like"), "missing_indicator"),
        default="manual_review",
    )
    typed = typed.withColumns({"selected_method": method, "offered": _methods_of(k)})
    offered = F.when(F.array_contains("offered", F.col("selected_method")), F.col("offered")).otherwise(
        F.concat(F.array("selected_method"), "offered")
    )
    return typed.select(
        "column_name", k.alias("detected_type"), "missing_count", "missing_percentage", "selected_method",
        offered.alias("available_methods"),
    )


def group_columns(columns: DataFrame, target: str) -> DataFrame:
    """Columns that can group an imputation of `target`, best first."""
    kinds = ["categorical", "numeric_categorical", "boolean"]
    fit = (F.col("column_name") != target) & F.col("detected_type").isin(kinds) & F.col("unique_count").between(2, 50)
    rows = columns.where(fit & (F.col("unique_ratio") < 0.5))
    chosen = rows.select("column_name", "detected_type", "unique_count", F.bround("unique_ratio", 4).alias("unique_ratio"))
    return chosen.orderBy("unique_count", "unique_ratio", "column_name")


def _issue(rows: DataFrame, code: str, action, safety: str, confidence: str | Column = "Medium", method=None) -> DataFrame:
    return rows.select(
        "column_name", "detected_type", F.lit(code).alias("issue_code"),
        (action if isinstance(action, Column) else F.lit(action)).alias("action_code"),
        (method if method is not None else F.lit(None).cast("string")).alias("selected_method"),
        F.lit(safety).alias("safety"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
    )


def type_issues(columns: DataFrame) -> DataFrame:
    rows = columns.where(F.col("detected_type").isin("id_like", "numeric_categorical", "review"))
    return _issue(rows, "DATATYPE_REVIEW_REQUIRED", "CONFIRM_COLUMN_TYPE", "Review")


def cardinality_issues(columns: DataFrame) -> DataFrame:
    many = (F.col("unique_count") > 50) | (F.col("unique_ratio") >= 0.5)
    rows = columns.where(F.col("detected_type").isin("categorical", "text", "numeric_categorical", "id_like") & many)
    return _issue(rows, "HIGH_CARDINALITY", "REVIEW_ENCODING_OR_COLUMN_TYPE", "Review")


def constant_issues(columns: DataFrame) -> DataFrame:
    return _issue(columns.where("unique_count = 1"), "CONSTANT_COLUMN", "DROP_COLUMN_CANDIDATE", "Safe", "High")


def datetime_issues(columns: DataFrame) -> DataFrame:
    rows = columns.where(F.col("detected_type") == "datetime")
    return _issue(rows, "DATETIME_COLUMN_DETECTED", "REVIEW_DATETIME_FEATURE_EXTRACTION", "Review")


def postal_issues(columns: DataFrame) -> DataFrame:
    many = (F.col("unique_count") > 50) | (F.col("unique_ratio") >= 0.5)
    action = F.when(many, "CONFIRM_IDENTIFIER_OR_CATEGORICAL").otherwise("CONFIRM_LOCATION_CATEGORY")
    rows = columns.where(F.lower("column_name").rlike(POSTAL_HINTS))
    return _issue(rows, "ZIPCODE_OR_POSTAL_CODE_DETECTED", action, "Review")


def anomaly_issue(columns: DataFrame) -> DataFrame:
    """The multivariate method that suits the table, when it has two numeric columns."""
    rows = columns.agg(F.max("row_count").alias("n"), F.count_if(F.col("detected_type") == "numeric").alias("d"))
    suits = (F.col("n") > F.col("d") * 10) & (F.col("d") <= 10)
    return _issue(
        rows.where("d >= 2").withColumns({"column_name": F.lit("Dataset"), "detected_type": F.lit(None).cast("string")}),
        "MULTIVARIATE_ANOMALY_CHECK_AVAILABLE", "REVIEW_DATASET_ANOMALIES", "Review", F.when(F.col("d") > 10, "High").otherwise("Medium"),
        method=F.when(suits, "mahalanobis_distance").otherwise("isolation_forest"),
    )


def recommendations(
    df: DataFrame,
    columns: DataFrame | None = None,
    overrides: DataFrame | None = None,
    sample_order: Sequence[str] = (),
) -> DataFrame:
    """Every issue of a table as one list, with evidence and the method to preselect."""
    columns = local_copy(profile(df)) if columns is None else columns
    missing = imputation_options(columns, overrides)
    outliers = local_copy(outlier_report(df, columns, overrides))  # one row per column, read three times
    duplicates = duplicate_rows(df).where("duplicate_row_count > 0").withColumns(
        {"column_name": F.lit("Dataset"), "detected_type": F.lit(None).cast("string")}
    )
    parts = [
        _issue(missing, "MISSING_VALUES", "REVIEW_IMPUTATION", "Review", method=F.col("selected_method")),
        _issue(duplicates, "DUPLICATE_ROWS", "REVIEW_DUPLICATE_REMOVAL", "Safe", "High"),
        _issue(outliers, "OUTLIERS_DETECTED", "REVIEW_OUTLIER_HANDLING", "Review", method=F.col("selected_method")),
        type_issues(columns), cardinality_issues(columns), constant_issues(columns), datetime_issues(columns),
        postal_issues(columns), anomaly_issue(columns),
    ]
    issues = reduce(DataFrame.unionByName, parts)
    evidence = columns.select(
        "column_name", "missing_count", "missing_percentage", "unique_count", "mean", "median", "min", "max", "std", "skewness"
    )
    found = outliers.select("column_name", "outlier_count", "outlier_percentage", "lower_bound", "upper_bound")
    out = issues.join(evidence, "column_name", "left").join(found, "column_name", "left")
    if sample_order:
        samples = first_distinct_values(df, df.columns, sample_order, 6).groupBy("column_name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
        )
        out = out.join(samples, "column_name", "left")
    return out


def report_summary(df: DataFrame, columns: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Totals of a cleaning report."""
    columns = local_copy(profile(df)) if columns is None else columns
    issues = recommendations(df, columns, overrides)
    of = F.col("issue_code")
    totals = issues.agg(
        F.coalesce(F.sum(F.when(of == "OUTLIERS_DETECTED", F.col("outlier_count"))), F.lit(0)).alias("outliers"),
        F.count_if(of == "DATATYPE_REVIEW_REQUIRED").alias("datatype_issues"),
        F.count("*").alias("recommendations"),
    )
    missing = columns.agg(F.coalesce(F.sum("missing_count"), F.lit(0))).scalar()
    repeated = duplicate_rows(df).select("duplicate_row_count").scalar()
    return totals.withColumns({"missing_values": missing, "duplicate_rows": repeated, "columns": F.lit(len(df.columns))})

