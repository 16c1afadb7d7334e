"""A list of user-approved actions, folded over a table, with a log of each."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

from flatwork.operators.cleaning.anomaly import flag_anomalies
from flatwork.operators.cleaning.impute import impute
from flatwork.operators.cleaning.outliers import TRANSFORMS, handle_outliers

LOG_SCHEMA = "step int, action string, issue_code string, column_name string, method string, params string"


def apply_actions(
    df: DataFrame, actions: Sequence[dict] | None, order_by: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and its action log. Unknown issue codes are logged and skipped."""
    logs = []
    for step, action in enumerate(actions or [], 1):
        code, column, method = action.get("issue_code"), action.get("column_name"), action.get("selected_method")
        params = action.get("params") or {}
        kind = "ignored_or_not_implemented"
        if code == "MISSING_VALUES":
            kind = method if method in ("drop_rows", "drop_column") else "imputation"
            df = impute(
                df, column, method, action.get("custom_value"), action.get("group_column"), action.get("time_column"),
                action.get("order_by") or order_by, params,
            )
        elif code == "OUTLIERS_DETECTED":
            kind = "forward_to_feature_engineering" if method in TRANSFORMS else "outlier_handling"
            df = handle_outliers(df, column, method, params)
        elif code == "DUPLICATE_ROWS":
            kind = "remove_duplicates"
            df = df.dropDuplicates()
        elif code == "MULTIVARIATE_ANOMALY_CHECK_AVAILABLE":
            kind = "dataset_anomaly_detection"
            df = flag_anomalies(df, action.get("columns"), method, params)
        logs.append((step, kind, code, column, method, json.dumps(params, sort_keys=True)))
    return df, df.sparkSession.createDataFrame(logs, LOG_SCHEMA)
