"""Row filters given as rules: {"column", "operator", "value", "value2"}, ANDed in order.

Comparisons on native numeric columns stay plain `column > literal`, so they reach the file scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flatwork.functions.coerce import TEMPORAL, col, column_type, num, text, ts

# The accepted spellings of each operator.
OPERATOR_ALIASES = {
    "=": "equals",
    "==": "equals",
    "eq": "equals",
    "!=": "not_equals",
    "<>": "not_equals",
    "ne": "not_equals",
    "startswith": "starts_with",
    "endswith": "ends_with",
    ">": "greater_than",
    "gt": "greater_than",
    "<": "less_than",
    "lt": "less_than",
    ">=": "greater_equal",
    "gte": "greater_equal",
    "<=": "less_equal",
    "lte": "less_equal",
    "null": "is_null",
    "is_not_null": "not_null",
    "daterange": "date_range",
}


def operator_name(raw) -> str | None:
    if raw is None:
        return None
    key = str(raw).strip().lower().replace(" ", "_").replace("-", "_")
    return OPERATOR_ALIASES.get(key, key)


def normalize_rule(rule: dict) -> dict:
    """One shape for every spelling of a rule."""
    if not isinstance(rule, dict):
        raise ValueError("A filter rule must be a mapping.")
    return {
        "column": rule.get("column") or rule.get("field") or rule.get("name"),
        "operator": operator_name(rule.get("operator") or rule.get("op") or rule.get("condition")),
        "value": rule.get("value"),
        "value2": rule.get("value2") or rule.get("end_value"),
        "scope": rule.get("scope") or "visual",
    }


def _as_number(value, operator: str) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = float("nan")
    if number != number:
        raise ValueError(f"Operator '{operator}' needs a numeric value.")
    return number


def _as_time(value) -> Column:
    if not isinstance(value, datetime):
        try:
            value = datetime.fromisoformat(str(value).strip())
        except ValueError:
            raise ValueError(f"'{value}' is not a date.") from None
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _literal(df: DataFrame, name: str, value) -> Column | None:
    """The value in the column's own type, or None where the two can never be equal."""
    dtype = column_type(df, name)
    if isinstance(value, bool):
        return F.lit(value) if isinstance(dtype, T.BooleanType) else None
    if isinstance(dtype, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(dtype, T.NumericType):
        return F.lit(value) if isinstance(value, (int, float)) else None
    if isinstance(dtype, TEMPORAL):
        try:
            return _as_time(value)
        except ValueError:
            return None
    return F.lit(value)


def _equal(df, rule) -> Column:
    value = _literal(df, rule["column"], rule["value"])
    return F.lit(False) if value is None else col(rule["column"]) == value


def _member(df, rule) -> Column:
    if not isinstance(rule["value"], (list, tuple)):
        raise ValueError(f"Operator '{rule['operator']}' needs a list.")
    values = [_literal(df, rule["column"], v) for v in rule["value"]]
    values = [v for v in values if v is not None]
    return col(rule["column"]).isin(values) if values else F.lit(False)


def _matches(df, rule) -> Column:
    return F.coalesce(text(df, rule["column"]).rlike("(?i)" + str(rule["value"])), F.lit(False))


def _compare(df, rule, how: Callable[[Column, Column], Column]) -> Column:
    name, limit = rule["column"], F.lit(_as_number(rule["value"], rule["operator"]))
    dtype = column_type(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # NaN counts as missing; a plain comparison next to it can still be pushed down.
        return how(col(name), limit) & ~F.isnan(col(name))
    if isinstance(dtype, T.NumericType):
        return how(col(name), limit)
    return how(num(df, name), limit)


def _between(df, rule) -> Column:
    low = _compare(df, rule, lambda c, v: c >= v)
    high = _compare(df, {**rule, "value": rule["value2"]}, lambda c, v: c <= v)
    return low & high


def _date_range(df, rule) -> Column:
    if rule["value"] is None and rule["value2"] is None:
        raise ValueError("A date range needs a start or an end.")
    when = ts(df, rule["column"])
    parts = [when.isNotNull()]
    if rule["value"] is not None:
        parts.append(when >= _as_time(rule["value"]))
    if rule["value2"] is not None:
        parts.append(when <= _as_time(rule["value2"]))
    return reduce(lambda a, b: a & b, parts)


PREDICATES: dict[str, Callable[[DataFrame, dict], Column]] = {
    "equals": _equal,
    "not_equals": lambda df, r: ~F.coalesce(_equal(df, r), F.lit(False)),
    "contains": _matches,
    "not_contains": lambda df, r: ~_matches(df, r),
    "starts_with": lambda df, r: text(df, r["column"]).startswith(str(r["value"])),
    "ends_with": lambda df, r: text(df, r["column"]).endswith(str(r["value"])),
    "greater_than": lambda df, r: _compare(df, r, lambda c, v: c > v),
    "less_than": lambda df, r: _compare(df, r, lambda c, v: c < v),
    "greater_equal": lambda df, r: _compare(df, r, lambda c, v: c >= v),
    "less_equal": lambda df, r: _compare(df, r, lambda c, v: c <= v),
    "between": _between,
    "in": _member,
    "not_in": lambda df, r: ~F.coalesce(_member(df, r), F.lit(False)),
    "is_null": lambda df, r: col(r["column"]).isNull(),
    "not_null": lambda df, r: col(r["column"]).isNotNull(),
    "date_range": _date_range,
}


def predicate(df: DataFrame, rule: dict) -> Column:
    """The boolean column of one rule; raises for an unknown column, operator or bad value."""
    rule = normalize_rule(rule)
    if not rule["column"]:
        raise ValueError("A filter rule needs a column.")
    if rule["column"] not in df.columns:
        raise ValueError(f"Column '{rule['column']}' does not exist.")
    if rule["operator"] not in PREDICATES:
        raise ValueError(f"Unsupported filter operator: {rule['operator']}")
    return PREDICATES[rule["operator"]](df, rule)


def apply_filters(df: DataFrame, rules: Sequence[dict] | None) -> DataFrame:
    for rule in rules or []:
        df = df.where(predicate(df, rule))
    return df


def dashboard_rules(rules: Sequence[dict] | None, scope: str = "dashboard") -> list[dict]:
    """Normalize dashboard rules, drop unknown operators and mark the scope."""
    kept = [normalize_rule(r) for r in rules or [] if isinstance(r, dict)]
    return [{**r, "scope": scope} for r in kept if r["column"] and r["operator"] in PREDICATES]


def apply_interactions(
    df: DataFrame,
    dashboard: Sequence[dict] | None = None,
    cross: Sequence[dict] | None = None,
    drill: Sequence[dict] | None = None,
) -> DataFrame:
    """Dashboard, cross-chart and drill filters, one after the other."""
    for rules in (dashboard, cross, drill):
        df = apply_filters(df, dashboard_rules(rules))
    return df


def drill_column(path: Sequence[str], level: int) -> str:
    """The column of a drill path at a level, clamped to the path."""
    if not path:
        raise ValueError("A drill path needs at least one column.")
    return path[min(max(int(level), 0), len(path) - 1)]
