"""A chart request, given as one dictionary, as the DataFrame behind the chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flatwork.functions.calc import calculated_fields, dependency_columns
from flatwork.functions.coerce import num
from flatwork.operators import aggregate as A
from flatwork.operators import eda
from flatwork.operators import projection as P
from flatwork.operators.filters import apply_filters

GROUPED = ("bar", "horizontal_bar", "grouped_bar", "stacked_bar", "line", "area", "combo", "pie", "donut")
SUPPORTED = (
    *GROUPED, "scatter", "bubble", "histogram", "box", "box_plot", "heatmap", "correlation_heatmap", "map", "symbol_map",
    "kpi", "table", "pivot_table",
)
# Request keys that name a column.
COLUMN_KEYS = (
    "x_column", "dimension", "y_column", "measure", "value_column", "size_column", "color_by_column", "group_by_column",
    "latitude_column", "lat_column", "longitude_column", "lon_column", "lng_column", "location_column",
    "secondary_y_column", "sort_by",
)


def _get(request: dict, *names: str):
    """The first given value among the names, in the request and then in its settings."""
    for place in (request, request.get("settings_json") or {}):
        for n in names:
            if place.get(n) not in (None, ""):
                return place[n]
    return None


def chart_type(request: dict) -> str:
    kind = str(request.get("chart_type") or "bar").strip().lower()
    if kind not in SUPPORTED:
        raise ValueError(f"Chart type '{kind}' is not supported.")
    return kind


def series(request: dict) -> list[tuple[str, str]]:
    """The measures of a request as (column, aggregation): listed series, then y, then the second axis."""
    default = _get(request, "aggregation")
    listed = _get(request, "multi_series", "series") or []
    given = [(s.get("column"), s.get("aggregation") or default) for s in listed if isinstance(s, dict)]
    given.append((_get(request, "y_column", "measure"), default))
    given.append((_get(request, "secondary_y_column"), _get(request, "secondary_aggregation") or default))
    chosen: dict[str, str] = {}
    for column, how in given:
        name = str(column or "").strip()
        if name:
            chosen.setdefault(name, A.aggregation_name(how))
    return list(chosen.items())


def required_columns(request: dict, available: Sequence[str]) -> list[str]:
    """The table columns a request reads; none listed for a table or correlation means all."""
    listed = [c for c in _get(request, "columns", "selected_columns") or []]
    filtered = [r.get("column") or r.get("field") for r in request.get("filters") or [] if isinstance(r, dict)]
    if chart_type(request) in ("table", "correlation_heatmap"):
        if not listed:
            return list(available)
        named = [*listed, *filtered]
    else:
        named = [_get(request, k) for k in COLUMN_KEYS] + [c for c, _ in series(request)] + filtered
    for field in request.get("calculated_fields") or []:
        named += dependency_columns(str(field.get("expression") or ""), available)
    return [c for c in available if c in set(filter(None, named))]


def _need(df: DataFrame, name, label: str) -> str:
    if not name:
        raise ValueError(f"{label} is required for this chart.")
    if name not in df.columns:
        raise ValueError(f"{label} '{name}' was not found.")
    return name


def check_numbers(df: DataFrame, names: Sequence[str]) -> None:
    """Raise for a column without a single number; one aggregate for all of them."""
    from pyspark.sql import functions as F

    row = df.agg(*[F.count(num(df, c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    for i, c in enumerate(names):
        if not row[f"n{i}"]:
            raise ValueError(f"Column '{c}' holds no numeric values.")


def chart(df: DataFrame, request: dict, key: Sequence[str] = ()) -> DataFrame:
    """The rows of a chart. `key` identifies a row: it fixes which rows samples and first rows are."""
    kind = chart_type(request)
    work = apply_filters(calculated_fields(df, request.get("calculated_fields")), request.get("filters"))
    x = _get(request, "x_column", "dimension")
    y = _get(request, "y_column", "measure")
    color = _get(request, "color_by_column", "group_by_column")
    how = _get(request, "aggregation")
    limit = _get(request, "top_n", "limit")
    if kind in GROUPED:
        return A.grouped_chart(
            work, _need(work, x, "X axis"), [( _need(work, c, "Measure"), a) for c, a in series(request)],
            color and _need(work, color, "Color"), A.clamp(limit, 1, 100, 20) if limit else None, _get(request, "sort_by"),
            _get(request, "sort_order") or "descending", kind, A.aggregation_name(how),
        )
    if kind in ("scatter", "bubble"):
        return P.scatter(
            work, _need(work, x, "X axis"), _need(work, y, "Y axis"), key, _get(request, "size_column"), color, limit, bubble=kind == "bubble"
        )
    if kind == "histogram":
        value = _need(work, _get(request, "value_column") or x or y, "Histogram column")
        return eda.histogram(work, value, _get(request, "bins"), color)
    if kind in ("box", "box_plot"):
        return eda.box_chart(work, _need(work, y, "Box value"), x and _need(work, x, "Box category"), limit)
    if kind in ("heatmap", "pivot_table"):
        value = _get(request, "y_column", "value_column", "measure")
        make = A.heatmap if kind == "heatmap" else A.pivot_table
        return make(work, _need(work, x, "X axis"), _need(work, color, "Group"), value and _need(work, value, "Value"), how or "count")
    if kind == "correlation_heatmap":
        return eda.correlation(work, _get(request, "columns", "selected_columns"), _get(request, "max_columns"))
    if kind == "kpi":
        value = _need(work, _get(request, "y_column", "value_column", "measure", "size_column"), "KPI value")
        return A.kpi(work, value, how or "sum", request.get("title"), key)
    if kind == "table":
        return P.table_chart(work, _get(request, "columns", "selected_columns"), limit, key)
    value = _get(request, "y_column", "value_column", "measure", "size_column")
    lat, lon = _get(request, "latitude_column", "lat_column"), _get(request, "longitude_column", "lon_column", "lng_column")
    place = _get(request, "location_column") or x
    if lat and lon:
        return P.scatter(work, _need(work, lat, "Latitude"), _need(work, lon, "Longitude"), key, value, color, limit, 2000)
    if not place:
        raise ValueError("A map needs a location column or coordinates.")
    return A.location_map(work, _need(work, place, "Location"), value, how or "sum", limit)
