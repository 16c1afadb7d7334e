"""One query per filter operator, on tables with missing values."""

from flatwork.operators import filters as R
from flatwork.operators.aggregate import grouped_chart
from flatwork.queries.registry import register

SPARSE = "SELECT id, grp, val FROM sparse WHERE "
NUM = (
    "CASE WHEN regexp_matches(trim(amount_text), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
    "THEN TRY_CAST(trim(amount_text) AS DOUBLE) END"
)


def _sparse(rule):
    return lambda df: R.apply_filters(df, [rule]).select("id", "grp", "val")


def _rule(column, operator, value=None, value2=None):
    return {"column": column, "operator": operator, "value": value, "value2": value2}


SPARSE_RULES = {
    "equals": (_rule("grp", "equals", "1-URGENT"), "grp = '1-URGENT'"),
    "not_equals": (_rule("grp", "!=", "1-URGENT"), "grp IS DISTINCT FROM '1-URGENT'"),
    "contains": (_rule("grp", "contains", "u.G"), "regexp_matches(grp, '(?i)u.G')"),
    "not_contains": (_rule("grp", "not contains", "urgent"), "NOT coalesce(regexp_matches(grp, '(?i)urgent'), false)"),
    "starts_with": (_rule("grp", "startswith", "3"), "starts_with(grp, '3')"),
    "ends_with": (_rule("grp", "ends-with", "HIGH"), "grp LIKE '%HIGH'"),
    "greater_than": (_rule("val", ">", 150000), "val > 150000"),
    "less_than": (_rule("val", "lt", "50000"), "val < 50000"),
    "greater_equal": (_rule("val", ">=", 150000), "val >= 150000"),
    "less_equal": (_rule("val", "lte", 50000), "val <= 50000"),
    "between": (_rule("val", "between", 50000, 150000), "val BETWEEN 50000 AND 150000"),
    "in": (_rule("grp", "in", ["1-URGENT", "2-HIGH"]), "grp IN ('1-URGENT', '2-HIGH')"),
    "not_in": (_rule("grp", "not_in", ["1-URGENT", "2-HIGH"]), "grp IS NULL OR grp NOT IN ('1-URGENT', '2-HIGH')"),
    "is_null": (_rule("val", "null"), "val IS NULL"),
    "not_null": (_rule("val", "is_not_null"), "val IS NOT NULL"),
    "date_range": (
        _rule("ts", "date_range", "1996-01-01", "1996-12-31"),
        "ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1996-12-31'",
    ),
}
for _name, (_r, _where) in SPARSE_RULES.items():
    register(f"filter_{_name}", "sparse", _sparse(_r), SPARSE + _where)

register(
    "filter_date_range_open_end",
    "sparse",
    lambda df: R.apply_filters(df, [_rule("ts", "daterange", "1997-06-01")]).select("id", "grp"),
    "SELECT id, grp FROM sparse WHERE ts >= TIMESTAMP '1997-06-01'",
)
register(
    "filter_number_in_text",
    "text_numbers",
    lambda df: R.apply_filters(df, [_rule("amount_text", ">", 11)]).select("id", "amount_text"),
    f"SELECT id, amount_text FROM text_numbers WHERE {NUM} > 11",
)
register(
    "filter_chain",
    "lineitem",
    lambda df: R.apply_filters(
        df,
        [
            _rule("l_quantity", ">", 10),
            {"field": "l_returnflag", "op": "in", "value": ["R", "A"]},
            {"name": "l_shipdate", "condition": "date_range", "value": "1995-01-01", "end_value": "1995-12-31"},
        ],
    ).select("l_orderkey", "l_quantity", "l_returnflag"),
    """SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 10
       AND l_returnflag IN ('R', 'A') AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'""",
)
register(
    "filter_dashboard_cross_drill",
    "orders",
    lambda df: grouped_chart(
        R.apply_interactions(
            df,
            [_rule("o_orderstatus", "equals", "F"), _rule("o_totalprice", "no_such_operator", 1)],
            [_rule("o_totalprice", ">", 1000)],
            [_rule("o_orderpriority", "starts_with", "1")],
        ),
        R.drill_column(["o_orderstatus", "o_orderpriority"], 5),
        [("o_totalprice", "sum")],
    ).selectExpr("o_orderpriority", "round(o_totalprice, 2) as total"),
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'
       AND o_totalprice > 1000 AND starts_with(o_orderpriority, '1') GROUP BY 1""",
)
