"""Calculated fields, one query per function family."""

from pyspark.sql import functions as F

from flatwork.functions.calc import calculated_fields, preview_field
from flatwork.queries.filters import NUM
from flatwork.queries.registry import register


def _field(expression, kind="number", digits=None, key="id", column="field"):
    def build(df):
        out = calculated_fields(df, [{"field_name": "field", "expression": expression, "output_type": kind}])
        value = F.col("field") if digits is None else F.round("field", digits)
        return out.select(key, value.alias(column))

    return build


def _calc(name, expression, sql, kind="number", digits=None, table="sparse", key="id"):
    value = sql if digits is None else f"round({sql}, {digits})"
    register(f"calc_{name}", table, _field(expression, kind, digits, key), f"SELECT {key}, {value} AS field FROM {table}")


_calc("add", "val + id", "val + id", digits=2)
_calc("add_function", "add(val, 1)", "val + 1", digits=2)
_calc("subtract", "subtract(val, id) - 1", "val - id - 1", digits=2)
_calc("multiply", "multiply(val, 2) * 3", "val * 2 * 3", digits=2)
_calc("divide", "val / (id % 3)", "CASE WHEN id % 3 <> 0 THEN val / (id % 3) END", digits=4)
_calc("safe_divide", "safe_divide(val, id % 2)", "CASE WHEN id % 2 <> 0 THEN val / (id % 2) END", digits=4)
_calc("modulo", "(0 - id) % 7", "((-id % 7) + 7) % 7 * 1.0::DOUBLE")
_calc("power", "(id % 10) ** 2", "pow(id % 10, 2)")
_calc("unary_minus", "-val", "-val")
_calc("round_half_even", "round(id / 2)", "CASE WHEN (id // 2) % 2 = 1 THEN ceil(id / 2.0::DOUBLE) ELSE floor(id / 2.0::DOUBLE) END")
_calc("round_digits", "round(val / 7, 1)", "round_even(val / 7, 1)")
_calc("abs", "abs(1000 - id)", "abs(1000.0::DOUBLE - id)")
_calc("log", "log(id - 5)", "CASE WHEN id > 5 THEN ln(id - 5) END", digits=8)
_calc("sqrt", "sqrt(id - 5)", "CASE WHEN id >= 5 THEN sqrt(id - 5) END", digits=8)
_calc("year", "year(ts)", "CAST(year(ts) AS DOUBLE)")
_calc("month", "month(ts)", "CAST(month(ts) AS DOUBLE)")
_calc("day", "day(ts)", "CAST(day(ts) AS DOUBLE)")
_calc("concat", 'concat(grp, "-", id)', "concat(coalesce(grp, ''), '-', id)", kind="text")
_calc("contains", 'contains(grp, "ur.ent")', "coalesce(regexp_matches(grp, '(?i)ur.ent'), false)", kind="boolean")
_calc("equals", 'equals(grp, "2-HIGH")', "coalesce(grp = '2-HIGH', false)", kind="boolean")
_calc("equal_sign", 'grp == "2-HIGH"', "coalesce(grp = '2-HIGH', false)", kind="boolean")
_calc("not_equal_sign", 'grp != "2-HIGH"', "grp IS DISTINCT FROM '2-HIGH'", kind="boolean")
_calc("greater_than", "greater_than(val, 100000)", "coalesce(val > 100000, false)", kind="boolean")
_calc("greater_or_equal", "val >= 100000", "coalesce(val >= 100000, false)", kind="boolean")
_calc("less_than", "less_than(val, 100000)", "coalesce(val < 100000, false)", kind="boolean")
_calc("less_or_equal", "less_than_or_equal(val, 100000)", "coalesce(val <= 100000, false)", kind="boolean")
_calc("chained", "50000 < val < 100000", "coalesce(val > 50000 AND val < 100000, false)", kind="boolean")
_calc("and_or", 'val > 50000 and grp == "2-HIGH" or id < 10',
      "coalesce(val > 50000, false) AND coalesce(grp = '2-HIGH', false) OR id < 10", kind="boolean")
_calc("and_condition", "and_condition(val > 50000, id < 5000)", "coalesce(val > 50000, false) AND id < 5000", kind="boolean")
_calc("or_condition", "or_condition(val > 50000, id < 5000)", "coalesce(val > 50000, false) OR id < 5000", kind="boolean")
_calc("if_else", 'if_else(val > 100000, "High", "Low")', "CASE WHEN val > 100000 THEN 'High' ELSE 'Low' END", kind="text")
_calc("if_then_text", "if val > 100000 then High else Low", "CASE WHEN val > 100000 THEN 'High' ELSE 'Low' END")
_calc("if_then_number", "if val > 100000 then 1 else 0", "CASE WHEN val > 100000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_calc("number_from_text", "amount_text", NUM, table="text_numbers")
_calc("text_arithmetic", "amount_text * 2", f"{NUM} * 2", table="text_numbers")
_calc("output_text", "grp", "coalesce(grp, '')", kind="text")
register(
    "calc_output_date",
    "codes",
    lambda df: calculated_fields(
        df.selectExpr("id", "split_part(code, '-', 2) || '-01-01' as start"),
        [{"field_name": "day", "expression": "start", "output_type": "date"}],
    ).select("id", F.date_format("day", "yyyy-MM-dd").alias("day")),
    "SELECT id, split_part(code, '-', 2) || '-01-01' AS day FROM codes",
)
register(
    "calc_spaced_names",
    "lineitem",
    lambda df: calculated_fields(
        df.withColumnRenamed("l_extendedprice", "Unit Price").withColumnRenamed("l_quantity", "Qty"),
        [
            {"field_name": "per unit", "expression": "Unit Price / Qty", "output_type": "number"},
            {"field_name": "twice", "expression": "per unit * 2", "output_type": "number"},
        ],
    ).select("l_orderkey", F.col("per unit").alias("unit"), "twice"),
    "SELECT l_orderkey, l_extendedprice / l_quantity AS unit, l_extendedprice / l_quantity * 2 AS twice FROM lineitem",
)
register(
    "calc_preview",
    "orders",
    lambda df: preview_field(df, {"field_name": "tax", "expression": "o_totalprice * 0.1"}, ["o_orderkey"], 15).select(
        "o_orderkey", F.round("tax", 4).alias("tax")
    ),
    "SELECT o_orderkey, round(o_totalprice * 0.1, 4) AS tax FROM orders ORDER BY 1 LIMIT 15",
)
