"""Calculated fields: a small expression language compiled to one Spark column.

    calculated_fields(df, [{"field_name": "margin", "expression": "price - cost", "output_type": "number"}])

Names in the text that match a column (spaces allowed) stand for it. Python's own `ast` reads the
text; each allowed node maps to built-in Spark functions, so a field costs no Python per row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flatwork.functions.coerce import NUMBER_TEXT, TEMPORAL, col, numeric, temporal

# The accepted field names and output types.
FIELD_NAME = r"^[A-Za-z][A-Za-z0-9_ ]{0,63}$"
OUTPUT_TYPES = ("number", "numeric", "text", "category", "categorical", "string", "boolean", "date")


class Term(NamedTuple):
    """A compiled part: its column, its type, and its value when it is a constant."""

    column: Column
    dtype: T.DataType
    constant: object = None

    @property
    def number(self) -> Column:
        return numeric(self.column, self.dtype)

    @property
    def time(self) -> Column:
        return temporal(self.column, self.dtype)

    @property
    def flag(self) -> Column:
        if isinstance(self.dtype, T.BooleanType):
            return F.coalesce(self.column, F.lit(False))
        if isinstance(self.dtype, T.StringType):
            return F.coalesce(self.column != "", F.lit(True))
        return F.coalesce(self.column.cast("double") != 0, F.lit(True))

    @property
    def text(self) -> Column:
        return F.coalesce(self.column.cast("string"), F.lit(""))


DOUBLE, TEXT, FLAG, WHOLE, TIME = T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _constant(value) -> Term:
    if value is None:
        return Term(F.lit(None).cast("string"), TEXT)
    if isinstance(value, bool):
        return Term(F.lit(value), FLAG, value)
    if isinstance(value, (int, float)):
        return Term(F.lit(float(value)), DOUBLE, value)
    return Term(F.lit(str(value)), TEXT, value)


def _numbers(combine: Callable[[Column, Column], Column]) -> Callable[..., Term]:
    return lambda a, b: Term(combine(a.number, b.number), DOUBLE)


def _modulo(a: Column, b: Column) -> Column:
    # The sign follows the divisor.
    return a - b * F.floor(F.try_divide(a, b))


def _compares(combine: Callable[[Column, Column], Column]) -> Callable[..., Term]:
    return lambda a, b: Term(F.coalesce(combine(a.number, b.number), F.lit(False)), FLAG)


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "number"
    return "time" if isinstance(dtype, TEMPORAL) else "text"


def _equals(a: Term, b: Term) -> Term:
    kinds = {_family(a.dtype), _family(b.dtype)}
    if kinds == {"time", "text"}:
        same = a.time == b.time
    elif len(kinds) > 1:
        same = F.lit(False)
    elif kinds == {"number"}:
        same = a.column.cast("double") == b.column.cast("double")
    else:
        same = a.column == b.column
    return Term(F.coalesce(same, F.lit(False)), FLAG)


def _differs(a: Term, b: Term) -> Term:
    return Term(~_equals(a, b).column, FLAG)


def _both(*terms: Term) -> Term:
    out = terms[0].flag
    for t in terms[1:]:
        out = out & t.flag
    return Term(out, FLAG)


def _either(*terms: Term) -> Term:
    out = terms[0].flag
    for t in terms[1:]:
        out = out | t.flag
    return Term(out, FLAG)


def _round(value: Term, digits: Term | None = None) -> Term:
    try:
        places = max(0, int(digits.constant)) if digits else 0
    except (TypeError, ValueError):
        places = 0
    scale = 10.0**places
    return Term(F.rint(value.number * scale) / scale, DOUBLE)


def _choose(condition: Term, yes: Term, no: Term) -> Term:
    if _family(yes.dtype) == _family(no.dtype) == "number":
        return Term(F.when(condition.flag, yes.column.cast("double")).otherwise(no.column.cast("double")), DOUBLE)
    if type(yes.dtype) is type(no.dtype):
        return Term(F.when(condition.flag, yes.column).otherwise(no.column), yes.dtype)
    return Term(F.when(condition.flag, yes.column.cast("string")).otherwise(no.column.cast("string")), TEXT)


def _contains(value: Term, pattern: Term) -> Term:
    return Term(value.text.rlike("(?i)" + str(pattern.constant)), FLAG)


def _part(how: Callable[[Column], Column]) -> Callable[[Term], Term]:
    return lambda a: Term(how(a.time), WHOLE)


def _log(a: Term) -> Term:
    return Term(F.when(a.number > 0, F.log(a.number)), DOUBLE)


def _sqrt(a: Term) -> Term:
    return Term(F.when(a.number >= 0, F.sqrt(a.number)), DOUBLE)


add = _numbers(lambda a, b: a + b)
subtract = _numbers(lambda a, b: a - b)
multiply = _numbers(lambda a, b: a * b)
divide = _numbers(F.try_divide)
greater = _compares(lambda a, b: a > b)
greater_equal = _compares(lambda a, b: a >= b)
less = _compares(lambda a, b: a < b)
less_equal = _compares(lambda a, b: a <= b)

FUNCTIONS: dict[str, Callable[..., Term]] = {
    "add": add,
    "subtract": subtract,
    "multiply": multiply,
    "divide": divide,
    "safe_divide": divide,
    "round": _round,
    "abs": lambda a: Term(F.abs(a.number), DOUBLE),
    "log": _log,
    "sqrt": _sqrt,
    "year": _part(F.year),
    "month": _part(F.month),
    "day": _part(F.dayofmonth),
    "concat": lambda *a: Term(F.concat(*[t.text for t in a]), TEXT),
    "contains": _contains,
    "equals": _equals,
    "greater_than": greater,
    "greater_than_or_equal": greater_equal,
    "less_than": less,
    "less_than_or_equal": less_equal,
    "and_condition": _both,
    "or_condition": _either,
    "if_else": _choose,
}

OPERATORS: dict[type, Callable[..., Term]] = {
    ast.Add: add,
    ast.Sub: subtract,
    ast.Mult: multiply,
    ast.Div: divide,
    ast.Mod: _numbers(_modulo),
    ast.Pow: _numbers(F.pow),
    ast.USub: lambda a: Term(-a.number, DOUBLE),
    ast.UAdd: lambda a: Term(a.number, DOUBLE),
    ast.Eq: _equals,
    ast.NotEq: _differs,
    ast.Gt: greater,
    ast.GtE: greater_equal,
    ast.Lt: less,
    ast.LtE: less_equal,
    ast.And: _both,
    ast.Or: _either,
}


def _bare_word(text: str) -> str:
    """A branch of the if-then-else text form: numbers and quoted text as they are, words quoted."""
    text = text.strip()
    if re.fullmatch(r"[-+]?\d+(\.\d+)?|\".*\"|'.*'", text):
        return text
    constants = {"true": "True", "false": "False", "null": "None", "none": "None"}
    return constants.get(text.lower()) or repr(text)


def _plain(expression: str) -> str:
    sentence = re.fullmatch(r"if\s+(.+?)\s+then\s+(.+?)\s+else\s+(.+)", expression.strip(), re.IGNORECASE | re.DOTALL)
    if not sentence:
        return expression.strip()
    test, yes, no = sentence.groups()
    return f"if_else({test}, {_bare_word(yes)}, {_bare_word(no)})"


def _parse(expression: str, columns: Sequence[str]) -> tuple[ast.expr, dict[str, str]]:
    """The expression tree, and which column each placeholder name stands for."""
    names = sorted(columns, key=len, reverse=True)
    holder = {n: f"__field_{i}__" for i, n in enumerate(names)}
    text = _plain(expression)
    if names:
        # One pass over the text, longest name first; quoted text is left alone.
        any_name = "|".join(re.escape(n) for n in names)
        token = re.compile(rf"(\"[^\"]*\"|'[^']*')|(?<![A-Za-z0-9_])({any_name})(?![A-Za-z0-9_])(?!\s*\()")
        text = token.sub(lambda m: m.group(1) or holder[m.group(2)], text)
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"Invalid expression: {error.msg}") from None
    return tree, {h: n for n, h in holder.items()}


def _compile(node: ast.expr, df: DataFrame, names: dict[str, str]) -> Term:
    def down(child):
        return _compile(child, df, names)

    match node:
        case ast.Constant(value=value):
            return _constant(value)
        case ast.Name(id=name) if name in names:
            return Term(col(names[name]), df.schema[names[name]].dataType)
        case ast.Name(id=name):
            raise ValueError(f"Unknown column or variable: {name}")
        case ast.UnaryOp(op=op, operand=a) if type(op) in OPERATORS:
            return OPERATORS[type(op)](down(a))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
            return OPERATORS[type(op)](down(a), down(b))
        case ast.BoolOp(op=op, values=values):
            return OPERATORS[type(op)](*map(down, values))
        case ast.Compare(left=first, ops=ops, comparators=rest) if all(type(o) in OPERATORS for o in ops):
            terms = [down(first), *map(down, rest)]
            return _both(*[OPERATORS[type(o)](a, b) for o, a, b in zip(ops, terms, terms[1:])])
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            try:
                return FUNCTIONS[name](*map(down, args))
            except TypeError:
                raise ValueError(f"Wrong number of arguments for '{name}'.") from None
        case ast.Call(func=ast.Name(id=name)):
            raise ValueError(f"Function '{name}' is not allowed.")
    raise ValueError(f"Not allowed in an expression: {type(node).__name__}")


def _may_hold_numbers(node: ast.expr) -> bool:
    """Whether a text result can be a number, told from the expression alone: text literals that are no numbers
    cannot, whichever of them a condition picks."""
    match node:
        case ast.Constant(value=str(value)):
            return bool(re.match(NUMBER_TEXT, value.strip()))
        case ast.Call(func=ast.Name(id="if_else"), args=[_, *results]):
            return any(map(_may_hold_numbers, results))
    return True


def _as_output(tree: ast.expr, term: Term, output_type: str) -> Column:
    kind = (output_type or "number").strip().lower()
    if kind in ("text", "category", "categorical", "string"):
        return term.text
    if kind == "boolean":
        return term.flag
    if kind == "date":
        return term.time
    if _family(term.dtype) == "number":
        return term.column.cast("double")
    return term.number if isinstance(term.dtype, T.StringType) and _may_hold_numbers(tree) else term.column


def expression(df: DataFrame, text: str, output_type: str = "number") -> Column:
    """The Spark column of an expression over the columns of df."""
    tree, names = _parse(text, df.columns)
    return _as_output(tree, _compile(tree, df, names), output_type)


def dependency_columns(text: str, columns: Sequence[str]) -> list[str]:
    """The columns an expression reads, in the order of the table."""
    tree, names = _parse(text, columns)
    used = {names[n.id] for n in ast.walk(tree) if isinstance(n, ast.Name) and n.id in names}
    return [c for c in columns if c in used]


def validate_field(df: DataFrame, field: dict) -> None:
    """Raise for a bad or taken name, an unknown output type, or a bad expression."""
    name = str(field.get("field_name") or "").strip()
    if not re.match(FIELD_NAME, name):
        raise ValueError("A field name starts with a letter and has letters, digits, blanks or underscores.")
    if name in df.columns:
        raise ValueError(f"Column '{name}' already exists.")
    if (field.get("output_type") or "number").strip().lower() not in OUTPUT_TYPES:
        raise ValueError(f"Unknown output type: {field.get('output_type')}")
    if not str(field.get("expression") or "").strip():
        raise ValueError("An expression is needed.")
    expression(df, field["expression"], field.get("output_type") or "number")


def calculated_fields(df: DataFrame, fields: Sequence[dict] | None) -> DataFrame:
    """Add the fields in order; later ones may use earlier ones."""
    for field in fields or []:
        validate_field(df, field)
        column = expression(df, field["expression"], field.get("output_type") or "number")
        df = df.withColumn(field["field_name"].strip(), column)
    return df


def preview_field(df: DataFrame, field: dict, order_by: Sequence[str], limit: int = 20) -> DataFrame:
    """The first rows with the new column."""
    return calculated_fields(df.orderBy(*[col(c) for c in order_by]).limit(max(1, int(limit))), [field])
