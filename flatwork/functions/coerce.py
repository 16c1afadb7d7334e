"""Coercion rules used by every operator.

Missing is always null: bad numbers, NaN, infinities and unparsable dates become null, and
nothing raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The text forms accepted as numbers and as dates.
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "MM/dd/yyyy")

TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"Column '{name}' was not found.")


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def text_to_number(c: Column) -> Column:
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(trimmed.rlike(NUMBER_TEXT), finite(trimmed.try_cast("double")))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def numeric(c: Column, dtype: T.DataType) -> Column:
    """The column as double, null where it is not a number."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_number(c)
    return F.lit(None).cast("double")


def num(df: DataFrame, name: str) -> Column:
    return numeric(col(name), column_type(df, name))


def with_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each named column by its numeric form."""
    return df.withColumns({n: num(df, n) for n in names})


def temporal(c: Column, dtype: T.DataType) -> Column:
    """The column as a timestamp without zone, null where it is not a date or time."""
    if isinstance(dtype, TEMPORAL):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        trimmed = F.trim(c)
        parsed = [F.try_to_timestamp(trimmed, F.lit(f)) for f in DATE_FORMATS]
        return F.coalesce(trimmed.try_cast("timestamp_ntz"), *[p.cast("timestamp_ntz") for p in parsed])
    return F.lit(None).cast("timestamp_ntz")


def ts(df: DataFrame, name: str) -> Column:
    return temporal(col(name), column_type(df, name))


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows where none of the named columns is missing."""
    for n in names:
        df = df.where(col(n).isNotNull())
    return df


def text(df: DataFrame, name: str) -> Column:
    return col(name).cast("string")


def report_safe(df: DataFrame) -> DataFrame:
    """Values as a report can carry them: finite doubles, decimals as double, times as ISO text."""
    out = []
    for field in df.schema.fields:
        c, dtype = col(field.name), field.dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            c = finite(c.cast("double"))
        elif isinstance(dtype, T.DecimalType):
            c = c.cast("double")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, ".SSSSSS")
            c = F.concat(seconds, F.when(micros != ".000000", micros).otherwise(""))
        elif isinstance(dtype, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(field.name))
    return df.select(*out)
