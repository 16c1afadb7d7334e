"""Reading tables: CSV with the usual missing-value spellings, and Parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flatwork.functions.coerce import col, finite, text_to_number
from flatwork.sources.csv_records import csv_records

# Texts that a CSV cell holds for "missing".
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
FORMATS = {".csv": "csv", ".parquet": "parquet"}


def source_format(path: str) -> str:
    """The format a path names by its extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in FORMATS:
        raise ValueError(f"Unsupported file type '{extension}'. Use CSV or Parquet.")
    return FORMATS[extension]


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def typed(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit: boolean, long, double or text.

    One aggregate over the data decides for all columns.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    tests = {
        "b": lambda c: F.lower(c).isin("true", "false"),
        "l": lambda c: c.rlike(r"^\s*[+-]?[0-9]+\s*$") & c.try_cast("bigint").isNotNull(),
        "d": lambda c: text_to_number(c).isNotNull(),
    }
    found = df.agg(
        *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count_if(test(col(c))).alias(f"{k}{i}") for i, c in enumerate(names) for k, test in tests.items()],
    ).first()
    out = {}
    for i, c in enumerate(names):
        n = found[f"n{i}"]
        if n and found[f"b{i}"] == n:
            out[c] = col(c).try_cast("boolean")
        elif n and found[f"l{i}"] == n:
            out[c] = F.trim(col(c)).try_cast("bigint")
        elif n and found[f"d{i}"] == n:
            out[c] = finite(text_to_number(col(c)))
    return df.withColumns(out) if out else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A table from a CSV or Parquet path. Types of a CSV are worked out unless a schema is given.

    Quoted cells may hold line breaks; files are read in byte ranges all the same (see `csv_records`), and their
    records are stored once. `multi_line=False` is the caller's promise that there are no such cells; then
    Spark's reader parses the lines as they are.
    """
    if source_format(path) == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if multi_line:
        names = [f.name for f in schema.fields] if schema is not None else column_names(spark, path)
        types = [f.dataType.simpleString() if schema is not None else "string" for f in (schema.fields if schema is not None else names)]
        cells = F.from_csv("record", ", ".join(f"c{i} {t}" for i, t in enumerate(types)), {"quote": '"', "escape": '"', "multiLine": "true"})
        text = csv_records(spark, path).select(cells.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    else:
        reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        text = reader.schema(schema).csv(path) if schema is not None else reader.csv(path, inferSchema=False)
    if schema is not None:
        return nan_to_null(text)
    return typed(text.select(*[F.when(~col(c).isin(MISSING_TEXTS), col(c)).alias(c) for c in text.columns]))


def column_names(spark: SparkSession, path: str) -> list[str]:
    """The column names of a source, from its header alone."""
    if source_format(path) == "parquet":
        return spark.read.parquet(path).columns
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path, inferSchema=False).columns


def validate_source(spark: SparkSession, path: str) -> DataFrame:
    """The table at a path; raises for an unsupported type or a source without rows."""
    df = read_table(spark, path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"'{path}' is empty.")
    return df
