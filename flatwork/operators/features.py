"""Feature rules applied to tables, and rules inferred from examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flatwork.functions.coerce import col
from flatwork.functions.rules import NUMERIC_RULES, RULE_GROUPS, TEXT_RULES, rule_column, text_of

OTHER = "Other"


def value_counts(df: DataFrame, source: str) -> DataFrame:
    """How many rows hold each present value of a column."""
    return df.where(col(source).isNotNull()).groupBy(col(source).alias("__v")).agg(F.count("*").alias("__n"))


def _with_value_counts(df: DataFrame, source: str) -> DataFrame:
    return df.join(value_counts(df, source), col(source) == F.col("__v"), "left").drop("__v")


def rare_grouping(df: DataFrame, source: str, new: str, minimum_frequency: float, label: str = OTHER) -> DataFrame:
    """Values below a minimum become one category: a count from 1 on, a share of rows below 1."""
    minimum = float(minimum_frequency)
    counted = _with_value_counts(df, source)
    if minimum < 1:
        rare = F.col("__n") < F.lit(minimum) * df.agg(F.count("*")).scalar()
    else:
        rare = F.col("__n") < minimum
    kept = F.when(col(source).isNull(), None).when(rare, label).otherwise(col(source).cast("string"))
    return counted.withColumn(new, kept).drop("__n")


def frequency_encoding(df: DataFrame, source: str, new: str) -> DataFrame:
    """The share of all rows that hold the row's value; null for a missing value."""
    rows = df.agg(F.count("*")).scalar()
    return _with_value_counts(df, source).withColumn(new, F.col("__n") / rows).drop("__n")


def apply_rule(df: DataFrame, source: str, new: str, rule: dict) -> DataFrame:
    """Add the feature `new` made from `source` by a rule."""
    if source not in df.columns:
        raise ValueError(f"Source column '{source}' does not exist.")
    if not new:
        raise ValueError("A new feature name is needed.")
    operation, params = rule.get("operation"), rule.get("parameters") or {}
    if operation == "rare_category_grouping":
        return rare_grouping(df, source, new, params["minimum_frequency"])
    if operation == "frequency_encoding":
        return frequency_encoding(df, source, new)
    return df.withColumn(new, rule_column(df, source, rule))


def preview_rule(df: DataFrame, source: str, rule: dict) -> DataFrame:
    """Input and output pairs."""
    return apply_rule(df, source, "preview_output", rule).select(col(source).alias("source_value"), "preview_output")


def validate_rule(df: DataFrame, source: str, rule: dict) -> DataFrame:
    """Rows, rows with output, rows without, and a warning text."""
    out = preview_rule(df, source, rule)
    blank = F.coalesce(F.trim(F.col("preview_output").cast("string")) == "", F.lit(True))
    counts = out.agg(F.count("*").alias("total_rows"), F.count_if(~blank).alias("generated_count"))
    counts = counts.withColumn("empty_output_count", F.col("total_rows") - F.col("generated_count"))
    total, made, empty = F.col("total_rows"), F.col("generated_count"), F.col("empty_output_count")
    some = F.concat(empty.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows have no output."))
    return counts.withColumn(
        "warning",
        F.when(total == 0, "No source values were given.")
        .when(made == 0, "The rule made no output for any row.")
        .when(empty > 0, some),
    )


def _same(a: Column, b: Column) -> Column:
    def norm(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))

    return norm(a) == norm(b)


def derived_lengths(examples: DataFrame, source: str, expected: str) -> DataFrame:
    """The one character count that explains the examples, per kind of cut, or null.

    Each kind looks at the examples it can explain; it holds when they all need the same count.
    """
    s, e = text_of(examples, source), F.trim(text_of(examples, expected))
    pairs = examples.where(s.isNotNull() & e.isNotNull() & (e != ""))
    starts, ends, longer = s.startswith(e), s.endswith(e), F.length(s) > F.length(e)
    kinds = {
        "extract_first_n_characters": F.when(starts, F.length(e)),
        "extract_last_n_characters": F.when(ends, F.length(e)),
        "remove_first_n_characters": F.when(ends & longer, F.length(s) - F.length(e)),
        "remove_last_n_characters": F.when(starts & longer, F.length(s) - F.length(e)),
    }
    return pairs.agg(*[F.when(F.min(n) == F.max(n), F.min(n)).alias(k) for k, n in kinds.items()])


def infer_rules(examples: DataFrame, source: str, expected: str) -> DataFrame:
    """Every rule scored by the share of examples it reproduces, best first.

    One pass: all candidate rules become columns of the examples, then one grouped average. Rules
    whose parameters no example can supply are left out. The exact value mapping is a candidate
    too; it is scored by a join, so the example table may be large.
    """
    open_ended = {
        op
        for group in RULE_GROUPS.values()
        for op, params in group.items()
        if any(p not in ("n", "decimal_places", "delimiter") for p in params)
    }
    plain = [op for op in [*TEXT_RULES, *NUMERIC_RULES] if op not in open_ended]
    candidates = [(op, {}) for op in plain if "_n_characters" not in op]
    lengths = derived_lengths(examples, source, expected).first()
    for op in ("extract_first_n_characters", "extract_last_n_characters", "remove_first_n_characters", "remove_last_n_characters"):
        counts = {1} | ({lengths[op]} if lengths and lengths[op] else set())
        candidates += [(op, {"n": n}) for n in sorted(counts)]

    made = [
        F.struct(
            F.lit(op).alias("operation"),
            F.lit(params.get("n")).cast("int").alias("n"),
            rule_column(examples, source, {"operation": op, "parameters": params}).cast("string").alias("out"),
        )
        for op, params in candidates
    ]
    compared = examples.where(F.trim(text_of(examples, expected)) != "")
    long = compared.select(text_of(examples, expected).alias("want"), F.explode(F.array(*made)).alias("r"))
    scores = long.groupBy("r.operation", "r.n").agg(
        F.count_if(_same(F.col("r.out"), F.col("want"))).alias("matched_count"), F.count("*").alias("total_compared")
    )
    return (
        scores.unionByName(_mapping_score(compared, source, expected))
        .withColumn("match_score", F.col("matched_count") / F.col("total_compared"))
        .orderBy(F.desc("match_score"), F.desc("matched_count"), "operation", "n")
    )


def mapping_from_examples(examples: DataFrame, source: str, expected: str) -> DataFrame:
    """The value mapping that examples state: source_value, mapped_value and how many examples say so.

    Values that an example maps to nothing are left out; where examples disagree, the most frequent one
    counts, the smallest of tied ones. A group is reduced to one row per pair before its best one is picked.
    """
    s, e = text_of(examples, source), F.trim(text_of(examples, expected))
    pairs = examples.select(s.alias("source_value"), e.alias("v")).where("source_value IS NOT NULL AND v <> ''")
    counts = pairs.groupBy("source_value", "v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))
    found = counts.groupBy("source_value").agg(best.alias("b"))
    return found.select("source_value", F.col("b.v").alias("mapped_value"), (-F.col("b.n")).alias("example_count"))


def _mapping_score(compared: DataFrame, source: str, expected: str) -> DataFrame:
    """How many examples the mapping source -> its largest expected value reproduces."""
    s, e = text_of(compared, source), F.trim(text_of(compared, expected))
    pairs = compared.select(s.alias("s"), F.lower(e).alias("e")).groupBy("s", "e").agg(F.count("*").alias("n"))
    per_value = pairs.groupBy("s").agg(F.max_by("n", F.struct("e")).alias("hit"), F.sum("n").alias("n"))
    matched = F.coalesce(F.sum(F.when(F.col("s").isNotNull(), F.col("hit"))), F.lit(0))
    return per_value.agg(matched.alias("matched_count"), F.sum("n").alias("total_compared")).select(
        F.lit("manual_mapping_from_examples").alias("operation"), F.lit(None).cast("int").alias("n"), "matched_count", "total_compared"
    )
