"""Imputation by prediction. Trees and nearest rows are learned from the rows that hold a value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from flatwork.functions.coerce import col, column_type, is_numeric, num
from flatwork.operators.quantiles import quantiles
from flatwork.sources.checkpoints import cut_lineage


def _centers(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Median of each feature: one number per column."""
    plain = df.select(*[num(df, f).alias(f) for f in features])
    row = quantiles(plain, list(features), [0.5]).first()
    return {f: (row[f"q_{f}"] or [0.0])[0] or 0.0 for f in features}


def fill_predicted(df: DataFrame, column: str, features: Sequence[str], depth: int = 5) -> DataFrame:
    """Predict missing values from other numeric columns: a regression tree for numbers, a
    classification tree for text. Missing features count as their median."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    centers = _centers(df, features)
    ready = df.withColumns({f"__f{i}": F.coalesce(num(df, f), F.lit(centers[f])) for i, f in enumerate(features)})
    ready = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__x").transform(ready)
    known = ready.where(col(column).isNotNull())
    drop = ["__x", "__y", "__p", "__label", "__raw", "__prob", *[f"__f{i}" for i in range(len(features))]]
    if is_numeric(column_type(df, column)):
        model = DecisionTreeRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", maxDepth=depth, seed=42)
        scored = model.fit(known.withColumn("__y", num(df, column))).transform(ready)
        return scored.withColumn(column, F.coalesce(col(column).cast("double"), F.col("__p"))).drop(*drop)
    index = StringIndexer(inputCol=column, outputCol="__y", stringOrderType="frequencyDesc").fit(known)
    model = DecisionTreeClassifier(
        featuresCol="__x", labelCol="__y", predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob",
        maxDepth=depth, seed=42,
    )
    scored = model.fit(index.transform(known)).transform(ready)
    named = IndexToString(inputCol="__p", outputCol="__label", labels=index.labels).transform(scored)
    return named.withColumn(column, F.coalesce(col(column), F.col("__label"))).drop(*drop)


def fill_chained(df: DataFrame, columns: Sequence[str], rounds: int = 3) -> DataFrame:
    """Chained equations: every column in turn is regressed on the others, for some rounds.

    One round is one aggregate of co-moments per column; the coefficients are literals in the plan.
    """
    import numpy as np

    columns = list(dict.fromkeys(columns))
    centers = _centers(df, columns)
    work = df.withColumns({f"__m{i}": num(df, c).isNull() for i, c in enumerate(columns)})
    work = work.withColumns({f"__v{i}": F.coalesce(num(df, c), F.lit(centers[c])) for i, c in enumerate(columns)})
    for _ in range(max(1, rounds)):
        for i in range(len(columns)):
            others = [j for j in range(len(columns)) if j != i]
            known = work.where(~F.col(f"__m{i}"))
            names = [*others, i]
            row = known.agg(
                *[F.avg(f"__v{a}").alias(f"mean{a}") for a in names],
                *[F.covar_pop(f"__v{a}", f"__v{b}").alias(f"c{a}_{b}") for a in others for b in names if a <= b or b == i],
            ).first()
            if row[f"mean{i}"] is None:
                continue
            s = np.array([[row[f"c{min(a, b)}_{max(a, b)}"] for b in others] for a in others], dtype=float)
            t = np.array([row[f"c{a}_{i}"] for a in others], dtype=float)
            beta = np.linalg.pinv(s) @ t if others else np.zeros(0)
            guess = F.lit(float(row[f"mean{i}"]))
            for b, a in zip(beta, others):
                guess = guess + F.lit(float(b)) * (F.col(f"__v{a}") - F.lit(float(row[f"mean{a}"])))
            work = work.withColumn(f"__v{i}", F.when(F.col(f"__m{i}"), guess).otherwise(F.col(f"__v{i}")))
        work = cut_lineage(work)
    filled = work.withColumns({c: F.col(f"__v{i}") for i, c in enumerate(columns)})
    return filled.drop(*[f"__{k}{i}" for k in "mv" for i in range(len(columns))])


def fill_nearest(df: DataFrame, column: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """Mean of the k nearest rows that hold a value, on standardised features."""
    from flatwork.operators.cleaning.neighbours import nearest_lists, on_curve, with_standardised

    work = with_standardised(df, features).withColumn("__v", num(df, column))
    held, missing = work.where("__v is not null"), work.where("__v is null")
    known = held.groupBy(F.col("__x").alias("x")).agg(F.count("*").alias("w"), F.avg("__v").alias("payload"))
    if known.isEmpty():  # nothing to learn from: missing stays missing
        return df.withColumn(column, num(df, column))
    asked = on_curve(missing.select(F.col("__x").alias("x")).distinct())
    total = F.aggregate(F.zip_with("w", "payload", lambda w, p: w * p), F.lit(0.0), lambda a, v: a + v)
    copies = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w)
    near = nearest_lists(asked, on_curve(known), k).where(F.size("other") > 0).select("id", (total / copies).alias("__guess"))
    guess = near.join(asked, "id").select(F.col("x").alias("__kx"), "__guess")
    # Only rows without a value move to their guess.
    found = missing.join(guess, F.col("__x") == F.col("__kx"), "left").drop("__kx")
    filled = held.withColumn("__guess", F.lit(None).cast("double")).union(found)
    return filled.withColumn(column, F.coalesce("__v", "__guess")).drop("__x", "__v", "__guess")
