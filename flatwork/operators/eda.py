"""The tables behind exploratory graphs: bins, boxes, densities, correlations, category shares."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from flatwork.functions.coerce import col, column_type, is_numeric, num, present
from flatwork.functions.stats import moments, share
from flatwork.operators.aggregate import top_n
from flatwork.operators.ordered import with_position
from flatwork.operators.projection import clamp, sample_rows
from flatwork.operators.joins import join_on, one_row
from flatwork.operators.quantiles import quantile_scalars, quantiles

MISSING = "[missing]"


GROUP = "__group"


def _values(df: DataFrame, column: str, group: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The present numbers of a column as `v`, with the group and the keys under neutral names."""
    kept = [col(group).alias(GROUP)] if group else []
    kept += [col(k).alias(f"__key_{i}") for i, k in enumerate(keys)]
    return df.select(num(df, column).alias("v"), *kept).where("v is not null")


def _keys(n: Sequence[str]) -> list[Column]:
    return [F.col(f"__key_{i}") for i in range(len(n))]


# ---- bins -------------------------------------------------------------------------------------


def bin_number(value: Column, low: float, high: float, bins: int, closed_right: bool = True) -> Column:
    """The 1-based equal-width bin of a value; the outer edges belong to the outer bins.

    The computed number is checked against the edges, where rounding may have put it one off.
    """
    step = (high - low) / bins
    at = (value - F.lit(low)) / F.lit(step)
    guess = F.ceil(at) if closed_right else F.floor(at) + 1
    above, below = F.lit(low) + guess * F.lit(step), F.lit(low) + (guess - 1) * F.lit(step)
    up, down = (value > above, value <= below) if closed_right else (value >= above, value < below)
    number = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    return F.greatest(F.lit(1), F.least(F.lit(bins), number)).cast("int")


def value_range(values: DataFrame) -> tuple[float, float] | None:
    """Smallest and largest present `v`: two numbers, from one aggregate."""
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    return None if ends["low"] is None else (float(ends["low"]), float(ends["high"]))


def _widened(low: float, high: float, closed_right: bool) -> tuple[float, float]:
    """A single value gets a small range around it."""
    if low < high:
        return low, high
    pad = (abs(low) * 0.001 or 0.001) if closed_right else 0.5
    return low - pad, high + pad


def _edge_text(c: Column) -> Column:
    def cut(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    size = F.abs(c)
    return F.when(size >= 1000, F.format_number(c, 0)).when(size >= 10, cut(F.format_number(c, 1))).otherwise(cut(F.format_number(c, 2)))


def histogram(
    df: DataFrame, column: str, bins=10, group: str | None = None, closed_right: bool = True, maximum: int = 100, minimum: int = 1
) -> DataFrame:
    """Equal-width bins: bin, bin_start, bin_end, label, count (and the group).

    Closed on the right, the first bin reaches 0.1 % of the range below the smallest value; closed
    on the left, the last bin includes the largest. Empty bins appear only without a group.
    """
    bins = clamp(bins, minimum, maximum, 10)
    by = [GROUP] if group else []
    values = _values(df, column, group)
    found = value_range(values)
    if group:
        values = values.where(F.col(GROUP).isNotNull())
    low, high = _widened(*(found or (0.0, 1.0)), closed_right)
    numbered = values.withColumn("bin", bin_number(F.col("v"), low, high, bins, closed_right))
    counts = numbered.groupBy("bin", *by).agg(F.count("*").alias("count"))
    if not group:
        every = df.sparkSession.range(1, bins + 1 if found else 1).select(F.col("id").cast("int").alias("bin"))
        counts = every.join(counts, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    step = (high - low) / bins
    start = F.lit(low) + (F.col("bin") - 1) * F.lit(step)
    if closed_right and found and found[0] < found[1]:
        start = F.when(F.col("bin") == 1, F.lit(low - (high - low) * 0.001)).otherwise(start)
    end = F.when(F.col("bin") == bins, F.lit(high)).otherwise(F.lit(low) + F.col("bin") * F.lit(step))
    shown = counts.withColumns({"bin_start": start, "bin_end": end})
    label = F.concat(_edge_text(F.bround("bin_start", 3)), F.lit(" - "), _edge_text(F.bround("bin_end", 3)))
    out = shown.withColumn("label", label).select("bin", "label", "count", "bin_start", "bin_end", *by)
    return out.withColumnRenamed(GROUP, group) if group else out


def automatic_bins(df: DataFrame, column: str) -> int:
    """The finer of Sturges' and Freedman-Diaconis' widths, as a bin count."""
    values = _values(df, column)
    row = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not row["n"] or row["low"] == row["high"]:
        return 1
    q1, q3 = quantiles(values, ["v"], [0.25, 0.75]).first()["q_v"]
    spread = row["high"] - row["low"]
    sturges = spread / (math.log2(row["n"]) + 1)
    scott_free = 2 * (q3 - q1) * row["n"] ** (-1 / 3)
    return max(1, math.ceil(spread / (min(sturges, scott_free) if scott_free > 0 else sturges)))


def automatic_histogram(df: DataFrame, column: str) -> DataFrame:
    """Left-closed bins of the automatic width."""
    bins = automatic_bins(df, column)
    return histogram(df, column, bins, closed_right=False, maximum=bins)


def value_counts(df: DataFrame, column: str, n: int = 30, missing: bool = True) -> DataFrame:
    """The most frequent values as text with their counts, missing values under their own label."""
    shown = col(column).cast("string")
    rows = df.select((F.coalesce(shown, F.lit(MISSING)) if missing else shown).alias("value"))
    counts = rows.where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(n)


def histogram_table(df: DataFrame, column: str) -> DataFrame:
    """Value counts for a column of at most 30 values, ten bins for numbers, else the top 30 values."""
    few = df.select(col(column)).where(col(column).isNotNull()).distinct().limit(31).count() <= 30
    if few:
        return value_counts(df, column, 30).select(F.col("value").alias("label"), "count")
    if _values(df, column).isEmpty():
        return value_counts(df, column, 30, missing=False).select(F.col("value").alias("label"), "count")
    return histogram(df, column, 10).select("label", "count")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, missing, distinct, range, mean, median, quartiles, std, outlier count."""
    values = df.select(num(df, column).alias("v"), col(column).alias("raw"))
    q1, median, q3 = quantile_scalars(values.select("v"), ["v"], [0.25, 0.5, 0.75])["v"]
    reach = 1.5 * (q3 - q1)
    marked = values.withColumn("out", F.coalesce((F.col("v") < q1 - reach) | (F.col("v") > q3 + reach), F.lit(False)))
    stats = moments(F.col("v"))
    return marked.agg(
        F.count("*").alias("row_count"),
        (F.count("*") - F.count("raw")).alias("missing_count"),
        share(F.count("*") - F.count("raw"), F.count("*")).alias("missing_percentage"),
        F.count_distinct("raw").alias("unique_count"),
        F.count("v").alias("valid_count"),
        *[stats[n].alias(n) for n in ("min", "max", "mean", "std")],
        F.count_if("out").alias("outlier_count"),
    ).withColumns({"median": median, "q1": q1, "q3": q3})


def quick_table(df: DataFrame, column: str) -> DataFrame:
    """Ten bins for a column with numbers, else its top 15 values."""
    if _values(df, column).isEmpty():
        return value_counts(df, column, 15).select(F.col("value").alias("label"), "count")
    return histogram(df, column, 10).select("label", "count")


# ---- boxes ------------------------------------------------------------------------------------


def _in_top(values: DataFrame, n: int) -> DataFrame:
    """Rows of the n groups (at most 100) that have most rows."""
    grouped = values.where(F.col(GROUP).isNotNull())
    counts = grouped.groupBy(GROUP).agg(F.count("*").alias("__rows"))
    best = top_n(counts, "__rows", n, [GROUP]).select(F.col(GROUP).alias("__g"))
    # At most 100 rows: safe to send to every task.
    return grouped.join(F.broadcast(best), F.col(GROUP) == F.col("__g"), "left_semi")


def _boxes(values: DataFrame, by: list[str]) -> DataFrame:
    figures = values.groupBy(*by).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("*").alias("count")
    )
    names = ("q1", "median", "q3")
    middle = quantiles(values, ["v"], [0.25, 0.5, 0.75], by).select(*by, *[F.get("q_v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if by:
        joined = join_on(figures, middle, by)
    else:
        quartiles = one_row(middle)
        joined = figures.withColumns({n: quartiles[n] for n in names})
    return joined.select(*by, "min", "q1", "median", "q3", "max", "mean", "count")


def box_chart(df: DataFrame, column: str, group: str | None = None, top=30) -> DataFrame:
    """min, q1, median, q3, max, mean, count of a column, whole or per category."""
    values = _values(df, column, group)
    if not group:
        boxes = _boxes(values, [])
        return boxes.select(F.lit(column).alias("category"), *boxes.columns)
    return _boxes(_in_top(values, clamp(top, 1, 100, 30)), [GROUP]).withColumnRenamed(GROUP, group)


def box_whiskers(df: DataFrame, column: str, group: str, order_by: Sequence[str], top=30, keep: int = 200) -> DataFrame:
    """Box figures with whiskers inside the fences, outlier count and the first outliers in row order."""
    values = _in_top(_values(df, column, group, order_by), clamp(top, 1, 100, 30))
    boxes = _boxes(values, [GROUP])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = boxes.select(F.col(GROUP).alias("__g"), (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    # At most 100 categories.
    marked = values.join(F.broadcast(fences), F.col(GROUP) == F.col("__g")).drop("__g")
    inside = F.col("v").between(F.col("low"), F.col("high"))
    ends = marked.groupBy(GROUP).agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outlier_count"),
    )
    order = W.partitionBy(GROUP).orderBy(*_keys(order_by))
    first = marked.where(~inside).withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= keep)
    listed = first.groupBy(GROUP).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__at", "v"))), lambda s: s["v"]).alias("outliers")
    )
    joined = join_on(join_on(boxes, ends, [GROUP]), listed, [GROUP], "left")
    filled = joined.withColumn("outliers", F.coalesce("outliers", F.array().cast("array<double>")))
    return filled.withColumnRenamed(GROUP, group)


def box_by_median(df: DataFrame, column: str, group: str, top: int = 30) -> DataFrame:
    """Boxes of the top categories, ordered by median."""
    return box_chart(df, column, group, top).orderBy("median", col(group))


def box_summary(df: DataFrame, column: str, order_by: Sequence[str] = (), keep: int = 20) -> DataFrame:
    """One row: quartiles, fences, outlier count and the first outliers."""
    values = _values(df, column, keys=order_by)
    q1, median, q3 = quantile_scalars(values.select("v"), ["v"], [0.25, 0.5, 0.75])["v"]
    reach = 1.5 * (q3 - q1)
    marked = values.withColumn("__out", (F.col("v") < q1 - reach) | (F.col("v") > q3 + reach))
    first = marked.where("__out").orderBy(*(_keys(order_by) or [F.col("v")])).limit(keep).select("v")
    listed = first.agg(F.array_sort(F.collect_list(F.bround("v", 4))).alias("a")).scalar()
    return marked.agg(
        F.bround(F.min("v"), 4).alias("min"), F.bround(F.max("v"), 4).alias("max"), F.count_if("__out").alias("outlier_count")
    ).withColumns(
        {
            "q1": F.bround(q1, 4), "median": F.bround(median, 4), "q3": F.bround(q3, 4), "iqr": F.bround(q3 - q1, 4),
            "lower_fence": F.bround(q1 - reach, 4), "upper_fence": F.bround(q3 + reach, 4), "outlier_sample": listed,
        }
    )


# ---- densities --------------------------------------------------------------------------------


def density(df: DataFrame, column: str, group: str | None = None, points: int = 200, top: int = 30) -> DataFrame:
    """Gaussian kernel density on an even grid over the data range, Scott bandwidth.

    Every task sums its own rows at the grid points, and only those sums travel: `points` rows per group and task.
    A group without spread has no density.
    """
    by = [GROUP] if group else []
    values = _values(df, column, group)
    if group:
        values = _in_top(values, clamp(top, 1, 100, 30))
    stats = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("s")
    ).where("s > 0")
    stats = stats.withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2))).drop("s")
    if group:
        # At most 100 categories.
        joined = values.join(F.broadcast(stats.withColumnRenamed(GROUP, "__g")), F.col(GROUP) == F.col("__g")).drop("__g")
    else:
        facts = one_row(stats)
        joined = values.withColumns({n: facts[n] for n in ("n", "low", "high", "h")}).where("h is not null")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for key, part in frame.groupby(GROUP, dropna=False) if by else [(None, frame)]:
                n, low, high, h = part[["n", "low", "high", "h"]].iloc[0]
                if key not in sums:
                    sums[key] = (n, h, low + np.arange(points) * (high - low) / (points - 1), np.zeros(points))
                x, total = sums[key][2:]
                v = part["v"].to_numpy()
                for at in range(0, len(v), 4096):
                    total += np.exp(-0.5 * ((x - v[at : at + 4096, None]) / h) ** 2).sum(axis=0)
        for key, (n, h, x, total) in sums.items():
            own = {GROUP: [key] * points} if by else {}
            yield pd.DataFrame(own | {"point": range(points), "x": x, "part": total / (n * h * math.sqrt(2 * math.pi))})

    kind = [f"`{GROUP}` {joined.schema[GROUP].dataType.simpleString()}"] if by else []
    summed = joined.mapInPandas(partial, ", ".join([*kind, "point int, x double, part double"]))
    out = summed.groupBy(*by, "point").agg(F.first("x").alias("x"), F.sum("part").alias("density"))
    return out.withColumnRenamed(GROUP, group) if group else out


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: counts, mean, median, std, range, skewness, kurtosis."""
    values = df.select(num(df, column).alias("v"))
    stats = moments(F.col("v"))
    median = quantile_scalars(values, ["v"], [0.5])["v"][0]
    names = ("mean", "std", "min", "max", "skewness", "kurtosis")
    return values.agg(
        F.count("*").alias("original_count"), F.count("v").alias("valid_count"),
        (F.count("*") - F.count("v")).alias("missing_or_invalid_count"), *[stats[n].alias(n) for n in names],
    ).withColumn("median", median)


def violin(df: DataFrame, column: str, group: str, top: int = 30) -> DataFrame:
    """Density of each top category over its own range."""
    return density(df, column, group, top=top)


# Coefficients of algorithm AS 241 (Wichura 1988), highest power first: numerator and
# denominator near the middle, in the tails, and far out.
AS241 = (
    (2.50908_09287_30122_6727e+3, 3.34305_75583_58812_8105e+4, 6.72657_70927_00870_0853e+4, 4.59219_53931_54987_1457e+4, 1.37316_93765_50946_1125e+4, 1.97159_09503_06551_4427e+3, 1.33141_66789_17843_7745e+2, 3.38713_28727_96366_6080e+0),
    (5.22649_52788_52854_5610e+3, 2.87290_85735_72194_2674e+4, 3.93078_95800_09271_0610e+4, 2.12137_94301_58659_5867e+4, 5.39419_60214_24751_1077e+3, 6.87187_00749_20579_0830e+2, 4.23133_30701_60091_1252e+1, 1.0),
    (7.74545_01427_83414_07640e-4, 2.27238_44989_26918_45833e-2, 2.41780_72517_74506_11770e-1, 1.27045_82524_52368_38258e+0, 3.64784_83247_63204_60504e+0, 5.76949_72214_60691_40550e+0, 4.63033_78461_56545_29590e+0, 1.42343_71107_49683_57734e+0),
    (1.05075_00716_44416_84324e-9, 5.47593_80849_95344_94600e-4, 1.51986_66563_61645_71966e-2, 1.48103_97642_74800_74590e-1, 6.89767_33498_51000_04550e-1, 1.67638_48301_83803_84940e+0, 2.05319_16266_37758_82187e+0, 1.0),
    (2.01033_43992_92288_13265e-7, 2.71155_55687_43487_57815e-5, 1.24266_09473_88078_43860e-3, 2.65321_89526_57612_30930e-2, 2.96560_57182_85048_91230e-1, 1.78482_65399_17291_33580e+0, 5.46378_49111_64114_36990e+0, 6.65790_46435_01103_77720e+0),
    (2.04426_31033_89939_78564e-15, 1.42151_17583_16445_88870e-7, 1.84631_83175_10054_68180e-5, 7.86869_13114_56132_59100e-4, 1.48753_61290_85061_48525e-2, 1.36929_88092_27358_05310e-1, 5.99832_20655_58879_37690e-1, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution, to 16 digits; null outside of (0, 1)."""

    def poly(c: Sequence[float], x: Column) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * x + k
        return out

    q = p - 0.5
    middle = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    ratio = lambda i, x: poly(AS241[i], x) / poly(AS241[i + 1], x)
    tail = F.when(r <= 5, ratio(2, r - 1.6)).otherwise(ratio(4, r - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * ratio(0, middle)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), value)


def qq_points(df: DataFrame, column: str, key: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Ordered values against normal quantiles. `key` breaks ties, so equal values spread over ranges."""
    values = _values(df, column, keys=key)
    order = ["v", *[f"__key_{i}" for i in range(len(key))]]
    placed = with_position(values, order, out="i", ranges=ranges)
    n = values.agg(F.count("*")).scalar().cast("double")
    edge = F.pow(F.lit(0.5), 1.0 / n)
    i = F.col("i") + 1
    p = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    return placed.select(i.alias("rank"), normal_quantile(p).alias("theoretical"), F.col("v").alias("ordered"))


def qq_line(points: DataFrame) -> DataFrame:
    """The least-squares line through Q-Q points: slope, intercept, r, r2 (three points, two values)."""
    usable = (F.count("*") >= 3) & (F.min("ordered") < F.max("ordered"))
    r = F.try_divide(F.covar_pop("ordered", "theoretical"), F.stddev_pop("ordered") * F.stddev_pop("theoretical"))
    slope = F.try_divide(F.covar_pop("ordered", "theoretical"), F.var_pop("theoretical"))
    return points.agg(
        F.when(usable, slope).alias("slope"),
        F.when(usable, F.avg("ordered") - slope * F.avg("theoretical")).alias("intercept"),
        F.when(usable, r).alias("r"),
        F.when(usable, r * r).alias("r2"),
    )


# ---- correlation ------------------------------------------------------------------------------

def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)][:limit]


def pair_correlations(work: DataFrame, d: int) -> DataFrame:
    """i, j (i <= j) and Pearson's value of the columns c0, c1, ... over rows where both are present; null where one
    side is constant. Values are centred first, so a large offset costs no digits. Co-moments are matrix products of
    Arrow batches; only d*d partial sums travel."""
    means = work.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(d)]).first()
    center = np.array([means[f"c{i}"] or 0.0 for i in range(d)])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            x = frame.to_numpy(dtype=float) - center
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(d)
            yield pd.DataFrame(dict(zip(("i", "j", "n", "x", "y", "xx", "yy", "xy"), (i, j, *[t[i, j] for t in total]))))

    sums = work.mapInPandas(partial, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    vx = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    vy = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    flat = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
    value = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    return sums.select("i", "j", F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))).alias("value"))


def correlation(
    df: DataFrame, columns: Sequence[str] | None = None, limit=20, undefined: float | None = 0.0, drop_constant: bool = False
) -> DataFrame:
    """Pearson matrix in long form: x_column, y_column, value, over rows where both are present.

    All named columns take part; `limit` is for a call without names.
    """
    asked = [c for c in columns or df.columns if c in df.columns]
    kinds = [c for c in asked if columns or is_numeric(column_type(df, c)) or column_type(df, c).simpleString() == "string"]
    found = df.agg(
        *[F.count(num(df, c)).alias(f"n{i}") for i, c in enumerate(kinds)],
        *[(F.min(num(df, c)) < F.max(num(df, c))).alias(f"v{i}") for i, c in enumerate(kinds)],
    ).first()
    names = [c for i, c in enumerate(kinds) if found[f"n{i}"] and (not drop_constant or found[f"v{i}"])]
    if not columns:
        names = names[: max(2, int(limit))]
    if len(names) < 2:
        raise ValueError("A correlation matrix needs at least two numeric columns.")
    work = df.select(*[num(df, c).alias(f"c{i}") for i, c in enumerate(names)])
    half = pair_correlations(work, len(names))
    named = F.array(*[F.lit(n) for n in names])
    both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    pairs = half.select("value", F.explode(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)).alias("p"))
    value = F.col("value") if undefined is None else F.coalesce("value", F.lit(undefined))
    return pairs.select(F.get(named, F.col("p.i")).alias("x_column"), F.get(named, F.col("p.j")).alias("y_column"), value.alias("value"))


def correlation_wide(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """The matrix with one column per variable, rounded."""
    names = list(columns)
    cells = correlation(df, names)
    return cells.groupBy(F.col("x_column").alias("column")).pivot("y_column", names).agg(F.bround(F.first("value"), digits))


# ---- categories and shape ---------------------------------------------------------------------


def category_shares(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    """The top categories with count and percentage of present values."""
    total = df.agg(F.count(col(column))).scalar()
    return value_counts(df, column, n, missing=False).select(
        F.col("value").alias("category"), "count", share(F.col("count"), total).alias("percentage")
    )


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Classes of a target with count, percentage and the number of classes."""
    classes = df.agg(F.count_distinct(col(target))).scalar()
    return category_shares(df, target, 30).withColumn("class_count", classes)


# What counts as the positive and the negative class.
POSITIVE, NEGATIVE = ["yes", "y", "true", "1", "positive"], ["no", "n", "false", "0", "negative"]


def target_rate(df: DataFrame, category: str, target: str, n: int = 30) -> DataFrame:
    """Positive share of a two-valued target per category, highest first."""
    if df.select(col(target)).where(col(target).isNotNull()).distinct().limit(3).count() > 2:
        raise ValueError("The target has more than two values.")
    if is_numeric(column_type(df, target)):
        value = num(df, target)
    else:
        text = F.lower(F.trim(col(target).cast("string")))
        value = F.when(text.isin(POSITIVE), 1.0).when(text.isin(NEGATIVE), 0.0)
    rows = df.select(col(category).alias("category"), value.alias("hit")).where("category is not null and hit is not null")
    rates = rows.groupBy("category").agg((F.avg("hit") * 100).alias("target_rate"), F.count("*").alias("count"))
    return rates.orderBy(F.desc("target_rate"), "category").limit(n)


def pair_matrix(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, sample=None) -> DataFrame:
    """Complete rows of the named columns (without names: the first six numeric ones), as x/y points of every
    ordered column pair."""
    names = list(columns or numeric_columns(df, 6))
    if len(names) < 2:
        raise ValueError("A pair matrix needs at least two numeric columns.")
    rows = df.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(key)], *[num(df, c).alias(c) for c in names])
    rows = present(rows, names)
    rows = sample_rows(rows, sample, [f"__k{i}" for i in range(len(key))])
    cells = [
        F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), col(a).alias("x"), col(b).alias("y"))
        for a in names for b in names if a != b
    ]
    return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def shape_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, median, std, skewness, kurtosis and a shape label for each numeric column."""
    names = list(columns or numeric_columns(df))
    plain = df.select(*[num(df, c).alias(c) for c in names])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).alias("v")) for c in names])
    stats = moments(F.col("v"))
    long = plain.select(F.explode(cells).alias("c")).select("c.*")
    rows = long.groupBy("column_name").agg(
        F.count("v").alias("valid_count"), (F.count("*") - F.count("v")).alias("missing_or_invalid_count"),
        *[stats[n].alias(n) for n in ("mean", "std", "skewness", "kurtosis")],
    )
    wide = quantiles(plain, names, [0.5])
    middle = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.get(col(f"q_{c}"), F.lit(0)).alias("median")) for c in names
    ])).alias("c")).select("c.*")
    joined = rows.join(middle, "column_name")
    enough, bend = F.col("valid_count") >= 3, F.col("skewness")
    shape = F.when(~enough, "Not enough data").when(F.abs(bend) < 0.5, "Approximately symmetric")
    shape = shape.when(bend > 0, "Right-skewed").otherwise("Left-skewed")
    return joined.withColumns(
        {
            "shape": shape,
            "highly_skewed": F.coalesce(F.abs(bend) >= 1, F.lit(False)),
            "heavy_tails": F.coalesce(F.abs("kurtosis") >= 3, F.lit(False)),
        }
    )
