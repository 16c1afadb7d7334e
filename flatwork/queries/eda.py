"""Bins, boxes, densities, correlation, shares, before/after, forecast, what-if, chart requests."""

from pyspark.sql import functions as F

from flatwork.operators import compare as C
from flatwork.operators import dashboard as D
from flatwork.operators import eda as E
from flatwork.operators.profile import missing_counts
from flatwork.plans.charts import chart, required_columns
from flatwork.plans.preprocessing import check, contract, replay
from flatwork.queries.calculated import NUM
from flatwork.queries.registry import register

# Right-closed bins of equal width, counted against explicit edges.
RIGHT = """WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), e AS (SELECT CAST(i AS INTEGER) AS bin,
  CASE WHEN i = 1 THEN lo - (hi - lo) * 0.001 ELSE lo + (i - 1) * ((hi - lo) / {n}) END AS bin_start,
  CASE WHEN i = {n} THEN hi ELSE lo + i * ((hi - lo) / {n}) END AS bin_end FROM r, range(1, {n} + 1) s(i))"""
LEFT = """WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), e AS (SELECT CAST(i AS INTEGER) AS bin,
  lo + (i - 1) * ((hi - lo) / {n}) AS bin_start, CASE WHEN i = {n} THEN hi ELSE lo + i * ((hi - lo) / {n}) END AS bin_end, i = {n} AS final
  FROM r, range(1, {n} + 1) s(i))"""


def _bins(df):
    return df.select("bin", "count", F.round("bin_start", 4).alias("bin_start"), F.round("bin_end", 4).alias("bin_end"))


register(
    "histogram", "sparse", lambda df: _bins(E.histogram(df, "val", 10)),
    RIGHT.format(c="val", t="sparse", n=10)
    + """SELECT bin, count(val) AS count, round(bin_start, 4) AS bin_start, round(bin_end, 4) AS bin_end FROM e
         LEFT JOIN sparse ON val > bin_start AND val <= bin_end GROUP BY 1, 3, 4""",
)
register(
    "histogram_whole_numbers", "lineitem", lambda df: E.histogram(df, "l_quantity", 7).select("bin", "count"),
    RIGHT.format(c="l_quantity", t="lineitem", n=7)
    + "SELECT bin, count(l_quantity) AS count FROM e LEFT JOIN lineitem ON l_quantity > bin_start AND l_quantity <= bin_end GROUP BY 1",
)
register(
    "histogram_by_group", "sparse", lambda df: E.histogram(df, "val", 8, "grp").select("bin", "grp", "count"),
    RIGHT.format(c="val", t="sparse", n=8)
    + """SELECT bin, grp, count(*) AS count FROM e JOIN sparse ON val > bin_start AND val <= bin_end WHERE grp IS NOT NULL GROUP BY 1, 2""",
)
register(
    "histogram_left_closed", "part", lambda df: E.histogram(df, "p_size", 12, closed_right=False, minimum=2).select("bin", "count"),
    LEFT.format(c="p_size", t="part", n=12)
    + """SELECT bin, count(p_size) AS count FROM e LEFT JOIN part ON p_size >= bin_start AND (p_size < bin_end OR (final AND p_size = bin_end)) GROUP BY 1""",
)
register(
    "histogram_constant", "constants", lambda df: E.histogram(df, "const_col", 4).select("bin", "count", "label"),
    """SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i = 2 THEN count(const_col) ELSE 0 END AS count,
       CASE WHEN i <= 2 THEN '5 - 5' WHEN i = 3 THEN '5 - 5' ELSE '5 - 5' END AS label FROM constants, range(1, 5) s(i) GROUP BY i""",
)
register(
    "histogram_automatic", "orders", lambda df: E.automatic_histogram(df, "o_totalprice").select("bin", "count"),
    """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n,
         quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders),
       w AS (SELECT *, CAST(ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr * pow(n, -1.0 / 3))) AS INTEGER) AS b FROM s),
       e AS (SELECT CAST(i AS INTEGER) AS bin, lo + (i - 1) * ((hi - lo) / b) AS bin_start, CASE WHEN i = b THEN hi ELSE lo + i * ((hi - lo) / b) END AS bin_end, i = b AS final
         FROM w, range(1, 1000) s(i) WHERE i <= b)
       SELECT bin, count(o_totalprice) AS count FROM e LEFT JOIN orders ON o_totalprice >= bin_start AND (o_totalprice < bin_end OR (final AND o_totalprice = bin_end)) GROUP BY 1""",
)
register(
    "histogram_table_few_values", "sparse", lambda df: E.histogram_table(df, "grp"),
    "SELECT coalesce(grp, '[missing]') AS label, count(*) AS count FROM sparse GROUP BY 1",
)
register(
    "histogram_table_numbers", "sparse", lambda df: E.histogram_table(df, "val").select("count"),
    RIGHT.format(c="val", t="sparse", n=10) + "SELECT count(val) AS count FROM e LEFT JOIN sparse ON val > bin_start AND val <= bin_end GROUP BY bin",
)
register(
    "quick_table_text", "codes", lambda df: E.quick_table(df, "email"),
    "SELECT coalesce(email, '[missing]') AS label, count(*) AS count FROM codes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
register(
    "numeric_summary", "sparse",
    lambda df: E.numeric_summary(df, "val").select("row_count", "missing_count", "missing_percentage", "unique_count", "outlier_count",
                                                   F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("std", 4).alias("std")),
    """WITH q AS (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS b FROM sparse)
       SELECT count(*) AS row_count, count(*) - count(val) AS missing_count, round_even((count(*) - count(val)) * 100.0::DOUBLE / count(*), 2) AS missing_percentage,
       count(DISTINCT val) AS unique_count, count(*) FILTER (val < a - 1.5 * (b - a) OR val > b + 1.5 * (b - a)) AS outlier_count,
       round(avg(val), 4) AS mean, round(quantile_cont(val, 0.5), 4) AS median, round(stddev_samp(val), 4) AS std FROM sparse, q""",
)
BOX = """min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max, round(avg({c}), 4) AS mean, count({c}) AS count"""


def _box(df, *first):
    return df.select(*first, "min", "max", "count", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mean")])


register("box_whole", "sparse", lambda df: _box(E.box_chart(df, "val"), "category"), f"SELECT 'val' AS category, {BOX.format(c='val')} FROM sparse")
register(
    "box_by_category", "lineitem", lambda df: _box(E.box_chart(df, "l_extendedprice", "l_suppkey", 20), "l_suppkey"),
    f"""SELECT l_suppkey, {BOX.format(c='l_extendedprice')} FROM lineitem WHERE l_suppkey IN
        (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) GROUP BY 1""",
)
register(
    "box_by_median", "sparse", lambda df: E.box_by_median(df, "val", "grp").select("grp", F.round("median", 4).alias("median")),
    "SELECT grp, round(quantile_cont(val, 0.5), 4) AS median FROM sparse WHERE grp IS NOT NULL GROUP BY 1 ORDER BY 2, 1",
)
register(
    "box_whiskers", "outliers",
    lambda df: E.box_whiskers(df.withColumn("g", F.col("id") % 3), "val", "g", ["id"]).select(
        "g", "lower_whisker", "upper_whisker", "outlier_count", F.size("outliers").cast("long").alias("listed"),
        F.round(F.aggregate("outliers", F.lit(0.0), lambda a, v: a + v), 2).alias("listed_sum"), F.element_at("outliers", 1).alias("first_outlier")
    ),
    """WITH s AS (SELECT id % 3 AS g, id, val FROM outliers), q AS (SELECT g, quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS b FROM s GROUP BY 1),
       m AS (SELECT s.*, val BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AS inside FROM s JOIN q USING (g))
       , r AS (SELECT *, row_number() OVER (PARTITION BY g, inside ORDER BY id) AS i FROM m)
       SELECT g, min(val) FILTER (inside) AS lower_whisker, max(val) FILTER (inside) AS upper_whisker, count(*) FILTER (NOT inside) AS outlier_count,
       least(count(*) FILTER (NOT inside), 200) AS listed, round(sum(val) FILTER (NOT inside AND i <= 200), 2) AS listed_sum,
       arg_min(val, id) FILTER (NOT inside) AS first_outlier FROM r GROUP BY 1""",
)
register(
    "box_summary", "outliers",
    lambda df: E.box_summary(df, "val", ["id"]).select("min", "q1", "median", "q3", "max", "iqr", "outlier_count", F.size("outlier_sample").alias("shown")),
    """WITH q AS (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.5) AS m, quantile_cont(val, 0.75) AS b FROM outliers)
       SELECT round_even(min(val), 4) AS min, round_even(a, 4) AS q1, round_even(m, 4) AS median, round_even(b, 4) AS q3, round_even(max(val), 4) AS max,
       round_even(b - a, 4) AS iqr,
       count(*) FILTER (val < a - 1.5 * (b - a) OR val > b + 1.5 * (b - a)) AS outlier_count,
       CAST(least(20, count(*) FILTER (val < a - 1.5 * (b - a) OR val > b + 1.5 * (b - a))) AS INTEGER) AS shown FROM outliers, q GROUP BY a, m, b""",
)
KDE = """s AS (SELECT {g}count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM p {gb}),
  x AS (SELECT s.*, CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199 AS x FROM s, range(0, 200) r(i))
  SELECT {xg}point, round(x, 6) AS x, round(1e6 * sum(exp(-0.5 * ((x - v) / h) ** 2)) / (n * h * sqrt(2 * pi())), 6) AS density FROM x JOIN p {on} GROUP BY {xg}point, x, n, h"""


def _curve(df, *first):
    return df.select(*first, "point", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


register(
    "density", "part", lambda df: _curve(E.density(df, "p_retailprice")),
    "WITH p AS (SELECT p_retailprice AS v FROM part), " + KDE.format(g="", gb="", xg="", on="ON true"),
)
register(
    "violin", "customer", lambda df: _curve(E.violin(df, "c_acctbal", "c_mktsegment"), "c_mktsegment"),
    "WITH p AS (SELECT c_mktsegment, c_acctbal AS v FROM customer), "
    + KDE.format(g="c_mktsegment, ", gb="GROUP BY 1", xg="c_mktsegment, ", on="USING (c_mktsegment)"),
)
register(
    "distribution_summary", "sparse",
    lambda df: E.distribution_summary(df, "val").select("original_count", "valid_count", "missing_or_invalid_count", "min", "max",
                                                        F.round("median", 4).alias("median"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis")),
    """SELECT count(*) AS original_count, count(val) AS valid_count, count(*) - count(val) AS missing_or_invalid_count, min(val) AS min, max(val) AS max,
       round(quantile_cont(val, 0.5), 4) AS median, round(skewness(val), 6) AS skewness, round(kurtosis(val), 6) AS kurtosis FROM sparse""",
)
register("qq_points", "orders", lambda df: E.qq_points(df, "o_totalprice", ["o_orderkey"]))
register(
    "qq_ranks", "orders", lambda df: E.qq_points(df, "o_totalprice", ["o_orderkey"], ranges=6).select("rank", "ordered"),
    "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, o_totalprice AS ordered FROM orders",
)
register("qq_line", "orders", lambda df: E.qq_line(E.qq_points(df, "o_totalprice", ["o_orderkey"])))


def _corr_sql(table, names, undefined=True):
    cells = []
    for a in names:
        for b in names:
            both = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
            r = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) {both} * stddev_pop({b}) {both}, 0)"
            r = f"coalesce({r}, 0)" if undefined else r
            cells.append(f"SELECT '{a}' AS x_column, '{b}' AS y_column, round({r}, 8) + 0.0 AS value FROM {table}")
    return " UNION ALL ".join(cells)


def _corr(df):
    return df.select("x_column", "y_column", (F.round("value", 8) + 0.0).alias("value"))


LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("correlation", "lineitem", lambda df: _corr(E.correlation(df, LINE_NUMBERS)), _corr_sql("lineitem", LINE_NUMBERS))
register(
    "correlation_undefined", "constants", lambda df: _corr(E.correlation(df)), _corr_sql("constants", ["id", "const_col", "bin_col", "val"])
)
register(
    "correlation_no_constant", "constants", lambda df: _corr(E.correlation(df, undefined=None, drop_constant=True)), _corr_sql("constants", ["id", "bin_col", "val"], False)
)
register("correlation_sparse", "sparse", lambda df: _corr(E.correlation(df.select("id", "val"))), _corr_sql("sparse", ["id", "val"]))


def _wide(df):
    made = {f"m{i}": F.col("l_quantity") * i + F.col("l_extendedprice") / (i + 1) + F.col("l_tax") * 1000 * (i % 3) for i in range(14)}
    made["m3"] = F.when(F.col("l_linenumber") != 3, made["m3"])
    return df.select(*[c.alias(n) for n, c in made.items()])


_WIDE = "WITH w AS (SELECT " + ", ".join(
    (f"CASE WHEN l_linenumber <> 3 THEN l_quantity * {i} + l_extendedprice / ({i} + 1) + l_tax * 1000 * ({i} % 3) END" if i == 3
     else f"l_quantity * {i} + l_extendedprice / ({i} + 1) + l_tax * 1000 * ({i} % 3)") + f" AS m{i}" for i in range(14)
) + " FROM lineitem) "
register(
    "correlation_many_columns", "lineitem", lambda df: E.correlation(_wide(df)).withColumn("value", F.round("value", 6)),
    _WIDE + _corr_sql("w", [f"m{i}" for i in range(14)]).replace(", 8)", ", 6)"),
)
register(
    "correlation_wide", "lineitem",
    lambda df: E.correlation_wide(df, LINE_NUMBERS[:3], digits=3),
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", " + ", ".join(f"round_even(corr({a}, {b}), 3) AS {b}" for b in LINE_NUMBERS[:3]) + " FROM lineitem" for a in LINE_NUMBERS[:3]
    ),
)
register(
    "category_shares", "sparse", lambda df: E.category_shares(df, "grp"),
    "SELECT grp AS category, count(*) AS count, round_even(count(*) * 100.0::DOUBLE / (SELECT count(grp) FROM sparse), 2) AS percentage FROM sparse WHERE grp IS NOT NULL GROUP BY 1",
)
register(
    "target_balance", "target", lambda df: E.target_balance(df, "target"),
    """SELECT target AS category, count(*) AS count, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM target), 2) AS percentage,
       (SELECT count(DISTINCT target) FROM target) AS class_count FROM target GROUP BY 1""",
)
register(
    "target_rate", "target", lambda df: E.target_rate(df, "lang", "target").select("category", "count", F.round("target_rate", 6).alias("target_rate")),
    "SELECT lang AS category, count(*) AS count, round(avg(CASE WHEN target = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS target_rate FROM target GROUP BY 1",
)
register(
    "pair_matrix", "part", lambda df: E.pair_matrix(df, ["p_partkey"], ["p_size", "p_retailprice"], 400),
    """WITH s AS (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part ORDER BY md5(concat('42', CAST(p_partkey AS VARCHAR))) LIMIT 400)
       SELECT 'p_size' AS x_column, 'p_retailprice' AS y_column, a AS x, b AS y FROM s UNION ALL SELECT 'p_retailprice', 'p_size', b, a FROM s""",
)


def _shape_sql(table, names):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS valid_count, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
        round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
        CASE WHEN abs(skewness({c})) < 0.5 THEN 'Approximately symmetric' WHEN skewness({c}) > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS shape,
        abs(skewness({c})) >= 1 AS highly_skewed FROM {table}""" for c in names
    )


register(
    "shape_table", "outliers",
    lambda df: E.shape_table(df, ["val", "val2"]).select("column_name", "valid_count", "shape", "highly_skewed", F.round("mean", 4).alias("mean"),
                                                         F.round("median", 4).alias("median"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis")),
    _shape_sql("outliers", ["val", "val2"]),
)

# ---- before and after -----------------------------------------------------------------------
_MISS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS m, round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS p, {s} AS side FROM {t}"""
    for t, s in (("sparse", 0), ("cleaned", 1)) for c in ("id", "ts", "grp", "val")
)
register(
    "compare_missing", "sparse cleaned", C.missing_comparison,
    f"""WITH l AS ({_MISS}) SELECT column_name, max(m) FILTER (side = 0) AS missing_count_before, max(p) FILTER (side = 0) AS missing_percentage_before,
    max(m) FILTER (side = 1) AS missing_count_after, max(p) FILTER (side = 1) AS missing_percentage_after,
    max(p) FILTER (side = 0) - max(p) FILTER (side = 1) AS improvement FROM l GROUP BY 1""",
)
_FENCED = """(SELECT count(*) FILTER (val < a - 1.5 * (b - a) OR val > b + 1.5 * (b - a)) FROM {t}, (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS b FROM {t}))"""
register(
    "compare_outliers", "sparse cleaned",
    lambda b, a: C.outlier_comparison(b, a, ["val"]).select("column_name", "outlier_count_before", "outlier_count_after", "change"),
    f"""SELECT 'val' AS column_name, {_FENCED.format(t='sparse')} AS outlier_count_before, {_FENCED.format(t='cleaned')} AS outlier_count_after,
    {_FENCED.format(t='cleaned')} - {_FENCED.format(t='sparse')} AS change""",
)
register(
    "compare_distribution", "sparse cleaned", lambda b, a: C.distribution_change(b, a, "val", 10).select("bin", "count_before", "count_after"),
    """WITH u AS (SELECT val, 0 AS s FROM sparse WHERE val IS NOT NULL UNION ALL SELECT val, 1 FROM cleaned), """
    + LEFT.format(c="val", t="u", n=10)[5:]
    + """SELECT bin, count(*) FILTER (s = 0) AS count_before, count(*) FILTER (s = 1) AS count_after FROM e
         LEFT JOIN u ON val >= bin_start AND (val < bin_end OR (final AND val = bin_end)) GROUP BY 1""",
)
register(
    "compare_correlation", "sparse cleaned",
    lambda b, a: C.correlation_shift(b.select("id", "val"), a.select("id", "val"), ["id", "val"])
    .select("x_column", "y_column", F.round("value_before", 8).alias("value_before"), F.round("value_after", 8).alias("value_after"), F.round("delta", 8).alias("delta")),
    """WITH v AS (SELECT (SELECT corr(id, val) FROM sparse) AS b, (SELECT corr(id, val) FROM cleaned) AS a)
       SELECT x_column, y_column, round(CASE WHEN x_column = y_column THEN 1.0 ELSE b END, 8) AS value_before,
         round(CASE WHEN x_column = y_column THEN 1.0 ELSE a END, 8) AS value_after, round(CASE WHEN x_column = y_column THEN 0.0 ELSE a - b END, 8) AS delta
       FROM v, (VALUES ('id', 'id'), ('id', 'val'), ('val', 'id'), ('val', 'val')) c(x_column, y_column)""",
)
register(
    "correlation_large_offset", "orders",
    lambda df: E.correlation(df.select((1e9 + F.col("o_totalprice") / 1e7).alias("a"), (1e9 + F.col("o_custkey") / 1e5).alias("b")), ["a", "b"])
    .select("x_column", "y_column", F.round("value", 4).alias("value")),
    """WITH v AS (SELECT round(corr(1e9::DOUBLE + o_totalprice / 1e7::DOUBLE, 1e9::DOUBLE + o_custkey / 1e5::DOUBLE), 4) AS r FROM orders)
       SELECT x AS x_column, y AS y_column, CASE WHEN x = y THEN 1.0 ELSE r END AS value FROM v, (VALUES ('a', 'a'), ('a', 'b'), ('b', 'a'), ('b', 'b')) c(x, y)""",
)
register(
    "compare_features", "sparse cleaned",
    lambda b, a: C.feature_validation(b, a.withColumns({"twice": F.col("val") * 2, "flag": F.when(F.col("val") > 0, 1)}), "val").select(
        "column_name", "is_new", "missing_count", "unique_count", F.round("target_correlation", 6).alias("target_correlation")),
    """SELECT 'twice' AS column_name, true AS is_new, 0 * count(*) AS missing_count, count(DISTINCT val * 2) AS unique_count, 1.0::DOUBLE AS target_correlation FROM cleaned
       UNION ALL SELECT 'flag', true, count(*) FILTER (NOT val > 0), 1, NULL FROM cleaned""",
)
register(
    "compare_target_balance", "cleaned", lambda df: E.target_balance(df, "grp").select("category", "count", "class_count"),
    "SELECT grp AS category, count(*) AS count, (SELECT count(DISTINCT grp) FROM cleaned) AS class_count FROM cleaned GROUP BY 1",
)
register(
    "compare_summary", "sparse cleaned",
    lambda b, a: C.validation_summary(b, a, ["val"]).select("stage", "row_count", "total_missing_cells", "duplicate_row_count", "outliers"),
    f"""SELECT 'before' AS stage, count(*) AS row_count, 2 * count(*) - count(grp) - count(val) AS total_missing_cells, 0 * count(*) AS duplicate_row_count,
    {_FENCED.format(t='sparse')} AS outliers FROM sparse UNION ALL SELECT 'after', count(*), 2 * count(*) - count(grp) - count(val), 0, {_FENCED.format(t='cleaned')} FROM cleaned""",
)

# ---- dashboard ------------------------------------------------------------------------------
register(
    "forecast", "orders",
    lambda df: D.forecast(df, "o_orderdate", "o_totalprice", 6).select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 2).alias("value"), "is_forecast"),
    """WITH h AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
       l AS (SELECT avg(v) AS v, max(p) AS p FROM (SELECT * FROM h ORDER BY p DESC LIMIT 3)),
       f AS (SELECT p + to_months(CAST(i AS INTEGER)) AS p, v FROM l, range(1, 7) r(i))
       SELECT strftime(p, '%Y-%m-%d') AS period, round(v, 2) AS value, false AS is_forecast FROM h UNION ALL SELECT strftime(p, '%Y-%m-%d'), round(v, 2), true FROM f""",
)
register(
    "what_if", "lineitem",
    lambda df: D.what_if(df, "l_extendedprice", "percentage", 10, "l_extendedprice", "sum", ["l_returnflag"]).select(
        "l_returnflag", *[F.round(c, 2).alias(c) for c in ("baseline", "scenario", "change")]),
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS baseline, round(sum(l_extendedprice * 1.1), 2) AS scenario,
       round(sum(l_extendedprice * 1.1) - sum(l_extendedprice), 2) AS change FROM lineitem GROUP BY 1""",
)
register(
    "what_if_amount", "part",
    lambda df: D.what_if(df, "p_size", "amount", 5, "p_size", "mean").select(F.round("baseline", 6).alias("baseline"), F.round("scenario", 6).alias("scenario")),
    "SELECT round(avg(p_size), 6) AS baseline, round(avg(p_size) + 5, 6) AS scenario FROM part",
)

# ---- requests and plans ---------------------------------------------------------------------
register(
    "request_bar", "lineitem",
    lambda df: chart(df, {
        "chart_type": "bar", "x_column": "l_returnflag", "multi_series": [{"column": "net", "aggregation": "sum"}, {"column": "l_quantity", "aggregation": "avg"}],
        "calculated_fields": [{"field_name": "net", "expression": "l_extendedprice * (1 - l_discount)", "output_type": "number"}],
        "filters": [{"field": "l_quantity", "op": ">", "value": 10}], "top_n": 2,
    }).select("l_returnflag", F.round("net", 2).alias("net"), F.round("l_quantity", 6).alias("l_quantity")),
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_quantity), 6) AS l_quantity FROM lineitem
       WHERE l_quantity > 10 GROUP BY 1 ORDER BY 2 DESC LIMIT 2""",
)
register(
    "request_heatmap", "orders",
    lambda df: chart(df, {"chart_type": "heatmap", "dimension": "o_orderpriority", "group_by_column": "o_orderstatus"}),
    """WITH x AS (SELECT DISTINCT o_orderpriority FROM orders), g AS (SELECT DISTINCT o_orderstatus FROM orders)
       SELECT o_orderpriority, o_orderstatus, count(o_orderkey) AS value FROM x CROSS JOIN g LEFT JOIN orders USING (o_orderpriority, o_orderstatus) GROUP BY 1, 2""",
)
register(
    "request_kpi", "orders", lambda df: chart(df, {"chart_type": "kpi", "measure": "o_totalprice", "aggregation": "average", "title": "Mean price"}).select("metric", F.round("value", 4).alias("value")),
    "SELECT 'Mean price' AS metric, round(avg(o_totalprice), 4) AS value FROM orders",
)
register(
    "request_map", "geo", lambda df: chart(df, {"chart_type": "map", "location_column": "location", "measure": "val", "aggregation": "max"}),
    "SELECT location, max(val) AS value FROM geo GROUP BY 1",
)
register(
    "request_columns", "sparse",
    lambda df: missing_counts(df.select(*required_columns({
        "chart_type": "bar", "x_column": "grp", "y_column": "net", "filters": [{"column": "ts", "operator": "not_null"}],
        "calculated_fields": [{"field_name": "net", "expression": "val * 2"}]}, df.columns))).select("column_name", "missing_count"),
    """SELECT 'ts' AS column_name, count(*) - count(ts) AS missing_count FROM sparse UNION ALL SELECT 'grp', count(*) - count(grp) FROM sparse
       UNION ALL SELECT 'val', count(*) - count(val) FROM sparse""",
)
PLAN = [
    {"column": "grp", "impute": "missing_category"},
    {"column": "grp", "new_column": "urgent", "rule": {"operation": "contains_keyword_flag", "parameters": {"keyword": "urgent"}}},
    {"column": "val", "impute": "median_imputation"},
    {"column": "val", "transform": "log_transform", "new_column": "val_log"},
]
register(
    "plan_replay", "sparse", lambda df: replay(df, PLAN).select("id", "grp", "urgent", F.round("val_log", 6).alias("val_log")),
    """SELECT id, coalesce(grp, 'Missing') AS grp, CAST(contains(lower(coalesce(grp, 'Missing')), 'urgent') AS INTEGER) AS urgent,
       round(ln(coalesce(val, (SELECT quantile_cont(val, 0.5) FROM sparse))), 6) AS val_log FROM sparse""",
)
register(
    "plan_contract", "sparse",
    lambda df: contract(df, [*PLAN, {"column": "o_custkey", "impute": "fill_zero"}]).join(missing_counts(df), "column_name", "left")
    .select("column_name", "present", "missing_count"),
    """SELECT 'grp' AS column_name, true AS present, count(*) - count(grp) AS missing_count FROM sparse UNION ALL
       SELECT 'val', true, count(*) - count(val) FROM sparse UNION ALL SELECT 'o_custkey', false, NULL""",
)
register(
    "plan_check", "text_numbers",
    lambda df: check(df, [
        {"column": "amount_text", "impute": "median_imputation"},
        {"column": "amount_text", "impute": "group_mean_imputation", "group_column": "region"},
        {"column": "amount_text", "transform": "log_transform", "new_column": "amount_log"},
        {"column": "amount_log", "outliers": "winsorization"},
        {"column": "grp", "outliers": "iqr_capping"},
        {"column": "grp", "impute": "missing_category"},
        {"column": "absent", "impute": "fill_zero"},
    ]),
    f"""WITH s AS (SELECT count(*) AS n, count(*) FILTER (amount_text IS NULL) AS m, count(*) FILTER (amount_text IS NOT NULL AND ({NUM}) IS NULL) AS u,
         count(*) FILTER (amount_text IS NOT NULL AND NOT coalesce(({NUM}) > 0, false)) AS l, count(*) - count(grp) AS g, count(grp) AS h FROM text_numbers)
       SELECT v.* FROM s, LATERAL (VALUES (1, 'amount_text', true, m, u, n > m + u), (2, 'amount_text', true, m, u, false),
         (3, 'amount_text', true, m, l, n > m + l), (4, 'amount_log', true, NULL, NULL, true), (5, 'grp', true, g, h, false),
         (6, 'grp', true, g, 0, n > g), (7, 'absent', false, NULL, NULL, false)) v(step, column_name, present, missing_count, unusable_count, fits)""",
)
