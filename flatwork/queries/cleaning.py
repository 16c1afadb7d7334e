"""Imputation, outliers, anomalies, reports."""

from pyspark.sql import functions as F

from flatwork.operators.cleaning import anomaly as M
from flatwork.operators.cleaning import outliers as O
from flatwork.operators.cleaning import report as R
from flatwork.operators.cleaning.apply import apply_actions
from flatwork.operators.cleaning.impute import fill_rolling_mean, impute, imputed_value
from flatwork.operators.ordered import backward_fill, forward_fill, interpolate_linear, rolling_mean, with_position
from flatwork.queries.profiles import TYPE_SQL, _basic, _pct, _union
from flatwork.queries.registry import register


def _impute(method, column="val", digits=4, **more):
    def build(df):
        out = impute(df, column, method, **more)
        value = F.round(column, digits) if digits is not None else F.col(column)
        return out.select("id", value.alias("v"))

    return build


def _filled(name, method, sql, column="val", digits=4, table="sparse", **more):
    register(f"impute_{name}", table, _impute(method, column, digits, **more), sql)


_filled("mean", "mean_imputation", "SELECT id, round(coalesce(val, avg(val) OVER ()), 4) AS v FROM sparse")
_filled("median", "median_imputation", "SELECT id, round(coalesce(val, (SELECT quantile_cont(val, 0.5) FROM sparse)), 4) AS v FROM sparse")
_filled(
    "mode", "mode_imputation",
    """SELECT id, coalesce(grp, (SELECT grp FROM sparse WHERE grp IS NOT NULL GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1)) AS v FROM sparse""",
    column="grp", digits=None,
)
_filled("zero", "fill_zero", "SELECT id, coalesce(val, 0) AS v FROM sparse", digits=None)
_filled("custom_value", "custom_value", "SELECT id, coalesce(val, 12.5) AS v FROM sparse", digits=None, custom_value=12.5)
_filled("custom_text", "custom_value", "SELECT id, coalesce(grp, 'none') AS v FROM sparse", column="grp", digits=None, custom_value="none")
_filled("missing_category", "missing_category", "SELECT id, coalesce(grp, 'Missing') AS v FROM sparse", column="grp", digits=None)
_filled("empty_string", "empty_string", "SELECT id, coalesce(grp, '') AS v FROM sparse", column="grp", digits=None)
_filled("missing_token", "missing_token", "SELECT id, coalesce(grp, 'MISSING') AS v FROM sparse", column="grp", digits=None)
_filled("drop_rows", "drop_rows", "SELECT id, val AS v FROM sparse WHERE val IS NOT NULL", digits=None)
register("impute_drop_column", "sparse", lambda df: impute(df, "val", "drop_column").select("id", "grp"), "SELECT id, grp FROM sparse")
register(
    "impute_missing_indicator",
    "sparse",
    lambda df: impute(df, "val", "missing_indicator").select("id", "val_was_missing"),
    "SELECT id, CAST(val IS NULL AS INTEGER) AS val_was_missing FROM sparse",
)
_filled(
    "group_mean", "group_mean_imputation",
    """WITH f AS (SELECT id, coalesce(val, CASE WHEN grp IS NOT NULL THEN avg(val) OVER (PARTITION BY grp) END) AS v FROM sparse)
       SELECT id, round(coalesce(v, (SELECT avg(v) FROM f)), 4) AS v FROM f""",
    group_column="grp",
)
_filled(
    "group_median", "group_median_imputation",
    """WITH g AS (SELECT grp, quantile_cont(val, 0.5) AS m FROM sparse WHERE grp IS NOT NULL GROUP BY 1),
       f AS (SELECT id, coalesce(val, m) AS v FROM sparse LEFT JOIN g USING (grp))
       SELECT id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM f)), 4) AS v FROM f""",
    group_column="grp",
)
register(
    "impute_group_mode",
    "sparse",
    lambda df: impute(df.withColumn("year", F.when(F.col("id") % 11 != 0, F.year("ts"))), "grp", "group_mode_imputation", group_column="year")
    .select("id", F.col("grp").alias("v")),
    """WITH s AS (SELECT id, grp, CASE WHEN id % 11 <> 0 THEN year(ts) END AS y FROM sparse),
       m AS (SELECT y, grp AS m FROM s WHERE grp IS NOT NULL AND y IS NOT NULL GROUP BY y, grp QUALIFY row_number() OVER (PARTITION BY y ORDER BY count(*) DESC, grp) = 1),
       f AS (SELECT id, coalesce(grp, m) AS v FROM s LEFT JOIN m USING (y))
       SELECT id, coalesce(v, (SELECT v FROM f WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v FROM f""",
)
register(
    "impute_rare_grouping",
    "sparse",
    lambda df: impute(df.withColumn("c", F.expr("cast(id % 100 * (id % 3) as string)")), "c", "rare_category_grouping", params={"minimum_frequency": 0.004})
    .select("id", "c"),
    """WITH s AS (SELECT id, CAST(id % 100 * (id % 3) AS VARCHAR) AS c FROM sparse)
       SELECT id, CASE WHEN count(*) OVER (PARTITION BY c) < 0.004 * count(*) OVER () THEN 'Other' ELSE c END AS c FROM s""",
)
register(
    "imputed_values",
    "sparse",
    lambda df: df.select(F.lit("mean").alias("method")).limit(1).select(
        F.round(imputed_value(df, "val", "mean_imputation").cast("double"), 4).alias("mean"),
        F.round(imputed_value(df, "val", "median_imputation").cast("double"), 4).alias("median"),
        imputed_value(df, "grp", "mode_imputation").alias("mode"),
    ),
    """SELECT round(avg(val), 4) AS mean, round(quantile_cont(val, 0.5), 4) AS median,
       (SELECT grp FROM sparse WHERE grp IS NOT NULL GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1) AS mode FROM sparse""",
)

FFILL = "SELECT event_id, last_value(value IGNORE NULLS) OVER ({p}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM gaps"
BFILL = "SELECT event_id, first_value(value IGNORE NULLS) OVER ({p}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM gaps"
ROLL = """WITH r AS (SELECT event_id, value, avg(value) OVER (ORDER BY ts ROWS 3 PRECEDING) AS m FROM gaps)
          SELECT event_id, round(m, 6) AS mean FROM r"""
LINE = """WITH p AS (SELECT event_id, {k}value, row_number() OVER ({p}ORDER BY ts) AS i, ts FROM gaps),
          q AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER ({p}ORDER BY i ROWS UNBOUNDED PRECEDING) AS lo,
            min(CASE WHEN value IS NOT NULL THEN i END) OVER ({p}ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM p)
          SELECT q.event_id, round(CASE WHEN q.value IS NOT NULL THEN q.value WHEN q.lo IS NULL THEN NULL WHEN q.hi IS NULL THEN a.value
            ELSE a.value + (b.value - a.value) * (q.i - q.lo) / (q.hi - q.lo) END, 6) AS value
          FROM q LEFT JOIN p a ON a.i = q.lo {ja}LEFT JOIN p b ON b.i = q.hi {jb}"""
for _ranges, _tag in ((None, ""), (11, "_ranged")):
    register(f"forward_fill{_tag}", "gaps", lambda df, r=_ranges: forward_fill(df, "value", ["ts"], ranges=r).select("event_id", "value"), FFILL.format(p=""))
    register(f"backward_fill{_tag}", "gaps", lambda df, r=_ranges: backward_fill(df, "value", ["ts"], ranges=r).select("event_id", "value"), BFILL.format(p=""))
    register(
        f"interpolate{_tag}", "gaps",
        lambda df, r=_ranges: interpolate_linear(df, "value", ["ts"], ranges=r).select("event_id", F.round("value", 6).alias("value")),
        LINE.format(p="", k="", ja="", jb=""),
    )
    register(
        f"rolling_mean{_tag}", "gaps",
        lambda df, r=_ranges: rolling_mean(df, "value", ["ts"], 4, out="mean", ranges=r).select("event_id", F.round("mean", 6).alias("mean")),
        ROLL,
    )
BY_USER = "PARTITION BY user_id "
register("forward_fill_by_user", "gaps", lambda df: forward_fill(df, "value", ["ts"], ["user_id"], 900).select("event_id", "value"), FFILL.format(p=BY_USER))
register("backward_fill_by_user", "gaps", lambda df: backward_fill(df, "value", ["ts"], ["user_id"], 900).select("event_id", "value"), BFILL.format(p=BY_USER))
register(
    "interpolate_by_user", "gaps",
    lambda df: interpolate_linear(df, "value", ["ts"], ["user_id"], 900).select("event_id", F.round("value", 6).alias("value")),
    LINE.format(p=BY_USER, k="user_id, ", ja="AND a.user_id = q.user_id ", jb="AND b.user_id = q.user_id"),
)
register(
    "row_position", "gaps",
    lambda df: with_position(df, ["ts"], ["event_type"], "at", 900).select("event_id", "at"),
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS at FROM gaps",
)
register(
    "impute_rolling_mean", "gaps",
    lambda df: fill_rolling_mean(df, "value", ["ts"], 2).select("event_id", F.round("value", 6).alias("value")),
    """WITH r AS (SELECT event_id, coalesce(value, avg(value) OVER (ORDER BY ts ROWS 1 PRECEDING)) AS v FROM gaps)
       SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM r)), 6) AS value FROM r""",
)
register(
    "impute_by_model", "sparse",
    lambda df: impute(df.withColumn("day", F.datediff("ts", F.lit("1990-01-01"))), "val", "model_based_imputation", params={"features": ["id", "day"]}).select("id", "val"),
)
register(
    "impute_by_class_model", "sparse",
    lambda df: impute(df, "grp", "predictive_imputation", params={"features": ["id", "val"]}).select("id", "grp"),
)
register(
    "impute_chained", "sparse",
    lambda df: impute(df.withColumn("day", F.datediff("ts", F.lit("1990-01-01"))), "val", "mice_imputation", params={"features": ["id", "day"], "rounds": 2}).select("id", "val"),
)
register(
    "impute_nearest", "sparse",
    lambda df: impute(df.withColumn("day", F.datediff("ts", F.lit("1990-01-01"))), "val", "knn_imputation", params={"features": ["id", "day"], "k": 5}).select("id", F.round("val", 4).alias("val")),
    """WITH s AS (SELECT avg(id) AS ma, stddev_pop(id) AS sa, avg(day) AS mb, stddev_pop(day) AS sb FROM (SELECT id, date_diff('day', DATE '1990-01-01', ts::DATE) AS day FROM sparse)),
       z AS (SELECT id, val, (id - ma) / sa AS a, (date_diff('day', DATE '1990-01-01', ts::DATE) - mb) / sb AS b FROM sparse, s),
       guess AS (SELECT p.id, list_avg(arg_min(q.val, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2), 5)) AS v
         FROM z p JOIN z q ON p.val IS NULL AND q.val IS NOT NULL GROUP BY p.id)
       SELECT id, round(coalesce(val, v), 4) AS val FROM sparse LEFT JOIN guess USING (id)""",
)

# ---- outliers -------------------------------------------------------------------------------
FENCE = "WITH q AS (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS b FROM outliers), f AS (SELECT a - {m} * (b - a) AS lo, b + {m} * (b - a) AS hi FROM q) "
ZED = "WITH f AS (SELECT avg(val) - {t} * stddev_pop(val) AS lo, avg(val) + {t} * stddev_pop(val) AS hi FROM outliers) "
MAD = """WITH m AS (SELECT quantile_cont(val, 0.5) AS m FROM outliers), d AS (SELECT quantile_cont(abs(val - m), 0.5) AS d FROM outliers, m),
  f AS (SELECT m - 3.5 / 0.6745 * d AS lo, m + 3.5 / 0.6745 * d AS hi FROM m, d) """
CENT = "WITH f AS (SELECT quantile_cont(val, 0.01) AS lo, quantile_cont(val, 0.99) AS hi FROM outliers) "
for _method, _with, _shown in (
    ("iqr_detection", FENCE.format(m=1.5), True), ("zscore_detection", ZED.format(t=3), False),
    ("modified_zscore_detection", MAD, False), ("percentile_capping", CENT, True),
):
    _base = O.BASE_RULE.get(_method, _method)
    _bounds = "round_even(lo, 2) AS lower_bound, round_even(hi, 2) AS upper_bound" if _shown else "CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound"
    register(
        f"outlier_preview_{_base}", "outliers", lambda df, m=_method: O.preview_outliers(df, "val", m),
        _with + f"""SELECT '{_method}' AS method, '{_base}' AS preview_method, count(*) FILTER (val < lo OR val > hi) AS outlier_count,
          round_even(count(*) FILTER (val < lo OR val > hi) * 100.0::DOUBLE / count(*), 2) AS outlier_percentage, {_bounds}
          FROM outliers, f GROUP BY lo, hi""",
    )
    register(
        f"outlier_flags_{_base}", "outliers", lambda df, m=_base: O.flag_outliers(df, "val", m, out="flag").select("id", "flag"),
        _with + "SELECT id, CAST(val < lo OR val > hi AS INTEGER) AS flag FROM outliers, f",
    )
register(
    "outlier_preview_log_transform", "outliers", lambda df: O.preview_outliers(df, "val", "log_transform").select("method", "outlier_count"),
    "SELECT 'log_transform' AS method, count(*) - count(*) AS outlier_count FROM outliers",
)
register(
    "outlier_cap_iqr", "outliers", lambda df: O.handle_outliers(df, "val", "iqr_capping").select("id", F.round("val", 4).alias("val")),
    FENCE.format(m=1.5) + "SELECT id, round(least(greatest(val, lo), hi), 4) AS val FROM outliers, f",
)
register(
    "outlier_cap_iqr_wide", "outliers",
    lambda df: O.handle_outliers(df, "val", "iqr_capping", {"iqr_multiplier": 3}).select("id", F.round("val", 4).alias("val")),
    FENCE.format(m=3) + "SELECT id, round(least(greatest(val, lo), hi), 4) AS val FROM outliers, f",
)
register(
    "outlier_cap_percentile", "outliers", lambda df: O.handle_outliers(df, "val", "percentile_capping").select("id", F.round("val", 4).alias("val")),
    CENT + "SELECT id, round(least(greatest(val, lo), hi), 4) AS val FROM outliers, f",
)
register(
    "outlier_remove_zscore", "outliers", lambda df: O.handle_outliers(df, "val", "zscore_removal", {"zscore_threshold": 2}).select("id"),
    ZED.format(t=2) + "SELECT id FROM outliers, f WHERE val BETWEEN lo AND hi",
)
register(
    "outlier_remove_zscore_constant", "constants", lambda df: O.remove_by_zscore(df, "const_col").select("id"), "SELECT id FROM constants"
)
register(
    "outlier_winsorize", "outliers", lambda df: O.handle_outliers(df, "val", "winsorization", {"lower_limit": 0.02, "upper_limit": 0.03}).select("id", "val"),
    """WITH r AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS i, count(*) OVER () AS n FROM outliers),
       b AS (SELECT max(CASE WHEN i = floor(n * 0.02) THEN val END) AS lo, max(CASE WHEN i = n - floor(n * 0.03) - 1 THEN val END) AS hi FROM r)
       SELECT id, least(greatest(val, lo), hi) AS val FROM outliers, b""",
)
register("outlier_no_change", "outliers", lambda df: O.handle_outliers(df, "val", "review_extreme_values").select("id", "val"), "SELECT id, val FROM outliers")
for _method, _sql in {
    "log_transform": "CASE WHEN val > 0 THEN ln(val) END", "sqrt_transform": "CASE WHEN val >= 0 THEN sqrt(val) END", "cube_root_transform": "cbrt(val)",
}.items():
    register(
        f"transform_{_method.removesuffix('_transform')}", "outliers",
        lambda df, m=_method: O.transform(df, "val", m, "t").select("id", F.round("t", 8).alias("t")),
        f"SELECT id, round({_sql}, 8) AS t FROM outliers",
    )
register(
    "transform_boxcox_power", "outliers", lambda df: O.transform(df, "val", "boxcox_transform", "t", 0.5).select("id", F.round("t", 6).alias("t")),
    "SELECT id, round((sqrt(val) - 1) / 0.5, 6) AS t FROM outliers",
)
register(
    "transform_yeojohnson_power", "customer", lambda df: O.transform(df, "c_acctbal", "yeojohnson_transform", "t", 0.5).select("c_custkey", F.round("t", 6).alias("t")),
    """SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (sqrt(c_acctbal + 1) - 1) / 0.5
       ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 6) AS t FROM customer""",
)
# The likelihood of every exponent of a wide grid, and the best one.
_BOXCOX = "CASE WHEN p = 0 THEN ln(v) ELSE (pow(v, p) - 1) / p END"
_YEOJOHNSON = """CASE WHEN v >= 0 THEN CASE WHEN p = 0 THEN ln(1 + v) ELSE (pow(v + 1, p) - 1) / p END
  ELSE CASE WHEN p = 2 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - p) - 1) / (2 - p) END END"""
_FIT = """WITH x AS (SELECT {column} AS v FROM {table}), g AS (SELECT i / 200.0::DOUBLE AS p FROM range({low} * 200, {high} * 200 + 1) r(i)),
  s AS (SELECT p, var_pop({shape}) AS s2, count(*) AS n, sum({jacobian}) AS j FROM x, g GROUP BY p),
  f AS (SELECT arg_max(p, -0.5 * n * ln(s2) + (p - 1) * j) AS p FROM s WHERE s2 > 0) """
_SIGNED = "sign(v) * ln(1 + abs(v))"
register(
    "transform_boxcox", "outliers", lambda df: O.transform(df, "val", "boxcox_transform", "t").select("id", F.round("t", 6).alias("t")),
    _FIT.format(column="val", table="outliers", low=-4, high=4, shape=_BOXCOX, jacobian="ln(v)") + f"SELECT id, round({_BOXCOX}, 6) AS t FROM (SELECT id, val AS v, p FROM outliers, f)",
)
register(
    "transform_yeojohnson", "customer", lambda df: O.transform(df, "c_acctbal", "yeojohnson_transform", "t").select("c_custkey", F.round("t", 6).alias("t")),
    _FIT.format(column="c_acctbal", table="customer", low=-4, high=4, shape=_YEOJOHNSON, jacobian=_SIGNED)
    + f"SELECT c_custkey, round({_YEOJOHNSON}, 6) AS t FROM (SELECT c_custkey, c_acctbal AS v, p FROM customer, f)",
)
# An optimum far from the first grid: the eighth root of prices.
_ROOT = "pow(o_totalprice, 0.125)"
register(
    "transform_far_power", "orders",
    lambda df: O.transform(df.selectExpr("o_orderkey", f"{_ROOT} AS root"), "root", "boxcox_transform", "t").select("o_orderkey", F.round("t", 2).alias("t")),
    _FIT.format(column=_ROOT, table="orders", low=0, high=16, shape=_BOXCOX, jacobian="ln(v)")
    + f"SELECT o_orderkey, round({_BOXCOX}, 2) AS t FROM (SELECT o_orderkey, {_ROOT} AS v, p FROM orders, f)",
)

# ---- anomalies ------------------------------------------------------------------------------
register(
    "anomaly_mahalanobis", "outliers",
    lambda df: M.flag_anomalies(df, ["val", "val2"], "mahalanobis_distance").select("id", F.round("anomaly_score", 6).alias("score"), "anomaly_flag"),
    """WITH s AS (SELECT avg(val) AS mx, avg(val2) AS my, var_samp(val) AS vx, var_samp(val2) AS vy, covar_samp(val, val2) AS c FROM outliers),
       d AS (SELECT id, sqrt(((val - mx) ** 2 * vy - 2 * (val - mx) * (val2 - my) * c + (val2 - my) ** 2 * vx) / (vx * vy - c * c)) AS m FROM outliers, s)
       SELECT id, round(m, 6) AS score, CAST(m > 3 AS INTEGER) AS anomaly_flag FROM d""",
)
register(
    "anomaly_cooks_distance", "sparse",
    lambda df: M.cooks_distance(df, ["id"], "val").select("id", F.round(F.col("anomaly_score") * 1e6, 4).alias("score"), "anomaly_flag"),
    """WITH c AS (SELECT id, CAST(id AS DOUBLE) AS x, val AS y FROM sparse WHERE val IS NOT NULL),
       s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) * count(*) AS sxx,
         var_pop(y) * count(*) - regr_slope(y, x) * covar_pop(x, y) * count(*) AS sse FROM c),
       r AS (SELECT id, (y - my - b * (x - mx)) AS e, 1.0 / n + (x - mx) ** 2 / sxx AS h, sse / (n - 2) AS s2, n FROM c, s),
       k AS (SELECT id, e * e * h / (2 * s2 * (1 - h) ** 2) AS d, n FROM r)
       SELECT sparse.id, round(d * 1e6, 4) AS score, CAST(coalesce(d > 4.0 / n, false) AS INTEGER) AS anomaly_flag FROM sparse LEFT JOIN k USING (id)""",
)
register(
    "anomaly_isolation_forest", "outliers",
    lambda df: M.flag_anomalies(df, ["val", "val2"], "isolation_forest").select("id", F.round("anomaly_score", 6).alias("score"), "anomaly_flag"),
)
register(
    "anomaly_local_outlier_factor", "outliers",
    lambda df: M.flag_anomalies(df, ["val", "val2"], "local_outlier_factor").select("id", F.round("anomaly_score", 6).alias("score"), "anomaly_flag"),
    """WITH s AS (SELECT avg(val) AS ma, stddev_pop(val) AS sa, avg(val2) AS mb, stddev_pop(val2) AS sb FROM outliers),
       z AS (SELECT id, (val - ma) / sa AS a, (val2 - mb) / sb AS b FROM outliers, s),
       pairs AS (SELECT p.id, q.id AS o, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2) AS d FROM z p JOIN z q ON p.id <> q.id),
       near AS (SELECT id, unnest(arg_min({'o': o, 'd': d}, d, 20), recursive := true) FROM pairs GROUP BY id),
       reach AS (SELECT id, max(d) AS far FROM near GROUP BY id),
       density AS (SELECT near.id, 1.0::DOUBLE / (avg(greatest(d, far)) + 1e-10) AS thick FROM near JOIN reach ON reach.id = o GROUP BY near.id),
       factor AS (SELECT near.id, -avg(around.thick) / any_value(own.thick) AS f
         FROM near JOIN density around ON around.id = o JOIN density own ON own.id = near.id GROUP BY near.id)
       SELECT id, round(f, 6) AS score, CAST(f < (SELECT quantile_cont(f, 0.05) FROM factor) AS INTEGER) AS anomaly_flag FROM factor""",
)
register(
    "anomaly_dbscan", "outliers",
    lambda df: M.flag_anomalies(df, ["val", "val2"], "dbscan", {"eps": 0.3, "min_samples": 10, "key": ["id"]}).select("id", "cluster_label", "anomaly_flag"),
)

# ---- reports --------------------------------------------------------------------------------
_T = f"WITH s AS ({_union('sparse', _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type FROM s) "
register(
    "report_imputation_options", "sparse",
    lambda df: R.imputation_options(R.profile(df)).select("column_name", "detected_type", "missing_count", "missing_percentage", "selected_method",
                                                          F.element_at("available_methods", 1).alias("first_method")),
    _T + f"""SELECT column_name, detected_type, missing AS missing_count, {_pct('missing', 'n')} AS missing_percentage,
      CASE WHEN {_pct('missing', 'n')} >= 85 THEN 'missing_indicator'
        WHEN detected_type = 'numeric' THEN CASE WHEN (SELECT abs(avg(val) - quantile_cont(val, 0.5)) / abs(quantile_cont(val, 0.5)) FROM sparse) < 0.25
          THEN 'mean_imputation' ELSE 'median_imputation' END
        WHEN detected_type = 'id_like' THEN 'missing_indicator' ELSE 'mode_imputation' END AS selected_method,
      CASE detected_type WHEN 'numeric' THEN 'mean_imputation' WHEN 'id_like' THEN 'keep_missing' ELSE 'mode_imputation' END AS first_method
      FROM d WHERE missing > 0""",
)
register(
    "report_group_columns", "customer", lambda df: R.group_columns(R.profile(df), "c_acctbal").select("column_name", "unique_count"),
    """SELECT * FROM (SELECT 'c_mktsegment' AS column_name, count(DISTINCT c_mktsegment) AS unique_count FROM customer UNION ALL
       SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer) WHERE unique_count BETWEEN 2 AND 20""",
)
register(
    "report_outliers", "outliers",
    lambda df: R.outlier_report(df, overrides=df.sparkSession.createDataFrame(
        [("val", "Currency / Amount"), ("id", "Identifier")], "column_name string, approved_type string"))
    .select("column_name", "schema_type", "lower_bound", "upper_bound", "outlier_count", "outlier_percentage", "distribution_label",
            "recommended_method", F.element_at("highest_values", 1).alias("highest")),
    FENCE.format(m=1.5) + """SELECT 'val' AS column_name, 'Currency / Amount' AS schema_type, round_even(lo, 2) AS lower_bound, round_even(hi, 2) AS upper_bound,
      count(*) FILTER (val < lo OR val > hi) AS outlier_count, round_even(count(*) FILTER (val < lo OR val > hi) * 100.0::DOUBLE / count(*), 2) AS outlier_percentage,
      CASE WHEN skewness(val) >= 1 THEN 'Right Skewed' ELSE 'Nearly Symmetric' END AS distribution_label,
      CASE WHEN skewness(val) > 1 AND min(val) > 0 THEN 'log_transform' ELSE 'other' END AS recommended_method, round_even(max(val), 2) AS highest
      FROM outliers, f GROUP BY lo, hi""",
)
# Columns of every shape the advice tells apart, made from one with outliers.
_SHAPES = {
    "val": "val", "fallen": "-val", "moved": "val - 100000.0", "floored": "greatest(val - 1000.0, 0.0)",
    "mirrored": "CASE WHEN id % 2 = 0 THEN val ELSE -val END", "thousands": "round(val / 1000.0)",
    "balanced": "round(CASE WHEN id % 2 = 0 THEN val ELSE -val END / 1000.0)",
}
_SHAPED = "WITH v AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SHAPES.items()) + " FROM outliers), s AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n, count(DISTINCT {c}) AS u, skewness({c}) AS s, kurtosis({c}) AS k, min({c}) AS lo,
        count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outside
        FROM v, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM v)""" for c in _SHAPES
) + "), p AS (SELECT *, outside * 100.0 / n AS pct FROM s WHERE outside > 0) "
_ACTION = """CASE WHEN pct < 1 AND abs(s) < 0.5 AND k < 3 THEN 'keep_review' WHEN s > 1 AND lo > 0 THEN 'log_transform'
  WHEN s > 1 AND lo >= 0 THEN 'sqrt_transform' WHEN abs(s) > 1 THEN 'yeojohnson_transform' WHEN pct > 10 AND k >= 3 THEN 'winsorization'
  ELSE 'review_extreme_values' END"""
_CASE = """CASE recommended_method WHEN 'keep_review' THEN 'keep' WHEN 'winsorization' THEN 'heavy' WHEN 'review_extreme_values' THEN 'review'
  ELSE CASE WHEN s > 0 THEN 'right' ELSE 'left' END END"""


def _shaped(df):
    return df.selectExpr(*[f"{e} AS {c}" for c, e in _SHAPES.items()])


def _checked(df):
    return df.sparkSession.createDataFrame([(c, "Currency / Amount") for c in _SHAPES], "column_name string, approved_type string")


register(
    "report_outlier_advice", "outliers",
    lambda df: R.outlier_report(_shaped(df), overrides=_checked(df)).select(
        "column_name", "recommended_method", "recommended_label", "recommended_destination", "recommendation_reason",
        F.concat_ws("|", "alternative_methods").alias("alternatives"), F.concat_ws("|", "avoid_methods").alias("avoid")),
    _SHAPED + f""", m AS (SELECT *, {_ACTION} AS recommended_method FROM p), c AS (SELECT *, {_CASE} AS kind FROM m)
      SELECT column_name, recommended_method, CASE recommended_method {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ACTION_LABELS.items())} END AS recommended_label,
      CASE kind {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in R.OUTLIER_ADVICE.items())} END AS recommended_destination,
      CASE kind {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in R.OUTLIER_ADVICE.items())} END AS recommendation_reason,
      CASE kind {' '.join(f"WHEN '{k}' THEN '{'|'.join(v[2])}'" for k, v in R.OUTLIER_ADVICE.items())} END AS alternatives,
      CASE kind {' '.join(f"WHEN '{k}' THEN '{'|'.join(v[3])}'" for k, v in R.OUTLIER_ADVICE.items())} END AS avoid FROM c""",
)
register(
    "report_outlier_methods", "outliers",
    lambda df: R.outlier_report(_shaped(df).select("thousands", "balanced"), overrides=_checked(df)).select("column_name", "detected_type", "outlier_count", "selected_method"),
    _SHAPED + """SELECT column_name, CASE WHEN u <= 20 AND u * 1.0 / n <= 0.2 THEN 'numeric_categorical' ELSE 'numeric' END AS detected_type, outside AS outlier_count,
      CASE WHEN u <= 20 AND u * 1.0 / n <= 0.2 THEN 'ignore' WHEN pct >= 30 THEN 'iqr_detection' WHEN abs(s) < 0.5 THEN 'zscore_detection'
        WHEN s IS NOT NULL THEN 'iqr_detection' WHEN k > 3 THEN 'modified_zscore_detection' ELSE 'iqr_detection' END AS selected_method
      FROM p WHERE column_name IN ('thousands', 'balanced')""",
)
register(
    "report_anomaly_method", "outliers",
    lambda df: R.anomaly_issue(R.profile(_shaped(df).select("thousands", "balanced"))).select("column_name", "issue_code", "action_code", "selected_method", "safety", "confidence"),
    _SHAPED + """SELECT 'Dataset' AS column_name, 'MULTIVARIATE_ANOMALY_CHECK_AVAILABLE' AS issue_code, 'REVIEW_DATASET_ANOMALIES' AS action_code,
      CASE WHEN max(n) > 10 * count(*) AND count(*) <= 10 THEN 'mahalanobis_distance' ELSE 'isolation_forest' END AS selected_method, 'Review' AS safety,
      CASE WHEN count(*) > 10 THEN 'High' ELSE 'Medium' END AS confidence
      FROM s WHERE column_name IN ('thousands', 'balanced') AND NOT (u <= 20 AND u * 1.0 / n <= 0.2) HAVING count(*) >= 2""",
)
register(
    "report_issues", "constants",
    lambda df: R.recommendations(df).select("column_name", "detected_type", "issue_code", "action_code", "safety", "confidence"),
    f"""WITH s AS ({_union('constants', _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type FROM s)
    SELECT column_name, CASE detected_type WHEN 'boolean' THEN 'categorical' ELSE detected_type END AS detected_type, 'MISSING_VALUES' AS issue_code, 'REVIEW_IMPUTATION' AS action_code, 'Review' AS safety, 'Medium' AS confidence
      FROM d WHERE missing > 0 UNION ALL
    SELECT column_name, detected_type, 'DATATYPE_REVIEW_REQUIRED', 'CONFIRM_COLUMN_TYPE', 'Review', 'Medium'
      FROM d WHERE detected_type IN ('id_like', 'numeric_categorical', 'review') UNION ALL
    SELECT column_name, detected_type, 'HIGH_CARDINALITY', 'REVIEW_ENCODING_OR_COLUMN_TYPE', 'Review', 'Medium' FROM d
      WHERE detected_type IN ('categorical', 'numeric_categorical', 'id_like') AND (u > 50 OR u * 1.0 / n >= 0.5) UNION ALL
    SELECT column_name, detected_type, 'CONSTANT_COLUMN', 'DROP_COLUMN_CANDIDATE', 'Safe', 'High' FROM d WHERE u = 1 UNION ALL
    SELECT 'Dataset', NULL, 'MULTIVARIATE_ANOMALY_CHECK_AVAILABLE', 'REVIEW_DATASET_ANOMALIES', 'Review',
      CASE WHEN count(*) FILTER (detected_type = 'numeric') > 10 THEN 'High' ELSE 'Medium' END FROM d HAVING count(*) FILTER (detected_type = 'numeric') >= 2 UNION ALL
    SELECT 'val', 'numeric', 'OUTLIERS_DETECTED', 'REVIEW_OUTLIER_HANDLING', 'Review', 'Medium'
      FROM constants, (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS b FROM constants)
      WHERE (SELECT count(*) FROM d WHERE column_name = 'val' AND detected_type = 'numeric') = 1 HAVING count(*) FILTER (val < a - 1.5 * (b - a) OR val > b + 1.5 * (b - a)) > 0""",
)
register(
    "report_summary", "sparse",
    lambda df: R.report_summary(df).drop("recommendations"),
    _T + """, q AS (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS z FROM sparse)
      SELECT 2 * count(*) - count(grp) - count(val) AS missing_values, count(*) - count(DISTINCT id) AS duplicate_rows, 4 AS columns,
      (SELECT count(*) FROM d WHERE detected_type IN ('id_like', 'numeric_categorical', 'review')) AS datatype_issues,
      CASE WHEN (SELECT count(*) FROM d WHERE column_name = 'val' AND detected_type = 'numeric') = 1
        THEN count(*) FILTER (val < a - 1.5 * (z - a) OR val > z + 1.5 * (z - a)) ELSE 0 END AS outliers FROM sparse, q GROUP BY a, z""",
)
register(
    "clean_apply_actions", "sparse",
    lambda df: apply_actions(df, [
        {"issue_code": "MISSING_VALUES", "column_name": "grp", "selected_method": "missing_category"},
        {"issue_code": "MISSING_VALUES", "column_name": "val", "selected_method": "group_mean_imputation", "group_column": "grp"},
        {"issue_code": "OUTLIERS_DETECTED", "column_name": "val", "selected_method": "percentile_capping"},
        {"issue_code": "SOMETHING_ELSE", "column_name": "val"},
    ])[0].select("id", "grp", F.round("val", 4).alias("val")),
    """WITH a AS (SELECT id, coalesce(grp, 'Missing') AS grp, val FROM sparse),
       b AS (SELECT id, grp, coalesce(val, avg(val) OVER (PARTITION BY grp)) AS val FROM a),
       q AS (SELECT quantile_cont(val, 0.01) AS lo, quantile_cont(val, 0.99) AS hi FROM b)
       SELECT id, grp, round(least(greatest(val, lo), hi), 4) AS val FROM b, q""",
)
register(
    "clean_action_log", "sparse",
    lambda df: _log_with_rows(df, [
        {"issue_code": "MISSING_VALUES", "column_name": "val", "selected_method": "drop_rows"},
        {"issue_code": "OUTLIERS_DETECTED", "column_name": "val", "selected_method": "log_transform"},
        {"issue_code": "OTHER", "column_name": "val"},
    ]),
    """SELECT v.*, count(val) AS rows_left FROM sparse, (VALUES (1, 'drop_rows', 'val'), (2, 'forward_to_feature_engineering', 'val'),
       (3, 'ignored_or_not_implemented', 'val')) v(step, action, column_name) GROUP BY 1, 2, 3""",
)


def _log_with_rows(df, actions):
    cleaned, log = apply_actions(df, actions)
    return log.select("step", "action", "column_name", cleaned.agg(F.count("*")).scalar().alias("rows_left"))
