"""Profiles: statistics, types, flags, hints, scores."""

from pyspark.sql import functions as F

from flatwork.operators import profile as P
from flatwork.queries.registry import register

# Columns of the checked tables: name -> kind.
COLUMNS = {
    "sparse": {"id": "num", "ts": "time", "grp": "text", "val": "num"},
    "constants": {"id": "num", "const_col": "num", "null_col": "num", "bin_col": "num", "val": "num"},
    "outliers": {"id": "num", "val": "num", "val2": "num"},
    "customer": {"c_custkey": "num", "c_name": "text", "c_nationkey": "num", "c_acctbal": "num", "c_mktsegment": "text"},
    "events": {"event_id": "num", "ts": "time", "user_id": "num", "event_type": "text", "value": "num", "props": "text"},
    "codes": {"id": "num", "code": "text", "email": "text"},
    "text_numbers": {"id": "num", "grp": "text", "amount_text": "text"},
}


def _union(table, per_column, kinds=("num", "text", "time")):
    return " UNION ALL ".join(per_column(c, k) for c, k in COLUMNS[table].items() if k in kinds).replace("{t}", table)


def _number_stats(c, k):
    fence = f"1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
    return f"""SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
      (SELECT CAST({c} AS DOUBLE) FROM {{t}} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
      CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(max({c}) - min({c}) AS DOUBLE) AS range,
      round(stddev_samp({c}), 4) AS std, round(stddev_samp({c}) / nullif(avg({c}), 0), 6) AS cv,
      CASE WHEN max({c}) = min({c}) THEN 0.0::DOUBLE ELSE round(skewness({c}), 6) END AS skewness,
      CASE WHEN max({c}) = min({c}) THEN 0.0::DOUBLE ELSE round(kurtosis({c}), 6) END AS kurtosis,
      round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.75), 4) AS p75,
      round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
      (SELECT count(*) FROM {{t}} z, (SELECT quantile_cont({c}, 0.25) - {fence} AS lo, quantile_cont({c}, 0.75) + {fence} AS hi FROM {{t}}) b
        WHERE z.{c} < b.lo OR z.{c} > b.hi) AS outlier_count,
      count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count
      FROM {{t}} HAVING count({c}) > 0"""


def _shown_stats(df):
    rows = P.column_statistics(df).where("is_numeric and mean is not null")
    four = [F.round(a, 4).alias(b) for a, b in [
        ("mean", "mean"), ("median", "median"), ("std", "std"), ("percentile_5", "p5"), ("percentile_25", "p25"),
        ("percentile_75", "p75"), ("percentile_95", "p95"), ("iqr", "iqr"),
    ]]
    six = [F.round("coefficient_of_variation", 6).alias("cv"), F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis")]
    return rows.select("column_name", *four, *six, "mode", "min", "max", "range", "outlier_count", "zero_count", "negative_count")


for _t in ("sparse", "constants", "outliers", "customer"):
    register(f"profile_numbers_{_t}", _t, _shown_stats, _union(_t, _number_stats, ("num",)))


def _basic(c, k):
    text = {"num": f"CAST({c} AS VARCHAR)", "text": c, "time": f"CAST({c} AS VARCHAR)"}[k]
    return f"""SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS u,
      coalesce(avg(length({text})), 0) AS len, 0.0 AS dated FROM {{t}}"""


def _pct(part, whole):
    return f"coalesce(round_even({part} * 100.0::DOUBLE / nullif({whole}, 0), 2), 0)"


ID = (
    "regexp_matches(lower(column_name), '" + P.POSTAL_NAME + "') OR (regexp_matches(lower(column_name), '"
    + P.ID_NAME.replace("'", "''") + "') AND u * 1.0 / n >= 0.5) OR (len >= 8 AND u * 1.0 / n >= 0.8)"
)
TYPE_SQL = f"""CASE WHEN {ID} THEN 'id_like' WHEN kind = 'time' THEN 'datetime' WHEN kind = 'num' AND u <= 2 THEN 'boolean'
  WHEN kind = 'num' AND n < 50 AND u <= 15 THEN 'review' WHEN kind = 'num' AND u * 1.0 / n <= 0.2 AND u <= 20 THEN 'numeric_categorical'
  WHEN kind = 'num' THEN 'numeric' ELSE 'categorical' END"""

for _t in ("sparse", "constants", "customer", "events", "codes"):
    register(
        f"profile_types_{_t}",
        _t,
        lambda df: P.profile(df).select(
            "column_name", "detected_type", "role", "missing_count", "missing_percentage", "unique_count",
            F.round("unique_ratio", 8).alias("unique_ratio"), "is_constant", "is_high_cardinality",
        ),
        f"""WITH s AS ({_union(_t, _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type FROM s)
        SELECT column_name, detected_type,
          CASE WHEN detected_type = 'id_like' THEN 'identifier' WHEN detected_type = 'review' OR {_pct('missing', 'n')} >= 85 THEN 'review'
            WHEN u = 1 THEN 'exclude' WHEN regexp_matches(lower(column_name), '{P.TARGET_NAME}') THEN 'target_candidate' ELSE 'feature' END AS role,
          missing AS missing_count, {_pct('missing', 'n')} AS missing_percentage, u AS unique_count,
          round(u * 1.0::DOUBLE / n, 8) AS unique_ratio, u = 1 AS is_constant, u * 1.0 / n >= 0.5 AND u > 20 AS is_high_cardinality FROM d""",
    )
    register(
        f"upload_types_{_t}",
        _t,
        lambda df: P.upload_profile(df).select(
            "column_name", "detected_type", "missing_hint", "encoding_hint", "scaling_hint", "recommendation", "recommended_role",
            "is_id_like", "is_constant", "is_possible_target",
        ),
        f"""WITH s AS ({_union(_t, _basic)}), p AS (SELECT *, {_pct('u', 'n')} AS up, {_pct('missing', 'n')} AS mp FROM s),
        f AS (SELECT *, missing = n AS empty, missing < n AND up >= 90 AND u > 10 AND regexp_matches(lower(column_name), '{P.UPLOAD_ID_NAME}') AS ids,
          u = 2 AND up <= 50 AS bool, u = 1 AND missing < n AS const FROM p),
        d AS (SELECT *, CASE WHEN empty THEN 'empty' WHEN ids THEN 'id' WHEN bool THEN 'boolean' WHEN kind = 'time' THEN 'datetime'
          WHEN kind = 'num' AND u <= 10 AND up <= 20 THEN 'categorical_numeric' WHEN kind = 'num' THEN 'numeric'
          WHEN u > 50 AND up > 10 THEN 'high_cardinality_categorical' WHEN kind = 'text' AND u <= 50 AND up <= 50 THEN 'categorical' ELSE 'text' END AS detected_type FROM f)
        SELECT column_name, detected_type,
          CASE WHEN mp = 0 THEN 'no_missing' WHEN mp < 30 THEN 'low_missing_imputation_candidate' WHEN mp < 70 THEN 'medium_missing_imputation_review'
            WHEN mp < 85 THEN 'high_missing_keep_or_drop_review' ELSE 'extreme_missing_drop_candidate' END AS missing_hint,
          CASE detected_type WHEN 'boolean' THEN 'binary_encoding_candidate'
            WHEN 'categorical' THEN CASE WHEN u <= 10 THEN 'onehot_encoding_candidate' ELSE 'frequency_or_ordinal_encoding_review' END
            WHEN 'categorical_numeric' THEN 'ordinal_or_keep_numeric_review' WHEN 'high_cardinality_categorical' THEN 'frequency_target_hash_or_embedding_review'
            WHEN 'text' THEN 'tfidf_or_embedding_review' WHEN 'datetime' THEN 'datetime_feature_extraction_candidate' WHEN 'id' THEN 'do_not_encode_directly'
            ELSE 'not_applicable' END AS encoding_hint,
          CASE detected_type WHEN 'numeric' THEN 'scaling_candidate' WHEN 'categorical_numeric' THEN 'not_required_or_review' ELSE 'not_required' END AS scaling_hint,
          CASE WHEN empty OR const THEN 'drop_candidate' WHEN ids THEN 'review' WHEN mp >= 85 THEN 'drop_candidate'
            WHEN mp >= 70 OR (NOT ids AND NOT empty AND u > 50 AND up > 10) THEN 'review' WHEN mp > 0 THEN 'keep_with_imputation_review' ELSE 'keep' END AS recommendation,
          CASE WHEN empty OR const THEN 'review' WHEN ids THEN 'identifier' WHEN mp >= 85 THEN 'review' ELSE 'feature' END AS recommended_role,
          ids AS is_id_like, const AS is_constant, missing < n AND NOT ids AND NOT const AND u >= 2 AND up <= 50 AS is_possible_target FROM d""",
    )


def _summary_sql(table):
    columns = COLUMNS[table]
    listed = ", ".join(columns)
    missing = " + ".join(f"count(*) - count({c})" for c in columns)
    return f"""WITH m AS (SELECT count(*) AS row_count, {missing} AS total_missing_cells FROM {table}),
      d AS (SELECT m.*, m.row_count - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {table})) AS duplicate_row_count FROM m),
      p AS (SELECT *, {_pct('total_missing_cells', f'(row_count * {len(columns)})')} AS total_missing_percentage FROM d)
      SELECT row_count, duplicate_row_count, {len(columns)} AS column_count, total_missing_cells, total_missing_percentage,
        round_even(greatest(0, 100 - total_missing_percentage - {_pct('duplicate_row_count', 'row_count')}), 2) AS quality_score FROM p"""


COLUMNS["duplicates"] = {"l_returnflag": "text", "l_linestatus": "text", "n": "num"}
for _t in ("sparse", "duplicates", "constants"):
    register(f"profile_summary_{_t}", _t, P.summary, _summary_sql(_t))
register(
    "upload_quality_score",
    "constants",
    lambda df: P.upload_summary(df).select("row_count", "total_missing_percentage", "quality_score"),
    # one empty column of five: 20 % missing (-5), one constant column (-5), one crowded column (-3), one identifier (-2)
    """SELECT count(*) AS row_count, 20.0::DOUBLE AS total_missing_percentage,
       CAST(100 - 5 - CASE WHEN count(DISTINCT const_col) = 1 THEN 5 ELSE 0 END
         - CASE WHEN count(DISTINCT val) > 50 AND count(DISTINCT val) * 10 > count(*) THEN 3 ELSE 0 END
         - CASE WHEN count(DISTINCT id) = count(*) THEN 2 ELSE 0 END AS INTEGER) AS quality_score FROM constants""",
)
register(
    "missing_report",
    "sparse",
    P.missing_report,
    "SELECT * FROM ("
    + _union("sparse", lambda c, k: f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS missing_count, "
             f"{_pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_percentage FROM {{t}}")
    + ")",
)
register(
    "duplicate_rows",
    "duplicates",
    P.duplicate_rows,
    """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, n FROM duplicates)) AS duplicate_row_count
       FROM duplicates""",
)
register(
    "duplicates_removed",
    "duplicates",
    P.remove_duplicates,
    "SELECT DISTINCT l_returnflag, l_linestatus, n FROM duplicates",
)
register(
    "profile_categories",
    "customer",
    lambda df: P.profile(df).where("top_value is not null").select("column_name", "top_value", "top_frequency"),
    """SELECT 'c_mktsegment' AS column_name, c_mktsegment AS top_value, count(*) AS top_frequency FROM customer GROUP BY 2
       QUALIFY row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) = 1""",
)
register(
    "profile_buckets",
    "events",
    lambda df: P.buckets(P.profile(df)).select("detected_type", F.concat_ws(",", "columns").alias("columns")),
    f"""WITH s AS ({_union('events', _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type, row_number() OVER () AS at FROM s)
    SELECT detected_type, string_agg(column_name, ',' ORDER BY list_position(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'], column_name)) AS columns
    FROM d GROUP BY 1""",
)
register(
    "semantic_schema",
    "orders",
    lambda df: P.semantic_schema(df, ["o_orderkey"]).select("column_name", "raw_type", "raw_confidence", "semantic_type", "advice", "confidence"),
    """WITH u AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_custkey) AS c,
         count(DISTINCT o_totalprice) = count(*) AS every FROM orders)
       SELECT column_name, raw_type, CAST(rc AS DOUBLE) AS raw_confidence, semantic_type, advice, confidence FROM (
       SELECT 'o_orderkey' AS column_name, 'identifier' AS raw_type, 0.98 AS rc, 'Identifier' AS semantic_type, 'ignore_for_ml' AS advice, 98 AS confidence UNION ALL
       SELECT 'o_custkey', 'integer', 0.86, 'Continuous Numeric', 'keep_numeric_scale_if_needed', 90 FROM u WHERE c > 20 UNION ALL
       SELECT 'o_orderstatus', 'string', 0.75, 'Categorical', 'onehot_encode', 90 FROM u WHERE s BETWEEN 3 AND 10 UNION ALL
       SELECT 'o_totalprice', 'currency', 0.92, CASE WHEN every THEN 'Identifier' ELSE 'Currency / Amount' END,
         CASE WHEN every THEN 'ignore_for_ml' ELSE 'numeric_scale_review' END, CASE WHEN every THEN 98 ELSE 92 END FROM u UNION ALL
       SELECT 'o_orderdate', 'date', 0.95, 'Datetime', 'extract_datetime_features', 94 UNION ALL
       SELECT 'o_orderpriority', 'string', 0.75, 'Categorical', 'onehot_encode', 90 FROM u WHERE p BETWEEN 3 AND 10)""",
)
register(
    "approved_types",
    "sparse",
    lambda df: P.with_approved(
        P.profile(df), df.sparkSession.createDataFrame([("val", "Year")], "column_name string, approved_type string")
    ).select("column_name", "effective_type"),
    f"""WITH s AS ({_union('sparse', _basic)})
    SELECT column_name, CASE WHEN column_name = 'val' THEN 'Year' ELSE {TYPE_SQL} END AS effective_type FROM s""",
)
register(
    "recommended_graphs",
    "outliers",
    lambda df: P.recommended_graphs(P.profile(df)),
    f"""WITH s AS ({_union('outliers', _basic)}), d AS (SELECT column_name AS c FROM s WHERE {TYPE_SQL} = 'numeric')
    SELECT 'histogram' AS chart_type, c AS x_column, NULL AS y_column, 'high' AS priority FROM d UNION ALL SELECT 'boxplot', NULL, c, 'high' FROM d
    UNION ALL SELECT 'qq_plot', c, NULL, 'medium' FROM d UNION ALL SELECT 'skewness_kurtosis_table', NULL, NULL, 'medium' FROM d HAVING count(*) > 0
    UNION ALL SELECT 'correlation_heatmap', NULL, NULL, 'high' FROM d HAVING count(*) > 1""",
)
register(
    "recommended_charts",
    "geo",
    lambda df: P.recommend_charts(df, ["location", "lat", "lon", "val", "not there"]),
    """WITH f AS (SELECT (count(TRY_CAST(location AS DOUBLE)) = 0)::INT + (count(lat) = 0)::INT + (count(lon) = 0)::INT + (count(val) = 0)::INT AS categories,
         (count(TRY_CAST(location AS DOUBLE)) > 0)::INT + (count(lat) > 0)::INT + (count(lon) > 0)::INT + (count(val) > 0)::INT AS numbers,
         (coalesce(avg((TRY_CAST(location AS TIMESTAMP) IS NOT NULL)::INT), 0) > 0.5)::INT AS times FROM geo)
       SELECT chart, CAST(rank AS INTEGER) AS rank FROM f, (VALUES (0, 'bar', 1, 1, 0), (1, 'horizontal_bar', 1, 1, 0), (2, 'pie', 1, 1, 0), (3, 'donut', 1, 1, 0),
         (4, 'grouped_bar', 2, 1, 0), (5, 'stacked_bar', 2, 1, 0), (6, 'heatmap', 2, 1, 0), (7, 'line', 0, 1, 1), (8, 'area', 0, 1, 1),
         (9, 'scatter', 0, 2, 0), (10, 'bubble', 0, 2, 0), (11, 'correlation_heatmap', 0, 2, 0), (15, 'symbol_map', 0, 0, 0), (16, 'bubble_map', 0, 0, 0),
         (17, 'density_map', 0, 0, 0), (18, 'table', 1, 0, 0)) v(rank, chart, c, n, t) WHERE categories >= c AND numbers >= n AND times >= t""",
)
register(
    "profile_advice",
    "customer",
    lambda df: P.profile(df).select("column_name", "detected_type", "role", "recommendation"),
    f"""WITH s AS ({_union('customer', _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type, missing * 100.0 / n AS lost FROM s)
    SELECT column_name, detected_type, CASE WHEN detected_type = 'id_like' THEN 'identifier' WHEN detected_type = 'review' OR lost >= 85 THEN 'review'
        WHEN u = 1 THEN 'exclude' WHEN regexp_matches(lower(column_name), '{P.TARGET_NAME}') THEN 'target_candidate' ELSE 'feature' END AS role,
      CASE {' '.join(f"WHEN detected_type = '{k}' THEN '{P.ADVICE_BY_TYPE[k]}'" for k in P.ADVICE_FIRST)} WHEN u = 1 THEN '{P.ADVICE_CONSTANT}'
        {' '.join(f"WHEN lost >= {least} THEN '{text}'" for least, text in P.ADVICE_MISSING)}
        {' '.join(f"WHEN detected_type = '{k}' THEN '{v}'" for k, v in P.ADVICE_BY_TYPE.items())} ELSE '{P.ADVICE_OTHER}' END AS recommendation FROM d""",
)
register(
    "eda_summary",
    "sparse",
    lambda df: P.eda_summary(df, P.profile(df)),
    f"""WITH s AS ({_union('sparse', _basic)}), d AS (SELECT *, {TYPE_SQL} AS detected_type FROM s), b AS ({_summary_sql('sparse').replace('WITH m AS', 'WITH m AS', 1)}),
    q AS (SELECT quantile_cont(val, 0.25) AS a, quantile_cont(val, 0.75) AS z FROM sparse),
    o AS (SELECT count(*) AS outliers FROM sparse, q WHERE val < a - 1.5 * (z - a) OR val > z + 1.5 * (z - a))
    SELECT b.*, CASE WHEN (SELECT count(*) FROM d WHERE column_name = 'val' AND detected_type = 'numeric') = 1 THEN o.outliers ELSE 0 END AS outliers,
      (SELECT count(*) FROM d WHERE detected_type IN ('id_like', 'numeric_categorical', 'review')) AS datatype_issues,
      (SELECT count(*) FROM d) AS recommendations, (SELECT count(*) FROM d WHERE detected_type = 'text') AS text_columns,
      (SELECT 3 * count(*) FILTER (detected_type = 'numeric') + count(*) FILTER (detected_type IN ('categorical', 'numeric_categorical', 'boolean'))
         + count(*) FILTER (detected_type = 'numeric') * count(*) FILTER (detected_type = 'datetime') + (sum(missing) > 0)::INT
         + (count(*) FILTER (detected_type = 'numeric') > 1)::INT + (count(*) FILTER (detected_type = 'numeric') > 0)::INT FROM d) AS recommended_graphs,
      (SELECT count(*) FROM d WHERE detected_type = 'numeric') AS numeric_columns,
      (SELECT count(*) FROM d WHERE detected_type IN ('categorical', 'numeric_categorical')) AS categorical_columns,
      (SELECT count(*) FROM d WHERE detected_type = 'datetime') AS datetime_columns,
      (SELECT count(*) FROM d WHERE detected_type = 'id_like') AS id_like_columns FROM b, o""",
)
register(
    "column_evidence",
    "sparse",
    lambda df: P.column_evidence(df, ["grp", "val"], ["id"]).select(
        "column_name", "missing_count", "unique_count", F.round("mean", 4).alias("mean"), F.array_join("samples", "|").alias("samples")
    ),
    """SELECT 'grp' AS column_name, count(*) - count(grp) AS missing_count, count(DISTINCT grp) AS unique_count, CAST(NULL AS DOUBLE) AS mean,
       (SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT grp AS v, min(id) AS i FROM sparse WHERE grp IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 5)) AS samples FROM sparse UNION ALL
       SELECT 'val', count(*) - count(val), count(DISTINCT val), round(avg(val), 4),
       (SELECT string_agg(CAST(v AS VARCHAR), '|' ORDER BY i) FROM (SELECT val AS v, min(id) AS i FROM sparse WHERE val IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 5)) FROM sparse""",
)
