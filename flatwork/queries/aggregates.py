"""Grouped measures, ranking, matrices, maps, figures."""

from pyspark.sql import functions as F

from flatwork.operators import aggregate as A
from flatwork.operators import projection as P
from flatwork.operators.filters import apply_filters
from flatwork.operators.ordered import first_value, last_value
from flatwork.operators.quantiles import modes, quantiles
from flatwork.queries.filters import NUM
from flatwork.queries.registry import register


def _bar(df):
    kept = apply_filters(df, [{"column": "l_quantity", "operator": ">", "value": 10}])
    chart = A.grouped_chart(kept, "l_returnflag", [("l_extendedprice", "sum")], top=5)
    return chart.select("l_returnflag", F.round("l_extendedprice", 2).alias("total"))


register(
    "chart_bar",
    "lineitem",
    _bar,
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 10
       GROUP BY l_returnflag ORDER BY sum(l_extendedprice) DESC, l_returnflag LIMIT 5""",
)

for _how, _sql in {
    "sum": "round(sum(l_extendedprice), 2)",
    "mean": "round(avg(l_extendedprice), 4)",
    "median": "round(quantile_cont(l_extendedprice, 0.5), 4)",
    "std": "round(stddev_samp(l_extendedprice), 4)",
    "var": "round(var_samp(l_extendedprice), 0)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
    "count": "count(*)",
    "nunique": "count(DISTINCT l_extendedprice)",
}.items():
    _digits = {"sum": 2, "var": 0}.get(_how, 4)

    def _one(df, how=_how, digits=_digits):
        value = F.col("l_extendedprice")
        value = F.round(value, digits) if how in ("sum", "mean", "median", "std", "var") else value
        return A.grouped_chart(df, "l_returnflag", [("l_extendedprice", how)], color="l_linestatus").select(
            "l_returnflag", "l_linestatus", value.alias("value")
        )

    register(
        f"group_{_how}",
        "lineitem",
        _one,
        f"SELECT l_returnflag, l_linestatus, {_sql} AS value FROM lineitem GROUP BY 1, 2",
    )

register(
    "group_first_last",
    "gaps",
    lambda df: df.groupBy("event_type").agg(
        first_value("value", ["ts"]).alias("first_value"), last_value("value", ["ts"]).alias("last_value")
    ),
    """SELECT event_type, arg_min(value, ts) FILTER (value IS NOT NULL) AS first_value,
       arg_max(value, ts) FILTER (value IS NOT NULL) AS last_value FROM gaps GROUP BY 1""",
)
register(
    "group_first_last_chart",
    "gaps",
    lambda df: A.aggregate(
        df, ["user_id"], [("value", "first", "opening"), ("value", "last", "closing"), ("value", "median", "middle")], ["ts"]
    ).select("user_id", "opening", "closing", F.round("middle", 6).alias("middle")),
    """SELECT user_id, arg_min(value, ts) FILTER (value IS NOT NULL) AS opening,
       arg_max(value, ts) FILTER (value IS NOT NULL) AS closing, round(quantile_cont(value, 0.5), 6) AS middle
       FROM gaps GROUP BY 1""",
)
register(
    "chart_multi_series",
    "sparse",
    lambda df: A.grouped_chart(
        df, "grp", [("val", "mean"), ("id", "nunique"), ("ts", "count")], sort_by="id", sort_order="ascending"
    ).select("grp", F.round("val", 4).alias("val"), "id", "ts"),
    """SELECT grp, round(avg(val), 4) AS val, count(DISTINCT id) AS id, count(*) AS ts FROM sparse
       WHERE grp IS NOT NULL GROUP BY 1""",
)
register(
    "chart_color_null_group",
    "sparse",
    lambda df: A.grouped_chart(df.withColumn("year", F.year("ts")), "year", [("val", "sum")], color="grp").select(
        "year", "grp", F.round("val", 2).alias("val")
    ),
    """SELECT CAST(year(ts) AS INTEGER) AS year, grp, round(sum(val), 2) AS val FROM sparse GROUP BY 1, 2
       HAVING count(val) > 0""",
)
register(
    "chart_rank_by_hidden_measure",
    "lineitem",
    lambda df: A.grouped_chart(
        df, "l_suppkey", [("l_quantity", "sum")], color="l_returnflag", top=5, sort_by="l_extendedprice"
    ).select("l_suppkey", "l_returnflag", F.round("l_quantity", 2).alias("quantity")),
    """WITH best AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY round(sum(l_extendedprice), 2) DESC, 1 LIMIT 5)
       SELECT l_suppkey, l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem
       WHERE l_suppkey IN (SELECT l_suppkey FROM best) GROUP BY 1, 2""",
)
register(
    "chart_row_count",
    "orders",
    lambda df: A.grouped_chart(df, "o_orderpriority", [], sort_order="ascending"),
    "SELECT o_orderpriority, count(*) AS row_count FROM orders GROUP BY 1",
)
register(
    "chart_text_measure_counts_rows",
    "orders",
    lambda df: A.grouped_chart(df, "o_orderstatus", [("o_orderpriority", "sum")]),
    "SELECT o_orderstatus, CAST(count(o_orderpriority) AS DOUBLE) AS o_orderpriority FROM orders GROUP BY 1",
)
register(
    "chart_text_numbers_sum",
    "text_numbers",
    lambda df: A.grouped_chart(df, "grp", [("amount_text", "sum")]).select("grp", F.round("amount_text", 2).alias("total")),
    f"SELECT grp, round(sum({NUM}), 2) AS total FROM text_numbers GROUP BY 1 HAVING count({NUM}) > 0",
)
register(
    "chart_ties",
    "ties",
    lambda df: A.grouped_chart(df, "grp", [("val", "sum")], top=3),
    "SELECT grp, sum(val) AS val FROM ties GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
register(
    "chart_bottom_n",
    "lineitem",
    lambda df: A.grouped_chart(df, "l_suppkey", [("l_quantity", "sum")], top=7, sort_order="ascending"),
    "SELECT l_suppkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 7",
)
register(
    "chart_pie_other",
    "customer",
    lambda df: A.grouped_chart(df, "c_nationkey", [("c_custkey", "count")], top=6, chart="pie"),
    """WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, count(*) AS c_custkey FROM customer GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY c_custkey DESC, c_nationkey) AS rn FROM g)
       SELECT CASE WHEN rn <= 6 THEN c_nationkey ELSE 'Other' END AS c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS c_custkey
       FROM r GROUP BY 1""",
)
register(
    "chart_pie_share",
    "part",
    lambda df: A.with_share(A.grouped_chart(df, "p_brand", [("p_size", "sum")], top=5, chart="pie"), "p_size").select(
        "p_brand", "p_size", F.round("percentage", 6).alias("percentage")
    ),
    """WITH g AS (SELECT p_brand, CAST(sum(p_size) AS DOUBLE) AS s FROM part GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY s DESC, p_brand) AS rn FROM g),
       o AS (SELECT CASE WHEN rn <= 5 THEN p_brand ELSE 'Other' END AS p_brand, sum(s) AS p_size FROM r GROUP BY 1)
       SELECT p_brand, p_size, round(p_size * 100.0 / sum(p_size) OVER (), 6) AS percentage FROM o""",
)
for _grain, _sql in {
    "day": "strftime(o_orderdate, '%Y-%m-%d')",
    "month": "strftime(o_orderdate, '%Y-%m')",
    "quarter": "concat(year(o_orderdate), 'Q', quarter(o_orderdate))",
    "year": "strftime(o_orderdate, '%Y')",
}.items():
    register(
        f"chart_line_{_grain}",
        "orders",
        lambda df, grain=_grain: A.period_chart(df, "o_orderdate", [("o_totalprice", "sum")], grain).select(
            "period", F.round("o_totalprice", 2).alias("total")
        ),
        f"SELECT {_sql} AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    )
register(
    "chart_combo_right_axis",
    "orders",
    lambda df: A.period_chart(df, "o_orderdate", [("o_totalprice", "mean"), ("o_custkey", "nunique")], "year", chart="combo")
    .select("period", F.round("o_totalprice", 4).alias("o_totalprice"), "o_custkey"),
    """SELECT strftime(o_orderdate, '%Y') AS period, round(avg(o_totalprice), 4) AS o_totalprice,
       count(DISTINCT o_custkey) AS o_custkey FROM orders GROUP BY 1""",
)
for _how, _sql in {
    "sum": "sum(val)", "mean": "avg(val)", "median": "quantile_cont(val, 0.5)", "std": "stddev_samp(val)",
    "count": "CAST(count(val) AS DOUBLE)", "nunique": "CAST(count(DISTINCT val) AS DOUBLE)", "min": "min(val)", "max": "max(val)",
}.items():
    register(
        f"kpi_{_how}",
        "sparse",
        lambda df, how=_how: A.kpi(df, "val", how).select("metric", F.round(F.col("value").cast("double"), 2).alias("value")),
        f"SELECT '{_how.title()} of val' AS metric, round({_sql}, 2) AS value FROM sparse",
    )
register(
    "kpi_last",
    "gaps",
    lambda df: A.kpi(df, "value", "last", order_by=["ts"]),
    "SELECT 'Last of value' AS metric, arg_max(value, ts) FILTER (value IS NOT NULL) AS value FROM gaps",
)
register(
    "heatmap_long",
    "lineitem",
    lambda df: A.heatmap(df, "l_suppkey", "l_returnflag", "l_quantity", "sum").select(
        "l_suppkey", "l_returnflag", F.round("value", 2).alias("value")
    ),
    """WITH x AS (SELECT DISTINCT l_suppkey FROM lineitem), g AS (SELECT DISTINCT l_returnflag FROM lineitem)
       SELECT x.l_suppkey, g.l_returnflag, round(coalesce(sum(l_quantity), 0), 2) AS value FROM x CROSS JOIN g
       LEFT JOIN lineitem l ON l.l_suppkey = x.l_suppkey AND l.l_returnflag = g.l_returnflag GROUP BY 1, 2""",
)
register(
    "heatmap_counts_sparse",
    "gaps",
    lambda df: A.heatmap(df, "user_id", "event_type", "value", "count"),
    """WITH x AS (SELECT DISTINCT user_id FROM gaps), g AS (SELECT DISTINCT event_type FROM gaps)
       SELECT x.user_id, g.event_type, count(value) AS value FROM x CROSS JOIN g
       LEFT JOIN gaps l ON l.user_id = x.user_id AND l.event_type = g.event_type GROUP BY 1, 2""",
)
register(
    "pivot_table",
    "lineitem",
    lambda df: A.pivot_table(df, "l_linenumber", "l_returnflag", "l_extendedprice", "mean").select(
        "l_linenumber", *[F.round(c, 4).alias(f"flag_{c}") for c in "ANR"]
    ),
    """SELECT l_linenumber, """
    + ", ".join(f"round(coalesce(avg(l_extendedprice) FILTER (l_returnflag = '{c}'), 0), 4) AS flag_{c}" for c in "ANR")
    + " FROM lineitem GROUP BY 1",
)
register(
    "pivot_row_totals",
    "lineitem",
    lambda df: A.totals_matrix(df, "l_suppkey", "l_returnflag", "l_quantity", "sum", top=10).select(
        "l_suppkey", F.col("A").alias("flag_A"), F.col("N").alias("flag_N"), F.col("R").alias("flag_R"), "total"
    ),
    """SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS "flag_A",
       coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS "flag_N",
       coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS "flag_R", sum(l_quantity) AS total
       FROM lineitem GROUP BY 1 ORDER BY total DESC, 1 LIMIT 10""",
)
register(
    "map_location",
    "geo",
    lambda df: A.location_map(df, "location", "val", "sum", limit=10).select("location", F.round("value", 2).alias("value")),
    "SELECT location, round(sum(val), 2) AS value FROM geo GROUP BY 1 ORDER BY sum(val) DESC, 1 LIMIT 10",
)
register(
    "map_location_text_value",
    "geo",
    lambda df: A.location_map(df, "location", "location", "sum"),
    "SELECT location, CAST(count(*) AS DOUBLE) AS value FROM geo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500",
)
register(
    "map_coordinates",
    "geo",
    lambda df: P.scatter(df, "lat", "lon", ["id"], size="val", color="location", limit=60, maximum=2000),
    """SELECT lat, lon, val, location FROM geo ORDER BY md5(concat('42', CAST(id AS VARCHAR))), id LIMIT 60""",
)
register(
    "map_points_first",
    "geo",
    lambda df: P.first_points(df, ["lat", "lon", "val"], ["id"], limit=5000, numeric=["lat", "lon", "val"]),
    "SELECT lat, lon, val FROM geo ORDER BY id LIMIT 5000",
)
register(
    "map_flow",
    "geo",
    lambda df: P.first_points(
        df.withColumns({"target_lat": -F.col("lat"), "target_lon": -F.col("lon")}),
        ["lat", "lon", "target_lat", "target_lon", "val"],
        ["id"],
        numeric=["lat", "lon", "target_lat", "target_lon", "val"],
    ),
    "SELECT lat, lon, -lat AS target_lat, -lon AS target_lon, val FROM geo ORDER BY id LIMIT 1000",
)
register(
    "top_per_group",
    "orders",
    lambda df: A.top_per_group(df, "o_orderpriority", "o_totalprice", 10, ["o_orderkey"]).select(
        "o_orderpriority", "o_orderkey", "o_totalprice"
    ),
    """SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10""",
)
register(
    "sort_numeric_text",
    "text_numbers",
    lambda df: A.sort_table(df, "amount_text", ["id"], "low to high").select("id", "amount_text"),
    f"SELECT id, amount_text FROM text_numbers ORDER BY {NUM} NULLS LAST, amount_text, id",
)
register(
    "group_median_null_group",
    "sparse",
    lambda df: A.aggregate(df.withColumn("g", F.col("id") % 7), ["g"], [("val", "median", "m"), ("id", "sum", "s")]).select("g", F.round("m", 4).alias("m"), "s"),
    "SELECT id % 7 AS g, round(quantile_cont(val, 0.5), 4) AS m, CAST(sum(id) AS DOUBLE) AS s FROM sparse GROUP BY 1",
)
register(
    "chart_measure_without_numbers",
    "orders",
    lambda df: A.grouped_chart(df, "o_orderstatus", [("o_orderdate", "sum")]),
    "SELECT o_orderstatus, CAST(count(o_orderdate) AS DOUBLE) AS o_orderdate FROM orders GROUP BY 1",
)
register(
    "limit_clamped",
    "orders",
    lambda df: A.limit_rows(df, 5000, 20, 1000, ["o_orderkey"]).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000",
)
register(
    "top_frequencies",
    "orders",
    lambda df: A.top_frequencies(df, ["o_orderstatus", "o_orderpriority", "o_custkey"], 5),
    """WITH l AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL
       SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL
       SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
       c AS (SELECT column_name, value, count(*) AS n FROM l GROUP BY 1, 2),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank FROM c)
       SELECT column_name, rank, value, n FROM r WHERE rank <= 5""",
)
register(
    "extreme_values",
    "outliers",
    lambda df: A.extreme_values(df, "val", 5),
    """SELECT * FROM (SELECT 'lowest' AS side, val AS value FROM outliers ORDER BY val LIMIT 5) UNION ALL
       SELECT * FROM (SELECT 'highest' AS side, val AS value FROM outliers ORDER BY val DESC LIMIT 5)""",
)
register(
    "chart_insight",
    "orders",
    lambda df: A.insight(
        A.grouped_chart(df, "o_orderpriority", [("o_totalprice", "max")]), "o_orderpriority", "o_totalprice"
    ),
    """WITH g AS (SELECT o_orderpriority AS c, max(o_totalprice) AS v FROM orders GROUP BY 1)
       SELECT count(*) AS rows_analyzed, arg_max(c, v) AS top_category, max(v) AS top_value,
       arg_min(c, v) AS low_category, min(v) AS low_value FROM g""",
)
register(
    "bucket_dominance",
    "lineitem",
    lambda df: A.dominance(A.grouped_chart(df, "l_returnflag", []), "l_returnflag", "row_count"),
    """WITH g AS (SELECT l_returnflag AS b, count(*) AS n FROM lineitem GROUP BY 1),
       w AS (SELECT b, n, n * 100.0 / sum(n) OVER () AS share, lead(n) OVER (ORDER BY n DESC, b) AS second FROM g)
       SELECT b AS top_bucket, n AS top_count, round(share, 1) AS share, round(n * 1.0 / second, 1) AS ratio_to_second,
       share >= 30 AS dominates FROM w ORDER BY n DESC, b LIMIT 1""",
)
register(
    "quantiles_by_group",
    "lineitem",
    lambda df: _quantile_table(quantiles(df, ["l_extendedprice"], [0.05, 0.5, 0.95], ["l_returnflag"])),
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
       FROM lineitem GROUP BY 1""",
)
register(
    "quantiles_by_group_banded",
    "lineitem",
    lambda df: _quantile_table(quantiles(df, ["l_extendedprice"], [0.05, 0.5, 0.95], ["l_returnflag"], limit=1000)),
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
       FROM lineitem GROUP BY 1""",
)
register(
    "mode_by_group",
    "lineitem",
    lambda df: modes(df, "l_quantity", ["l_returnflag"]),
    """WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT l_returnflag, l_quantity AS mode, n AS mode_count FROM c
       QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) = 1""",
)


def _quantile_table(df):
    q = F.col("q_l_extendedprice")
    return df.select(
        "l_returnflag", *[F.round(F.get(q, F.lit(i)), 4).alias(n) for i, n in enumerate(["p05", "p50", "p95"])]
    )
