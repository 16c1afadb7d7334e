"""Previews, samples, coercion and column checks."""

from pyspark.sql import functions as F

from flatwork.functions import coerce as C
from flatwork.operators import projection as P
from flatwork.operators.profile import missing_counts
from flatwork.queries.filters import NUM
from flatwork.queries.registry import register

register(
    "preview_rows",
    "orders",
    lambda df: P.preview(df, 30, ["o_orderkey", "o_orderdate", "nope"], ["o_orderkey"]),
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders ORDER BY o_orderkey LIMIT 30""",
)
register(
    "table_rows",
    "orders",
    lambda df: P.table_chart(df, ["o_orderkey", "o_totalprice"], 700, ["o_orderkey"]),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500",
)
register(
    "table_sorted",
    "orders",
    lambda df: P.table_chart(df, ["o_orderkey", "o_totalprice"], 25, ["o_totalprice", "o_orderkey"], descending=True),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25",
)
register(
    "report_safe_values",
    "sparse",
    lambda df: C.report_safe(
        df.select("id", "ts", F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("val")).alias("val"))
    ),
    """SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN id % 2 <> 0 THEN val END AS val FROM sparse""",
)
register(
    "coerce_numbers",
    "text_numbers",
    lambda df: C.with_numeric(df, ["amount_text"]).select("id", F.col("amount_text").alias("amount")),
    f"SELECT id, {NUM} AS amount FROM text_numbers",
)
register(
    "coerce_dates",
    "codes",
    lambda df: df.select("id", F.expr("right(code, 10)").alias("d"), "email").select(
        "id", F.date_format(C.temporal(F.col("d"), C.T.StringType()), "yyyy-MM-dd").alias("good"),
        C.temporal(F.col("email"), C.T.StringType()).cast("string").alias("bad"),
    ),
    "SELECT id, right(code, 10) AS good, CAST(NULL AS VARCHAR) AS bad FROM codes",
)
register(
    "drop_missing_rows",
    "sparse",
    lambda df: P.drop_missing(df, ["grp", "val"]).select("id"),
    "SELECT id FROM sparse WHERE grp IS NOT NULL AND val IS NOT NULL",
)
register(
    "sample_rows",
    "orders",
    lambda df: P.sample_rows(df, 200, ["o_orderkey"]).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY md5(concat('42', CAST(o_orderkey AS VARCHAR))) LIMIT 200",
)
register(
    "scatter_points",
    "sparse",
    lambda df: P.scatter(df, "id", "val", ["id"], color="grp", limit=300).select(F.col("id").cast("long").alias("id"), "val", "grp"),
    "SELECT id, val, grp FROM sparse WHERE val IS NOT NULL ORDER BY md5(concat('42', CAST(id AS VARCHAR))) LIMIT 300",
)
register(
    "bubble_points",
    "outliers",
    lambda df: P.scatter(df, "val", "val2", ["id"], size="id", limit=100, bubble=True).select("val", "val2"),
    "SELECT val, val2 FROM outliers ORDER BY md5(concat('42', CAST(id AS VARCHAR))) LIMIT 100",
)
register(
    "scatter_first_points",
    "sparse",
    lambda df: P.first_points(df, ["id", "val"], ["id"], 250, numeric=["val"]),
    "SELECT id, val FROM sparse WHERE val IS NOT NULL ORDER BY id LIMIT 250",
)
register(
    "masked_sample",
    "codes",
    lambda df: P.masked_sample(df, ["id"], 10),
    "SELECT id, code, '[masked]' AS email FROM codes ORDER BY id LIMIT 10",
)
_LONG = """l AS (SELECT 'grp' AS column_name, ts, id, grp AS value FROM sparse WHERE grp IS NOT NULL UNION ALL
       SELECT 'id', ts, id, CAST(id AS VARCHAR) FROM sparse)"""
for _name, _end, _way in (("first", False, ""), ("last", True, " DESC")):
    register(
        f"{_name}_values",
        "sparse",
        lambda df, end=_end: P.edge_values(df, ["grp", "id"], ["ts", "id"], 5, end),
        f"""WITH {_LONG}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY ts{_way}, id{_way}) AS INTEGER) AS rank FROM l)
        SELECT column_name, rank, value FROM r WHERE rank <= 5""",
    )
register(
    "first_distinct_values",
    "sparse",
    lambda df: P.first_distinct_values(df, ["grp", "id"], ["ts", "id"], 6),
    f"""WITH {_LONG}, d AS (SELECT column_name, value, arg_min(id, (ts, id)) AS id, min(ts) AS ts FROM l GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY ts, id) AS INTEGER) AS rank FROM d)
    SELECT column_name, rank, value FROM r WHERE rank <= 6""",
)
register(
    "random_values",
    "sparse",
    lambda df: P.random_values(df, ["grp"], ["id"], 5),
    """WITH r AS (SELECT 'grp' AS column_name, grp AS value, CAST(row_number() OVER (ORDER BY md5(concat('42', CAST(id AS VARCHAR)))) AS INTEGER) AS rank
       FROM sparse WHERE grp IS NOT NULL) SELECT column_name, rank, value FROM r WHERE rank <= 5""",
)
register(
    "schema_contract",
    "sparse",
    lambda df: P.contract_report(df, ["id", "val", "missing_feature"])
    .join(missing_counts(df), "column_name", "left")
    .select("column_name", "present", "missing_count"),
    """SELECT 'id' AS column_name, true AS present, count(*) - count(id) AS missing_count FROM sparse UNION ALL
       SELECT 'val', true, count(*) - count(val) FROM sparse UNION ALL SELECT 'missing_feature', false, NULL""",
)
register(
    "distinct_rows",
    "duplicates",
    lambda df: df.dropDuplicates(),
    "SELECT DISTINCT * FROM duplicates",
)
register(
    "repeated_columns_dropped",
    "nation",
    lambda df: P.drop_repeated_columns(df.select("n_nationkey", "n_name", df.n_regionkey.alias("n_name"))),
    "SELECT n_nationkey, n_name FROM nation",
)
