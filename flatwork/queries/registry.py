"""The query registry, the test tables, and tables derived from them that hold the edge cases.

The tables themselves hold no nulls, ties or bad text, so those are derived from whole tables by
one SELECT that reads the same in Spark and in the checking SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "sparse": (
        ("orders",),
        """SELECT o_orderkey AS id, o_orderdate AS ts,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS grp,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS val FROM orders""",
    ),
    "cleaned": (
        ("orders",),
        """SELECT o_orderkey AS id, o_orderdate AS ts,
             COALESCE(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END, 'Missing') AS grp,
             COALESCE(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END, 0.0) AS val FROM orders""",
    ),
    "text_numbers": (
        ("orders",),
        """SELECT o_orderkey AS id, o_orderpriority AS grp,
             CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' WHEN o_orderkey % 10 = 1 THEN '7d'
                  WHEN o_orderkey % 10 = 2 THEN ' 12 ' WHEN o_orderkey % 10 = 3 THEN ''
                  WHEN o_orderkey % 10 = 4 THEN '1e3' ELSE CAST(o_custkey AS STRING) END AS amount_text FROM orders""",
    ),
    "ties": (
        ("customer",),
        """SELECT c_custkey AS id, concat('g', CAST(c_custkey % 10 AS STRING)) AS grp,
             CAST(c_custkey % 5 AS DOUBLE) AS val FROM customer""",
    ),
    "constants": (
        ("part",),
        """SELECT p_partkey AS id, CAST(5.0 AS DOUBLE) AS const_col, CAST(NULL AS DOUBLE) AS null_col,
             p_partkey % 2 AS bin_col, p_retailprice AS val FROM part""",
    ),
    "duplicates": (
        ("lineitem",),
        """SELECT l_returnflag, l_linestatus,
             CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS n FROM lineitem""",
    ),
    "outliers": (
        ("orders",),
        """SELECT o_orderkey AS id,
             CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS val,
             CAST(o_custkey AS DOUBLE) AS val2 FROM orders""",
    ),
    "gaps": (
        ("events",),
        """SELECT event_id, ts, user_id, event_type,
             CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value FROM events""",
    ),
    "codes": (
        ("orders",),
        """SELECT o_orderkey AS id,
             concat('ORD_', CAST(o_orderkey AS STRING), '-', CAST(CAST(o_orderdate AS DATE) AS STRING)) AS code,
             CASE WHEN o_orderkey % 9 = 0 THEN NULL
                  ELSE concat('User.', CAST(o_custkey AS STRING), '@mail', CAST(o_custkey % 4 AS STRING), '.example.com') END AS email
           FROM orders""",
    ),
    "geo": (
        ("supplier", "nation"),
        """SELECT s_suppkey AS id, n_name AS location, CAST(n_nationkey AS DOUBLE) * 7.0 - 84.0 AS lat,
             CAST(n_nationkey AS DOUBLE) * 14.0 - 168.0 AS lon, s_acctbal AS val
           FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "target": (
        ("documents", "labels"),
        """SELECT documents.doc_id AS id, lang, source, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS target, toxic
           FROM documents JOIN labels ON documents.doc_id = labels.doc_id""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, select = DERIVED[name]
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(select)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, sf_dir, name) if name in DERIVED else table(spark, sf_dir, name)


def register(name: str, tables: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Add a query over whole tables: `build` gets one DataFrame per name in `tables`."""
    names = tables.split()
    if name in QUERIES:
        raise ValueError(f"Query '{name}' is registered twice.")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[source(spark, sf_dir, n) for n in names])

    run.source = build.__module__.rsplit(".", 1)[-1]
    QUERIES[name] = run
    if sql is not None:
        made = [f"{n} AS ({DERIVED[n][1]})" for n in names if n in DERIVED]
        sql = sql.strip()
        if made and sql[:5].upper() == "WITH ":
            sql = sql[5:].lstrip()
            ORACLES[name] = "WITH " + ", ".join(made) + ", " + sql
        else:
            ORACLES[name] = ("WITH " + ", ".join(made) + " " if made else "") + sql
