"""Stored versions: written to the shared checkpoint folder, then resolved and read."""

import uuid

from pyspark.sql import functions as F

from flatwork.queries.registry import register
from flatwork.sources import versions as V
from flatwork.sources.checkpoints import checkpoint_dir


def _base(df):
    return f"{checkpoint_dir(df.sparkSession)}/versions-{uuid.uuid4().hex}"


def _history(df):
    """original -> cleaned -> feature -> rollback to the cleaned one."""
    spark, base = df.sparkSession, _base(df)
    V.save_version(df, base, V.ORIGINAL)
    V.clean_and_save(spark, base, [{"issue_code": "MISSING_VALUES", "column_name": "val", "selected_method": "fill_zero"}])
    V.save_feature(spark, base, "grp", "grp_head", {"operation": "extract_first_character"})
    V.rollback(spark, base, 2)
    return spark, base


def _manifest(df):
    spark, base = _history(df)
    return V.manifest(spark, base).select("version", "version_type", "parent", "is_active", "row_count", "column_count")


def _load(name, *columns):
    def build(df):
        spark, base = _history(df)
        return V.load(V.resolve(spark, base, name)).select(*columns)

    return build


def _preferred(df):
    spark, base = _history(df)
    V.promote(spark, base, 3)
    return V.preferred(spark, base).select("version", "version_type", "row_count")


def _pair(df):
    from flatwork.operators.compare import missing_comparison

    spark, base = _history(df)
    return missing_comparison(*V.load_pair(spark, base, "raw", "cleaned")).select("column_name", "missing_count_before", "missing_count_after")


def _ingest(df):
    base = _base(df)
    return V.ingest(df, base).select("column_name", "detected_type", "missing_count", "unique_count")


def _types(df):
    spark, base = df.sparkSession, _base(df)
    for c, t in (("val", "Year"), ("val", "Currency / Amount"), ("id", "Identifier")):
        V.approve_type(spark, base, c, t)
    from flatwork.operators.profile import profile, with_approved

    return with_approved(profile(df), V.approved_types(spark, base)).select("column_name", "approved_type")


register(
    "versions_manifest", "sparse", _manifest,
    """SELECT version, version_type, parent, is_active, (SELECT count(*) FROM sparse) AS row_count, column_count FROM (VALUES
       (1, 'original', NULL, true, 4), (2, 'cleaned', 1, true, 4), (3, 'feature_engineered', 2, true, 5), (4, 'cleaned', 2, true, 4))
       v(version, version_type, parent, is_active, column_count)""",
)
register("versions_cleaned", "sparse", _load("cleaned", "id", "val"), "SELECT id, coalesce(val, 0) AS val FROM sparse")
register("versions_engineered", "sparse", _load("engineered", "id", "grp_head"), "SELECT id, left(grp, 1) AS grp_head FROM sparse")
register("versions_raw", "sparse", _load("raw", "id", "val"), "SELECT id, val FROM sparse")
register("versions_preferred", "sparse", _preferred, "SELECT 3 AS version, 'ml_ready' AS version_type, count(*) AS row_count FROM sparse")
register(
    "versions_compared", "sparse", _pair,
    """SELECT 'id' AS column_name, 0 * count(*) AS missing_count_before, 0 * count(*) AS missing_count_after FROM sparse UNION ALL
       SELECT 'ts', 0, 0 UNION ALL SELECT 'grp', count(*) - count(grp), count(*) - count(grp) FROM sparse UNION ALL
       SELECT 'val', count(*) - count(val), 0 FROM sparse""",
)
register(
    "ingest_profile", "customer", _ingest,
    """SELECT 'c_custkey' AS column_name, 'numeric' AS detected_type, 0 AS missing_count, count(DISTINCT c_custkey) AS unique_count FROM customer UNION ALL
       SELECT 'c_name', 'high_cardinality_categorical', 0, count(DISTINCT c_name) FROM customer UNION ALL
       SELECT 'c_nationkey', 'numeric', 0, count(DISTINCT c_nationkey) FROM customer UNION ALL
       SELECT 'c_acctbal', 'numeric', 0, count(DISTINCT c_acctbal) FROM customer UNION ALL
       SELECT 'c_mktsegment', 'categorical', 0, count(DISTINCT c_mktsegment) FROM customer""",
)
register(
    "versions_approved_types", "sparse", _types,
    "SELECT c AS column_name, CASE c WHEN 'val' THEN 'Currency / Amount' WHEN 'id' THEN 'Identifier' END AS approved_type FROM (VALUES ('id'), ('ts'), ('grp'), ('val')) v(c)",
)
def _deactivated(df):
    spark, base = _history(df)
    V._change(spark, base, 4, is_active=False)
    return V.load(V.resolve(spark, base, "latest")).select("id", "grp_head")


register("versions_latest", "sparse", _load("latest", "id", "val"), "SELECT id, coalesce(val, 0) AS val FROM sparse")
register("versions_transformed", "sparse", _load("transformed", "id", "val"), "SELECT id, coalesce(val, 0) AS val FROM sparse")
register("versions_unknown_name", "sparse", _load("no such kind", "id", "val"), "SELECT id, coalesce(val, 0) AS val FROM sparse")
register("versions_inactive", "sparse", _deactivated, "SELECT id, left(grp, 1) AS grp_head FROM sparse")
register(
    "csv_quoted_breaks", "orders",
    lambda df: _csv(df.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", x')).alias("note"))),
    """SELECT o_orderkey AS id, o_orderpriority || chr(10) || '"' || o_orderstatus || '", x' AS note FROM orders""",
)
register(
    "csv_roundtrip", "text_numbers",
    lambda df: _csv(df).select("id", F.col("amount_text").alias("amount")),
    "SELECT id, CASE WHEN amount_text NOT IN ('n/a', '') THEN amount_text END AS amount FROM text_numbers",
)


def _csv(df):
    from flatwork.sources.readers import read_table

    path = f"{_base(df)}.csv"
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_table(df.sparkSession, path)
