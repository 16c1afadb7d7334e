"""Immutable table versions with lineage.

Each version is a Parquet folder that is never rewritten. What is known about it is a log of small
records; the newest record of a version counts, so activating, promoting and rolling back only append.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flatwork.operators.cleaning.apply import apply_actions
from flatwork.operators.features import apply_rule
from flatwork.operators.profile import upload_profile
from flatwork.operators.projection import preview

ORIGINAL, CLEANED, ENGINEERED, READY = "original", "cleaned", "feature_engineered", "ml_ready"
PRIORITY = {READY: 4, ENGINEERED: 3, CLEANED: 2, ORIGINAL: 1}
# Other names for a kind of version; none means any kind.
ALIASES = {
    "raw": ORIGINAL, "original": ORIGINAL, "cleaned": CLEANED, "feature_engineered": ENGINEERED, "engineered": ENGINEERED,
    "ml_ready": READY, "transformed": None, "active": None, "latest": None,
}
SCHEMA = (
    "seq bigint, version int, version_type string, path string, parent int, is_active boolean, "
    "row_count bigint, column_count int, log string, plan string"
)


def _log_path(base: str) -> str:
    return f"{base.rstrip('/')}/_records"


def _append(spark: SparkSession, base: str, rows: Sequence[tuple]) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(_log_path(base))


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The current state of every version: one row each."""
    records = spark.read.schema(SCHEMA).parquet(_log_path(base))
    newest = F.max_by(F.struct(*[c for c in records.columns if c != "version"]), "seq")
    return records.groupBy("version").agg(newest.alias("r")).select("version", "r.*")


def _rows(spark: SparkSession, base: str) -> list:
    """The manifest on the driver: one small row per version."""
    try:
        return manifest(spark, base).orderBy("version").collect()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise


def _record(row, **changes) -> tuple:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple(changes.get(n, row[n]) for n in names)


def save_version(
    df: DataFrame, base: str, version_type: str, parent: int | None = None, log: Sequence[dict] = (), plan: Sequence[dict] = ()
) -> int:
    """Write the table as the next version and return its number. Logs of the parent are kept in front."""
    if version_type not in PRIORITY:
        raise ValueError(f"Unknown version type: {version_type}")
    spark, known = df.sparkSession, _rows(df.sparkSession, base)
    number = max((r["version"] for r in known), default=0) + 1
    inherited = {r["version"]: r for r in known}.get(parent)
    path = f"{base.rstrip('/')}/v={number}"
    df.write.mode("errorifexists").parquet(path)
    rows = spark.read.parquet(path).count()
    full_log = (json.loads(inherited["log"]) if inherited else []) + list(log)
    full_plan = (json.loads(inherited["plan"]) if inherited else []) + list(plan)
    _append(spark, base, [(
        time.time_ns(), number, version_type, path, parent, True, rows, len(df.columns), json.dumps(full_log), json.dumps(full_plan)
    )])
    return number


def load_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    paths = [r["path"] for r in _rows(spark, base) if r["version"] == version]
    if not paths:
        raise ValueError(f"Version {version} does not exist.")
    return spark.read.parquet(paths[0])


def _rank(*types: str) -> Column:
    out = F.lit(0)
    for t in types:
        out = F.when(F.col("version_type") == t, PRIORITY[t]).otherwise(out)
    return out


def preferred(spark: SparkSession, base: str) -> DataFrame:
    """The manifest row charts read: most processed kind, then active, then newest; else the newest active one."""
    rank = _rank(READY, ENGINEERED, CLEANED)
    order = [rank.desc(), F.desc("is_active"), F.desc("version"), F.desc("seq")]
    return manifest(spark, base).orderBy(*order).limit(1)


def for_cleaning(spark: SparkSession, base: str) -> DataFrame:
    """The newest active cleaned version, else the original."""
    usable = F.col("is_active") & (F.col("version_type") == CLEANED)
    return _newest(manifest(spark, base), usable)


def for_features(spark: SparkSession, base: str) -> DataFrame:
    """The newest active feature version, else cleaned, else the original."""
    active = manifest(spark, base).where(F.col("is_active") | (F.col("version_type") == ORIGINAL))
    return active.where(F.col("version_type") != READY).orderBy(_rank(ENGINEERED, CLEANED, ORIGINAL).desc(), F.desc("version")).limit(1)


def _newest(rows: DataFrame, usable: Column) -> DataFrame:
    fallback = F.col("version_type") == ORIGINAL
    chosen = rows.where(usable | fallback)
    return chosen.orderBy(usable.desc(), F.desc("version")).limit(1)


def resolve(spark: SparkSession, base: str, name: str | int | None = "raw") -> DataFrame:
    """The manifest row for a name: raw, cleaned, engineered, ml_ready, transformed, active, latest or a number.

    A kind means its newest active version; a name without a kind, or an unknown one, the newest active version
    of all. Without one it is the original.
    """
    rows, name = manifest(spark, base), str(name or "raw").strip().lower()
    if name.isdigit():
        return _newest(rows, F.col("version") == int(name))
    kind = ALIASES.get(name)
    if kind == ORIGINAL:
        return _newest(rows, F.lit(False))
    usable = F.col("is_active")
    return _newest(rows, usable if kind is None else usable & (F.col("version_type") == kind))


def load(chosen: DataFrame) -> DataFrame:
    """The table of a manifest row."""
    row = chosen.first()
    if row is None:
        raise ValueError("No version of this table exists.")
    return chosen.sparkSession.read.parquet(row["path"])


def load_pair(spark: SparkSession, base: str, before="raw", after="cleaned") -> tuple[DataFrame, DataFrame]:
    return load(resolve(spark, base, before)), load(resolve(spark, base, after))


def processed_versions(spark: SparkSession, base: str) -> DataFrame:
    """All versions but the original, newest first."""
    return manifest(spark, base).where(F.col("version_type") != ORIGINAL).orderBy(F.desc("version"))


def _change(spark: SparkSession, base: str, version: int, **changes) -> None:
    rows = [r for r in _rows(spark, base) if r["version"] == version]
    if not rows:
        raise ValueError(f"Version {version} does not exist.")
    _append(spark, base, [_record(rows[0], seq=time.time_ns(), **changes)])


def promote(spark: SparkSession, base: str, version: int) -> None:
    """Mark a version as ready for modelling."""
    _change(spark, base, version, version_type=READY, is_active=True)


def rollback(spark: SparkSession, base: str, version: int) -> int:
    """A new version equal to an old one. It points at the old folder; nothing is copied."""
    rows = _rows(spark, base)
    old = [r for r in rows if r["version"] == version]
    if not old:
        raise ValueError(f"Version {version} does not exist.")
    number = max(r["version"] for r in rows) + 1
    entry = json.loads(old[0]["log"]) + [{"action": "rollback", "to_version": version}]
    _append(spark, base, [_record(old[0], seq=time.time_ns(), version=number, parent=version, is_active=True, log=json.dumps(entry))])
    return number


def clean_and_save(spark: SparkSession, base: str, actions: Sequence[dict], order_by: Sequence[str] | None = None) -> int:
    """Run cleaning actions on the newest cleaned version and save the result as the next one."""
    start = for_cleaning(spark, base).first()
    cleaned, log = apply_actions(spark.read.parquet(start["path"]), actions, order_by)
    entries = [r.asDict() for r in log.collect()]  # one row per action
    return save_version(cleaned, base, CLEANED, start["version"], entries)


def save_feature(spark: SparkSession, base: str, source: str, new: str, rule: dict) -> int:
    """Apply a feature rule, save the next feature version, and retire the older ones."""
    start = for_features(spark, base).first()
    made = apply_rule(spark.read.parquet(start["path"]), source, new, rule)
    step = {"column": source, "new_column": new, "rule": rule}
    number = save_version(made, base, ENGINEERED, start["version"], plan=[step])
    retired = [r for r in _rows(spark, base) if r["version_type"] == ENGINEERED and r["version"] != number and r["is_active"]]
    if retired:
        _append(spark, base, [_record(r, seq=time.time_ns(), is_active=False) for r in retired])
    return number


def ingest(df: DataFrame, base: str) -> DataFrame:
    """Store a new table as its first version, and its profile next to it; returns the profile."""
    if df.isEmpty():
        raise ValueError("The table is empty.")
    number = save_version(df, base, ORIGINAL)
    stored = load_version(df.sparkSession, base, number)
    path = f"{base.rstrip('/')}/_profile"
    upload_profile(stored).coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def approve_type(spark: SparkSession, base: str, column: str, approved_type: str) -> None:
    """Record the type a user approved for a column; the newest record counts."""
    row = [(time.time_ns(), column, approved_type)]
    spark.createDataFrame(row, "seq bigint, column_name string, approved_type string").write.mode("append").parquet(f"{base.rstrip('/')}/_types")


def approved_types(spark: SparkSession, base: str) -> DataFrame:
    records = spark.read.schema("seq bigint, column_name string, approved_type string").parquet(f"{base.rstrip('/')}/_types")
    return records.groupBy("column_name").agg(F.max_by("approved_type", "seq").alias("approved_type"))


def version_preview(spark: SparkSession, base: str, version: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first 20 rows of a version."""
    return preview(load_version(spark, base, version), 20, order_by=order_by)
