"""Shared storage, packed ids and block-wise Arrow work for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flatwork.functions.coerce import col
from flatwork.operators.joins import join_on

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach.

    It lies in `spark.checkpoint.dir`. Where that is unset it lies in the warehouse, which a cluster
    shares as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/flatwork-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read back: lineage ends here, and
    a later step reads only the columns that it needs."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Each row with the columns of the row of `table` that has its keys; rows without one go, null matches null.

    The keys are unique in `table`, and `count` tells there how many rows have them. Keys of more than a
    quarter of a partition's share would fill a task of the join. There are at most four of them for each
    partition, so they are broadcast; the rest is joined plainly. Both inputs are read more than once and
    should be stored.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total / (4 * partitions(rows.sparkSession))
    known = table.where(hot)
    same = [col(k).eqNullSafe(col(f"__k_{k}")) for k in keys]
    names = known.select(*[col(k).alias(f"__k_{k}") for k in keys])
    rest = rows.join(F.broadcast(names), reduce(and_, same), "left_anti")
    return join_on(rows, known, keys, bounded=True).unionByName(join_on(rest, table.where(~hot), keys))


def slices(sizes, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about `limit`, one item at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [b"" if v is None else v for v in column.to_pylist()]
