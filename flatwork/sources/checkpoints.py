"""Lineage cuts for iterative operators, through storage every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, one in the warehouse, which a cluster shares too."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
        current = context.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and read back."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored_columns(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder as Parquet and read back: smaller than `cut_lineage` for long arrays
    of numbers, and a later step reads only the columns that it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
