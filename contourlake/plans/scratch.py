"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The cluster's own folder (``spark.checkpoint.dir``); a temporary one only in local mode."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="contourlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that a lost executor loses none of it."""
    _shared(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own beside the checkpoints."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back: in columns, so smaller than ``cut``, but dealt anew."""
    where = folder(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
