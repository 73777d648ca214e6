"""Tables, scratch storage and session settings shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named (tests)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="contourlake-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession, patience: float = 0.0) -> None:
    """Has Spark delete the shuffle files that nothing needs any more, as it does once the driver has collected their handles.

    The last job's handles go in a second collection, after ``patience`` seconds in which its events pass.
    """
    spark.sparkContext._jvm.System.gc()
    if patience:
        time.sleep(patience)
        spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str, dictionary: bool = True, codec: str | None = None) -> DataFrame:
    """``df`` written once to shared storage and read back: its lineage ends here, and losing an executor loses nothing.

    Without ``dictionary``, for columns of hashes, Parquet doesn't try to find repeated values.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path, compression=codec)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)
