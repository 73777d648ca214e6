"""Containers as they arrive: a folder watched as a stream, each file decoded and recorded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.steps import Applied, run_chain
from ..sources.container import decoded

BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, glob: str = "*.x3p") -> DataFrame:
    """A streaming table of fields from a folder's containers; refused files have a reason."""
    return decoded(spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).load(folder))


def preprocess(spark: SparkSession, folder: str, chain: list[Applied], out: str, checkpoint: str) -> StreamingQuery:
    """Runs the chain on every container that isn't processed yet and ends. The checkpoint knows which are."""
    fields = arrivals(spark, folder).where("refused IS NULL").drop("refused")
    return run_chain(fields, chain).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
