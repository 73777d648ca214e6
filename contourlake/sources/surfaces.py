"""Height fields as tables: one row for each field, or one for each sample.

``surfaces``: surface_id, n_rows, n_cols, spacing_y, spacing_x, heights (row by row, null where absent)
and provenance. ``samples``: surface_id, r, c, h with the field's shape and spacings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "version", "parameters", "outcomes")])
SHAPE = ("n_rows", "n_cols", "spacing_y", "spacing_x")
SURFACES = T.StructType(
    [
        T.StructField("surface_id", T.StringType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("spacing_y", T.DoubleType()),
        T.StructField("spacing_x", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("orientation", T.StringType()),
        T.StructField("heights", T.ArrayType(T.DoubleType())),
        T.StructField("provenance", T.ArrayType(RECORD)),
    ]
)


def samples(surfaces: DataFrame) -> DataFrame:
    """One row for each sample, absent ones too. A narrow operation."""
    exploded = surfaces.select("surface_id", *SHAPE, F.posexplode("heights").alias("_at", "h"))
    return exploded.select("surface_id", F.floor(F.col("_at") / F.col("n_cols")).cast("int").alias("r"), (F.col("_at") % F.col("n_cols")).alias("c"), "h", *SHAPE)


def collected(rows: DataFrame, unit: str = "um", orientation: str = "y-down") -> DataFrame:
    """Fields from their samples; a field is one row in any case, so a group is bounded by its size."""
    grouped = rows.groupBy("surface_id", *SHAPE).agg(F.array_sort(F.collect_list(F.struct("r", "c", "h"))).alias("_cells"))
    none = F.array().cast(T.ArrayType(RECORD))
    return grouped.select("surface_id", *SHAPE, F.lit(unit).alias("unit"), F.lit(orientation).alias("orientation"), F.col("_cells.h").alias("heights"), none.alias("provenance"))


def fields_of(batch: pa.RecordBatch, column: str = "heights") -> Iterator[np.ndarray]:
    """The height fields of a batch, NaN where a sample is absent."""
    heights = batch.column(column)
    values = heights.flatten().to_numpy(zero_copy_only=False)
    at = np.append(0, np.cumsum(heights.value_lengths().fill_null(0).to_numpy()))
    for k, (rows, cols) in enumerate(zip(batch.column("n_rows").to_pylist(), batch.column("n_cols").to_pylist(), strict=True)):
        yield np.array(values[at[k] : at[k + 1]], np.float64).reshape(rows, cols)


def heights_array(fields: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([f.ravel() for f in fields]) if fields else np.zeros(0)
    offsets = np.append(0, np.cumsum([f.size for f in fields])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))


def mapped(surfaces: DataFrame, of: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Each field replaced by what ``of(heights, row)`` makes of it, in one pass without a shuffle.

    ``row`` has the other columns. The result's shape may differ.
    """

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.drop_columns(["heights"]).to_pylist()
            out = [of(h, row) for h, row in zip(fields_of(batch), rows, strict=True)]
            new = {"heights": heights_array(out), "n_rows": pa.array([f.shape[0] for f in out], pa.int32()), "n_cols": pa.array([f.shape[1] for f in out], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return surfaces.mapInArrow(scan, surfaces.schema)


def from_embeddings(spark: SparkSession, sf_dir: str, height: int = 64, spacing: float = 4.0) -> DataFrame:
    """The vectors of ``embeddings`` stacked into fields of ``height`` rows (the last may have fewer).

    Samples with (31 r + 17 c) mod 23 = 0 are absent.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    row = e.select(F.floor(F.col("vec_id") / height).cast("string").alias("surface_id"), (F.col("vec_id") % height).cast("int").alias("r"), F.col("embedding").cast("array<double>").alias("v"))
    holed = F.transform("v", lambda h, c: F.when((F.col("r") * 31 + c * 17) % 23 != 0, h))
    grouped = row.select("surface_id", "r", F.size("v").alias("n_cols"), holed.alias("v")).groupBy("surface_id", "n_cols").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("rows"))
    none = F.array().cast(T.ArrayType(RECORD))
    return grouped.select("surface_id", F.size("rows").alias("n_rows"), "n_cols", F.lit(spacing).alias("spacing_y"), F.lit(spacing).alias("spacing_x"), F.lit("um").alias("unit"), F.lit("y-down").alias("orientation"), F.flatten("rows.v").alias("heights"), none.alias("provenance")).to(SURFACES)


def rows_from_embeddings(spark: SparkSession, sf_dir: str, spacing: float = 4.0) -> DataFrame:
    """All vectors of ``embeddings`` as the rows of one field, named ``all``, with the same samples absent as in small fields."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("r"), F.col("embedding").cast("array<double>").alias("v"))
    n_rows = e.agg(F.max("r")).first()[0]
    holed = F.transform("v", lambda h, c: F.when((F.col("r") * 31 + c * 17) % 23 != 0, h))
    return e.select(F.lit("all").alias("surface_id"), F.lit((n_rows or 0) + 1).alias("n_rows"), F.size("v").alias("n_cols"), F.lit(spacing).alias("spacing_y"), F.lit(spacing).alias("spacing_x"), "r", holed.alias("values"))
