"""Comparisons that fail where there is no answer, what they cost, and outcomes seen while rows go by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import heights as H
from . import masks as M
from . import placement as P

_WORK = pa.schema([("pair_id", pa.string()), ("usable", pa.int64())])


def work_of(pairs: DataFrame, p: P.CellParameters | P.SearchParameters) -> DataFrame:
    """(pair_id, usable, correlations): the subject's usable cells, and these times the angles searched. Reads the subjects alone."""
    P.check_cells(p)
    turns = len(H.angles(p.rotation_range_deg, p.rotation_step_deg)) if isinstance(p, P.SearchParameters) else 1

    def scan(batches):
        for batch in batches:
            shapes, heights = (list(zip(*(batch.column(n).to_pylist() for n in ("s_n_rows", "s_n_cols")), strict=True)), batch.column("s_heights"))
            fields = (np.array(heights[k].values.to_numpy(zero_copy_only=False), np.float64).reshape(shape) for k, shape in enumerate(shapes))
            usable = [sum(1 for _ in H.tiles(h, p.grid, p.minimum_valid)) for h in fields]
            yield pa.RecordBatch.from_arrays([batch.column("pair_id"), pa.array(usable, pa.int64())], schema=_WORK)

    narrow = pairs.select(F.col("pair_id").cast("string").alias("pair_id"), "s_n_rows", "s_n_cols", "s_heights")
    return narrow.mapInArrow(scan, "pair_id string, usable long").withColumn("correlations", F.col("usable") * turns)


def answered(found: DataFrame, work: DataFrame) -> DataFrame:
    """``found``, the rows of comparisons, unless a pair has no usable cell or none of its cells was placed: then its evaluation fails.

    One join on the pair, whose one side has a row for each.
    """
    columns = found.columns
    met = work.join(found.withColumn("_placed", F.lit(True)), "pair_id", "left")

    def fails(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{reason}: "), F.col("pair_id"))).cast("boolean")

    fine = F.when(F.col("usable") == 0, fails("no-usable-cell")).when(F.col("_placed").isNull(), fails("no-match")).otherwise(True)
    return met.where(fine).select(*columns)


def compare(pairs: DataFrame, p: P.CellParameters) -> DataFrame:
    """``placement.compare``; a pair without an answer fails."""
    return answered(P.compare(pairs, p), work_of(pairs, p))


def register(pairs: DataFrame, p: P.SearchParameters) -> DataFrame:
    """The best placement of each cell over all angles; a pair without an answer at any of them fails."""
    return answered(P.best_over_angles(P.registrations(pairs, p)), work_of(pairs, p))


def masked(samples: DataFrame, region: Column, seen: Observation) -> DataFrame:
    """``masks.mask``, with ``masked_samples`` (measured ones that went) and ``measured_samples`` (those before) in ``seen``, at no further pass.

    ``seen.get`` has the counts once the rows have been written or counted.
    """
    measured = F.col("h").isNotNull()
    return M.mask(samples.observe(seen, F.count_if(measured & region).alias("masked_samples"), F.count_if(measured).alias("measured_samples")), region)
