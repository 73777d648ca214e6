"""Cell division, masked correlation and registration.

``pairs``: pair_id, and for subject and reference (prefix ``s_``, ``r_``) heights, shape, spacings, unit
and orientation. Registration is distributed by pair and block of angles: each task turns a reference once
for each angle and places the subject's tiles on it, over the bounded displacements only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal, number, whole
from ..functions import heights as H
from ..functions.expressions import part_of
from ..sources.surfaces import SHAPE


@dataclass(frozen=True)
class CellParameters:
    grid: int
    minimum_valid: float


@dataclass(frozen=True)
class SearchParameters:
    grid: int
    minimum_valid: float
    rotation_range_deg: float
    rotation_step_deg: float
    translation_limit: int


def check_cells(p) -> None:
    whole(p.grid, "grid", least=1)
    number(p.minimum_valid, "minimum_valid", above=0, most=1)


def check_search(p: SearchParameters) -> None:
    check_cells(p)
    number(p.rotation_range_deg, "rotation_range_deg", least=0)
    number(p.rotation_step_deg, "rotation_step_deg", above=0)
    whole(p.translation_limit, "translation_limit", least=0)
    if p.rotation_range_deg >= 180:
        raise Refusal("out-of-range", "rotation_range_deg")
    if p.rotation_range_deg:
        steps = p.rotation_range_deg / p.rotation_step_deg
        if p.rotation_step_deg > p.rotation_range_deg or abs(steps - round(steps)) > 1e-9:
            raise Refusal("step-does-not-divide", f"{p.rotation_step_deg} and {p.rotation_range_deg}")


def cells(samples: DataFrame, p: CellParameters) -> DataFrame:
    """Samples with their cell; every sample is in exactly one."""
    check_cells(p)
    return samples.withColumn("cell_r", part_of(F.col("r"), F.col("n_rows"), p.grid)).withColumn("cell_c", part_of(F.col("c"), F.col("n_cols"), p.grid))


def usable_cells(samples: DataFrame, p: CellParameters) -> DataFrame:
    """One row for each cell: its corner and size, measured samples, and whether it has enough of them."""
    measured, size = F.count("h"), F.count("*")
    grouped = cells(samples, p).groupBy("surface_id", "cell_r", "cell_c")
    return grouped.agg(F.min("r").alias("top"), F.min("c").alias("left"), size.alias("size"), measured.alias("measured"), (measured >= F.lit(p.minimum_valid) * size).alias("usable"))


#: Rows and columns of the tiles in which samples meet.
TILE = 128


def correlations(subject: DataFrame, reference: DataFrame, p: CellParameters, limit: int) -> DataFrame:
    """Masked correlation of every usable cell at every displacement within ``limit``, of samples.

    ``subject`` and ``reference`` are samples with one ``surface_id`` for each pair. They meet in tiles,
    where a task slides over the displacements, so that no sample travels once for each of them.
    For large limits use ``registrations``. Displacements with too small an overlap, or without
    variance on either side, have no row.
    """
    from .blocked import correlated, sample_sums  # which takes its parameters from here

    check_cells(p)
    return correlated(sample_sums(subject, reference, p.grid, limit, TILE), p)


def best_placements(found: DataFrame) -> DataFrame:
    """The best displacement of each cell; ties go to the first in raster order. Correlations are compared to 9 places."""
    rank = Window.partitionBy("surface_id", "cell_r", "cell_c").orderBy(F.round("correlation", 9).desc(), "down", "across")
    return found.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


SIDE = ("heights", "unit", "orientation", *SHAPE)


def paired(subjects: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs from two tables of surfaces with a ``pair_id`` each."""
    s = subjects.select("pair_id", *(F.col(c).alias(f"s_{c}") for c in SIDE))
    return s.join(references.select("pair_id", *(F.col(c).alias(f"r_{c}") for c in SIDE)), "pair_id")


def comparable(pairs: DataFrame) -> DataFrame:
    """The pairs, unless units, orientations or spacings of one differ: then its evaluation fails."""
    same = F.lit(True)
    for c in ("unit", "orientation", "spacing_y", "spacing_x"):
        same = same & (F.col(f"s_{c}") == F.col(f"r_{c}"))
    return pairs.where(F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("not-comparable: "), F.col("pair_id").cast("string"))).cast("boolean")))


PLACED = "pair_id string, angle_deg double, cell_r int, cell_c int, down int, across int, correlation double, overlap long"
_PLACED = pa.schema([("pair_id", pa.string()), ("angle_deg", pa.float64()), ("cell_r", pa.int32()), ("cell_c", pa.int32()), ("down", pa.int32()), ("across", pa.int32()), ("correlation", pa.float64()), ("overlap", pa.int64())])


def field_of(row: dict, side: str) -> np.ndarray:
    return np.array(row[f"{side}_heights"], np.float64).reshape(row[f"{side}_n_rows"], row[f"{side}_n_cols"])


def _scan(of):
    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                plain = {n: (v.values.to_numpy(zero_copy_only=False) if n.endswith("heights") else v.as_py()) for n, v in row.items()}
                s, r = field_of(plain, "s"), field_of(plain, "r")
                found = [(plain["pair_id"], angle, *x) for angle in plain.get("angles", [0.0]) for x in of(s, r, angle, plain)]
                columns = zip(*found, strict=True) if found else [()] * len(_PLACED)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACED, strict=True)], schema=_PLACED)

    return scan


def compare(pairs: DataFrame, p: CellParameters) -> DataFrame:
    """Best placement of each usable cell in one orientation, anywhere on the reference that holds it whole."""
    check_cells(p)
    found = comparable(pairs).withColumn("pair_id", F.col("pair_id").cast("string"))
    return found.mapInArrow(_scan(lambda s, r, _angle, _row: H.compared(s, r, p.grid, p.minimum_valid)), PLACED)


def registrations(pairs: DataFrame, p: SearchParameters, blocks: int = 8) -> DataFrame:
    """Best placement of each usable cell at every angle: (pair_id, angle_deg, cell_r, cell_c, down, across, correlation, overlap).

    Angles are dealt to ``blocks`` blocks at most, so one pair's angles run on as many executors, and what
    travels is one copy of the pair for each block however many angles there are. Blocks of one pair go to
    partitions next to each other. Cells without any admissible displacement have no row. Fields too large
    for a row are registered by ``turned.registrations``.
    """
    check_search(p)
    whole(blocks, "blocks", least=1)
    turns = H.angles(p.rotation_range_deg, p.rotation_step_deg)
    dealt = [turns[k::blocks] for k in range(min(blocks, len(turns)))]
    named = comparable(pairs).withColumn("pair_id", F.col("pair_id").cast("string"))
    each = named.select("*", F.posexplode(F.array(*(F.array(*map(F.lit, x)) for x in dealt))).alias("_block", "angles"))
    return _spread(each).mapInArrow(_scan(lambda s, r, angle, _row: H.placements(s, r, angle, p.grid, p.minimum_valid, p.translation_limit)), PLACED)


def registrations_each(pairs: DataFrame, blocks: int = 8) -> DataFrame:
    """``registrations`` of pairs that bring their own searches, checked before: ``grid``, ``minimum_valid``, ``translation_limit`` and ``angles``."""
    whole(blocks, "blocks", least=1)
    dealt = F.transform(F.sequence(F.lit(0), F.least(F.lit(blocks), F.size("angles")) - 1), lambda k: F.filter("angles", lambda _, i: F.pmod(i, F.lit(blocks)) == k))
    named = comparable(pairs).withColumn("pair_id", F.col("pair_id").cast("string"))
    each = named.select(*(c for c in named.columns if c != "angles"), F.posexplode(dealt).alias("_block", "angles"))
    return _spread(each).mapInArrow(_scan(lambda s, r, angle, row: H.placements(s, r, angle, row["grid"], row["minimum_valid"], row["translation_limit"])), PLACED)


def _spread(each: DataFrame) -> DataFrame:
    """Blocks of one pair in partitions next to each other."""
    tasks = _tasks(each)
    return each.repartitionById(tasks, F.pmod(F.hash("pair_id").cast("long") + F.col("_block"), F.lit(tasks)).cast("int")).drop("_block")


def _tasks(pairs: DataFrame) -> int:
    context = pairs.sparkSession.sparkContext
    return max(context.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def best_over_angles(by_angle: DataFrame) -> DataFrame:
    """Best angle of each cell; ties go to the smallest angle. Correlations are compared to 9 places."""
    rank = Window.partitionBy("pair_id", "cell_r", "cell_c").orderBy(F.round("correlation", 9).desc(), "angle_deg")
    return by_angle.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def work(shape: tuple[int, int], p: SearchParameters) -> int:
    """Correlations that a pair costs at most: tiles times angles."""
    if p.grid > min(shape):
        raise Refusal("grid-too-fine", f"{p.grid} on {shape}")
    return p.grid**2 * len(H.angles(p.rotation_range_deg, p.rotation_step_deg))


def least_overlap(size: int, minimum_valid: float) -> int:
    return max(1, math.ceil(minimum_valid * size))
