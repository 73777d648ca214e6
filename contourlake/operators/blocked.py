"""Placement of cells by blocks: strips of the reference meet tiles of the subject, and sliding happens inside a task.

What is shuffled is each field once, with the reference's borders, and for each block of a cell its
sums at every displacement; not a row for each sample and displacement.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.expressions import guarded_correlation
from ..functions import heights as H
from ..functions.heights import cell_bounds
from ..sources.tiles import KEY, bordered, packed, pieces_around, unpacked
from .placement import CellParameters, check_cells

SUMS = ("overlap", "sx", "sy", "sxx", "syy", "sxy")
_ROWS = pa.schema([("surface_id", pa.string()), ("cell_r", pa.int32()), ("cell_c", pa.int32()), ("down", pa.int32()), ("across", pa.int32()), ("size", pa.int64()), ("measured", pa.int64()), ("overlap", pa.int64()), *((n, pa.float64()) for n in SUMS[1:])])
_ROWS_DDL = "surface_id string, cell_r int, cell_c int, down int, across int, size long, measured long, overlap long, sx double, sy double, sxx double, syy double, sxy double"

_FOUND = pa.schema([*list(_ROWS)[:5], ("overlap", pa.int64()), ("correlation", pa.float64())])
_FOUND_DDL = "surface_id string, cell_r int, cell_c int, down int, across int, overlap long, correlation double"

#: Products of samples and displacements up to which they are summed directly; beyond, by FFT.
DIRECT = 1 << 21


def centred_sums(block: np.ndarray, around: np.ndarray) -> tuple[list[np.ndarray], float, float]:
    """Count, sums, squares and products of the block and the equally large part of ``around`` at every place, row by row, each less its mean; and the means."""
    shape = around.shape[0] - block.shape[0] + 1, around.shape[1] - block.shape[1] + 1

    def planes(h):
        seen = ~np.isnan(h)
        mean = float(h[seen].mean()) if seen.any() else 0.0
        value = np.where(seen, np.nan_to_num(h) - mean, 0.0)
        return np.stack([seen.astype(float), value, value * value]), mean

    (own, mx), (other, my) = planes(block), planes(around)
    if shape[0] * shape[1] * block.size <= DIRECT:
        view = np.lib.stride_tricks.sliding_window_view(other, block.shape, axis=(1, 2)).reshape(3, shape[0] * shape[1], -1)
        products = np.einsum("pdk,qk->pqd", view, own.reshape(3, -1), optimize=True)
    else:
        spectrum = np.fft.rfft2(other)[:, None] * np.conj(np.fft.rfft2(own, around.shape))[None, :]
        products = np.fft.irfft2(spectrum, around.shape)[:, :, : shape[0], : shape[1]].reshape(3, 3, -1)
    return [np.rint(products[0, 0]), products[0, 1], products[1, 0], products[0, 2], products[2, 0], products[1, 1]], mx, my


def overlap_sums(block: np.ndarray, around: np.ndarray) -> list[np.ndarray]:
    """The same of the values as they are, so that sums of parts can be added."""
    (n, sx, sy, sxx, syy, sxy), mx, my = centred_sums(block, around)
    return [n, sx + n * mx, sy + n * my, sxx + mx * (2 * sx + n * mx), syy + my * (2 * sy + n * my), sxy + mx * sy + my * sx + n * mx * my]


def blocks(grid: int, side: int):
    """Bounds of blocks: as many whole cells as ``side`` holds, or parts of a cell that is larger."""

    def of(n: int) -> list[int]:
        edges = cell_bounds(n, grid).tolist()
        if max(b - a for a, b in zip(edges, edges[1:], strict=False)) > side:
            return [*(at for a, b in zip(edges, edges[1:], strict=False) for at in range(a, b, side)), n]
        out = [0]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - out[-1] > side:
                out.append(a)
        return [*out, n]

    return of


def cells_in(row: dict, grid: int):
    """(cell row, cell column, rows, columns) of the cells that lie in a block, in part or whole; slices count from its corner."""
    rows, cols = cell_bounds(row["n_rows"], grid), cell_bounds(row["n_cols"], grid)
    for i in range(grid):
        for j in range(grid):
            a, b = (int(np.clip(v - row["top"], 0, row["rows"])) for v in rows[i : i + 2])
            c, d = (int(np.clip(v - row["left"], 0, row["cols"])) for v in cols[j : j + 2])
            if a < b and c < d:
                yield i, j, slice(a, b), slice(c, d)


def widened(part: slice, by: int) -> slice:
    """A slice of a block, in the block with ``by`` samples on each side: with as many around it."""
    return slice(part.start, part.stop + 2 * by)


def _summed(grid: int, limit: int, side: int):
    reach = 2 * limit + 1
    down, across = (v.astype(np.int32).ravel() - limit for v in np.indices((reach, reach)))

    def place(subject: pa.Table, reference: pa.Table) -> pa.Table:
        out = [_ROWS.empty_table()]
        if subject.num_rows:
            key = subject.slice(0, 1).drop_columns(["starts", "lengths", "values"]).to_pylist()[0]
            top, left = key["tile_r"] * side, key["tile_c"] * side
            row = key | {"top": top, "left": left, "rows": min(side, key["n_rows"] - top), "cols": min(side, key["n_cols"] - left)}
            (tile, given), (around, _) = unpacked(subject, side), unpacked(reference, side, limit)
            for i, j, r, c in cells_in(row, grid):
                block, size = tile[r, c], int(given[r, c].sum())
                if size:
                    fixed = [np.full(reach * reach, v, np.int64) for v in (i, j)], [np.full(reach * reach, v, np.int64) for v in (size, (~np.isnan(block)).sum())]
                    sums = overlap_sums(block, around[widened(r, limit), widened(c, limit)])
                    columns = [*fixed[0], down, across, *fixed[1], sums[0].astype(np.int64), *sums[1:]]
                    out.append(pa.table([pa.array([key["surface_id"]] * (reach * reach), pa.string()), *(pa.array(v, f.type) for v, f in zip(columns, list(_ROWS)[1:], strict=True))], schema=_ROWS))
        return pa.concat_tables(out)

    return place


def sample_sums(subject: DataFrame, reference: DataFrame, grid: int, limit: int, side: int) -> DataFrame:
    """Sums of every cell at every displacement, of samples. They meet in tiles of ``side``; a cell's parts are added.

    What travels is each sample once, the reference's up to (1 + 2 limit / side)**2 times, and for each
    part of a cell its (2 limit + 1)**2 sums. A task holds a tile and the reference ``limit`` around it.
    """
    keys = ["surface_id", "cell_r", "cell_c", "down", "across"]
    own, other = packed(subject, side), packed(reference, side, limit)
    met = own.groupBy(*KEY).cogroup(other.groupBy(*KEY)).applyInArrow(_summed(grid, limit, side), _ROWS_DDL)
    return met.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("size", "measured", *SUMS)))


def _placed(p: CellParameters, limit: int, whole: bool):
    """Sums of each block's cells; of ``whole`` cells the correlations, where there is one."""
    side, schema = 2 * limit + 1, _FOUND if whole else _ROWS
    down, across = (v.astype(np.int32).ravel() - limit for v in np.indices((side, side)))

    def place(subject: pa.Table, reference: pa.Table) -> pa.Table:
        own, pieces = subject.to_pylist(), reference.to_pylist()
        out = [schema.empty_table()]
        if own:
            row = own[0]
            if any((x["n_rows"], x["n_cols"]) != (row["n_rows"], row["n_cols"]) for x in pieces):
                raise Refusal("different-shapes", f"the fields of {row['surface_id']}")
            tile, around = bordered(row, own, 0, 0), bordered(row, pieces, limit, limit, whole=True)
            for i, j, r, c in cells_in(row, p.grid):
                block, near = tile[r, c], around[widened(r, limit), widened(c, limit)]
                measured = int((~np.isnan(block)).sum())
                if whole and measured < p.minimum_valid * block.size:
                    continue
                sums, take = overlap_sums(block, near), slice(None)
                fixed = [np.full(side * side, v) for v in (block.size, measured)]
                if whole:
                    found = H._correlations(sums)
                    take = np.flatnonzero((sums[0] >= max(1, math.ceil(p.minimum_valid * block.size))) & ~np.isnan(found))
                    fixed, sums = [], [sums[0], found]
                columns = [*(np.full(side * side, v, np.int32) for v in (i, j)), down, across, *fixed, sums[0].astype(np.int64), *sums[1:]]
                columns = [v[take] for v in columns]
                out.append(pa.table([pa.array([row["surface_id"]] * len(columns[0]), pa.string()), *(pa.array(v, f.type) for v, f in zip(columns, list(schema)[1:], strict=True))], schema=schema))
        return pa.concat_tables(out)

    return place


def blocked_correlations(subject: DataFrame, reference: DataFrame, side: int, p: CellParameters, limit: int) -> DataFrame:
    """As ``placement.correlations``, of tables of tiles with one ``surface_id`` for each pair and fields of one shape.

    Blocks hold whole cells, whose correlations a task gives at once; of cells larger than ``side``
    they hold parts, whose (2 limit + 1)**2 sums are added by a second shuffle. A task holds a block and
    the reference ``limit`` around it; both fields are shuffled, the reference up to (1 + 2 limit / side)**2 times.
    """
    check_cells(p)
    small = (F.ceil(F.col("n_rows") / p.grid) <= side) & (F.ceil(F.col("n_cols") / p.grid) <= side)
    bounds = blocks(p.grid, side)

    def met(which, whole: bool, ddl: str) -> DataFrame:
        own, other = pieces_around(subject.where(which), bounds, 0, 0), pieces_around(reference.where(which), bounds, limit, limit)
        return own.groupBy(*KEY).cogroup(other.groupBy(*KEY)).applyInArrow(_placed(p, limit, whole), ddl)

    keys = ["surface_id", "cell_r", "cell_c", "down", "across"]
    sums = met(~small, False, _ROWS_DDL).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("size", "measured", *SUMS)))
    return met(small, True, _FOUND_DDL).unionByName(correlated(sums, p))


def correlated(sums: DataFrame, p: CellParameters) -> DataFrame:
    """Correlations of usable cells from their sums, where the overlap is large enough and both sides have variance."""
    enough = (F.col("measured") >= F.lit(p.minimum_valid) * F.col("size")) & (F.col("overlap") >= F.greatest(F.lit(1), F.ceil(F.lit(p.minimum_valid) * F.col("size"))))
    value = guarded_correlation(F.col("overlap"), *(F.col(c) for c in SUMS[1:]))
    return sums.where(enough).withColumn("correlation", value).where("correlation IS NOT NULL").select("surface_id", "cell_r", "cell_c", "down", "across", "overlap", "correlation")
