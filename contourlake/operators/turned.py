"""Turning and registering fields in tiles: a turned tile gathers the parts of the field that it is made of.

A tile of the field is sent to the tiles that read it after the turn (the inverse map of a tile is a turned
rectangle), cut to what they read. Angles travel in blocks: what a block's angles read of a tile is sent once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal, whole
from ..functions import heights as H
from ..functions.expressions import guarded_correlation
from ..sources.tiles import FIELD, PLACE, TILES, TILES_DDL, Bounds, bordered, every, pieces_around, tile_batch, tiles_of
from .blocked import SUMS, blocks, cells_in, centred_sums, overlap_sums, widened
from .placement import SearchParameters, check_search

KEY = ("surface_id", "angle_block", "tile_r", "tile_c")
_PARTS = pa.schema([*list(TILES)[:-1], ("angle_block", pa.int32()), ("at_r", pa.int32()), ("at_c", pa.int32()), ("high", pa.int32()), ("wide", pa.int32()), ("piece", pa.binary())])
_PARTS_DDL = TILES_DDL.replace("heights array<double>", "angle_block int, at_r int, at_c int, high int, wide int, piece binary")
_TURNED_DDL = f"{TILES_DDL}, angle_deg double"

Box = tuple[int, int, int, int]  # first row, row after the last, first column, column after the last


def _mapped(box: Box, shape: tuple[int, int], degrees: float, beyond: int) -> Box:
    """The rows and columns around the places of a box's samples in a field turned by ``degrees``, ``beyond`` more after them."""
    r, c = np.array([box[0], box[0], box[1] - 1, box[1] - 1]), np.array([box[2], box[3] - 1, box[2], box[3] - 1])
    y, x = H.turned_from(r, c, shape, degrees)
    return math.floor(y.min()), math.floor(y.max()) + beyond, math.floor(x.min()), math.floor(x.max()) + beyond


def _cut(box: Box, to: Box) -> Box | None:
    found = max(box[0], to[0]), min(box[1], to[1]), max(box[2], to[2]), min(box[3], to[3])
    return found if found[0] < found[1] and found[2] < found[3] else None


def read_by(box: Box, shape: tuple[int, int], degrees: float) -> Box | None:
    """What a box of the turned field reads of the field: its corners' places are its extremes, for the map is linear."""
    return _cut(_mapped(box, shape, degrees, 2), (0, shape[0], 0, shape[1]))


def _widest(a: Box | None, b: Box) -> Box:
    return b if a is None else (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))


def _parts(bounds: Bounds, turns: list[list[float]], border: int, own: bool):
    """For each block of ``bounds``, with its border, and each block of angles, the part of a tile that it reads; ``own``: an empty one to the tile's own place."""

    def wanted(row: dict, edges_r: list[int], edges_c: list[int], angles: list[float]) -> dict[tuple[int, int], Box]:
        shape, here = (row["n_rows"], row["n_cols"]), (row["top"], row["top"] + row["rows"], row["left"], row["left"] + row["cols"])
        out: dict[tuple[int, int], Box] = {}
        for degrees in angles:
            # The tile lies here after the turn; only blocks that come as near can read it.
            low_r, high_r, low_c, high_c = _mapped(here, shape, -degrees, 1)
            rows, cols = (range(max(0, int(np.searchsorted(e, a - border - 3, "right")) - 1), min(len(e) - 1, int(np.searchsorted(e, b + border + 3, "left")))) for e, a, b in ((edges_r, low_r, high_r), (edges_c, low_c, high_c)))
            for i in rows:
                for j in cols:
                    box = read_by((edges_r[i] - border, edges_r[i + 1] + border, edges_c[j] - border, edges_c[j + 1] + border), shape, degrees)
                    if box and (met := _cut(box, here)):
                        out[i, j] = _widest(out.get((i, j)), met)
        return out

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for h, row in tiles_of(batch):
                r, q = bounds(row["n_rows"]), bounds(row["n_cols"])
                for number, angles in enumerate(turns):
                    found = wanted(row, r, q, angles)
                    if own:
                        found.setdefault((row["tile_r"], row["tile_c"]), (row["top"], row["top"], row["left"], row["left"]))
                    out: dict[str, list] = {n: [] for n in _PARTS.names}
                    for (i, j), (a, b, c, d) in found.items():
                        to = row | {"tile_r": i, "tile_c": j, "top": r[i], "left": q[j], "rows": r[i + 1] - r[i], "cols": q[j + 1] - q[j], "angle_block": number}
                        part = h[a - row["top"] : b - row["top"], c - row["left"] : d - row["left"]]
                        for name, value in (to | {"at_r": a, "at_c": c, "high": b - a, "wide": d - c, "piece": np.ascontiguousarray(part).tobytes()}).items():
                            out[name].append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PARTS], schema=_PARTS)

    return scan


def _turned(row: dict, pieces: list[dict], border: int, degrees: float) -> np.ndarray:
    """A block with its border, whole (absent beyond the field), of the field turned by ``degrees``."""
    shape = row["n_rows"], row["n_cols"]
    box = row["top"] - border, row["top"] + row["rows"] + border, row["left"] - border, row["left"] + row["cols"] + border
    rows, cols = np.arange(box[0], box[1])[:, None], np.arange(box[2], box[3])[None, :]
    read = read_by(box, shape, degrees) or (0, 0, 0, 0)
    h = np.full((read[1] - read[0], read[3] - read[2]), np.nan)
    for p in pieces:
        met = _cut(read, (p["at_r"], p["at_r"] + p["high"], p["at_c"], p["at_c"] + p["wide"]))
        if met:
            part = np.frombuffer(p["piece"]).reshape(p["high"], p["wide"])
            h[met[0] - read[0] : met[1] - read[0], met[2] - read[2] : met[3] - read[2]] = part[met[0] - p["at_r"] : met[1] - p["at_r"], met[2] - p["at_c"] : met[3] - p["at_c"]]
    out = H.gathered(h, *H.turned_from(rows, cols, shape, degrees), read[0], read[2])
    # Places outside the shape aren't samples of the turned field, even where the turn brings measured ones there.
    return np.where((rows >= 0) & (rows < shape[0]) & (cols >= 0) & (cols < shape[1]), out, np.nan)


def angle_blocks(angles: Sequence[float], per_block: int) -> list[list[float]]:
    """Neighbouring angles together, for they read much the same."""
    whole(per_block, "per_block", least=1)
    return [list(angles[k : k + per_block]) for k in range(0, len(angles), per_block)]


def turn(tiles: DataFrame, side: int, angles: Sequence[float], per_block: int = 8) -> DataFrame:
    """Tiles of each field turned by each of ``angles`` (``angle_deg``), as ``heights.rotated`` does to a whole field.

    One shuffle of what blocks of ``per_block`` neighbouring angles read. A task holds that for one tile, at
    most ``per_block`` turned rectangles of about twice a tile's samples, and the turned tiles.
    """
    turns = angle_blocks(angles, per_block)

    def assembled(group: pa.Table) -> pa.Table:
        pieces = group.to_pylist()
        row, out = pieces[0], []
        for degrees in turns[row["angle_block"]]:
            made = pa.Table.from_batches([tile_batch([row], [_turned(row, pieces, 0, degrees)])])
            out.append(made.append_column("angle_deg", pa.array([degrees], pa.float64())))
        return pa.concat_tables(out)

    return tiles.select(*FIELD, *PLACE, "heights").mapInArrow(_parts(every(side), turns, 0, True), _PARTS_DDL).groupBy(*KEY).applyInArrow(assembled, _TURNED_DDL)


_CELL = [("surface_id", pa.string()), ("angle_deg", pa.float64()), ("cell_r", pa.int32()), ("cell_c", pa.int32()), ("down", pa.int32()), ("across", pa.int32())]
_CELL_DDL = "surface_id string, angle_deg double, cell_r int, cell_c int, down int, across int"
_BEST = pa.schema([*_CELL, ("overlap", pa.int64()), ("correlation", pa.float64())])
_BEST_DDL = f"{_CELL_DDL}, overlap long, correlation double"
_ADDED = pa.schema([*_CELL, ("size", pa.int64()), ("measured", pa.int64()), ("overlap", pa.int64()), *((n, pa.float64()) for n in SUMS[1:])])
_ADDED_DDL = f"{_CELL_DDL}, size long, measured long, overlap long, sx double, sy double, sxx double, syy double, sxy double"


def _placed(p: SearchParameters, turns: list[list[float]], whole_cells: bool):
    """Of ``whole_cells`` the best displacement at each angle; of parts of cells their sums at each displacement."""
    limit, schema = p.translation_limit, _BEST if whole_cells else _ADDED
    side = 2 * limit + 1
    down, across = (v.astype(np.int32).ravel() - limit for v in np.indices((side, side)))

    def best(block, near, least):
        sums, mx, my = centred_sums(block, near)
        found = H._correlations(sums, mx, my)
        found[sums[0] < least] = np.nan
        if np.isnan(found).all():
            return None
        k = int(np.nanargmax(np.round(found, 12)))
        return down[k : k + 1], across[k : k + 1], sums[0][k : k + 1].astype(np.int64), found[k : k + 1]

    def place(subject: pa.Table, reference: pa.Table) -> pa.Table:
        own, pieces = subject.to_pylist(), reference.to_pylist()
        out = [schema.empty_table()]
        if own and pieces:
            row = own[0]
            if any((x["n_rows"], x["n_cols"]) != (row["n_rows"], row["n_cols"]) for x in pieces):
                raise Refusal("different-shapes", f"the fields of {row['surface_id']}")
            tile = bordered(row, own, 0, 0)
            for degrees in turns[row["angle_block"]]:
                around = _turned(row, pieces, limit, degrees)
                for i, j, r, c in cells_in(row, p.grid):
                    block, near = tile[r, c], around[widened(r, limit), widened(c, limit)]
                    measured = int((~np.isnan(block)).sum())
                    if whole_cells:
                        if measured < p.minimum_valid * block.size:
                            continue
                        values = best(block, near, max(1, math.ceil(p.minimum_valid * block.size)))
                        if values is None:
                            continue
                    else:
                        sums = overlap_sums(block, near)
                        values = down, across, *(np.full(side * side, v) for v in (block.size, measured)), sums[0].astype(np.int64), *sums[1:]
                    n = len(values[0])
                    fixed = [pa.array([row["surface_id"]] * n, pa.string()), *(pa.array(np.full(n, v), f.type) for v, f in zip((degrees, i, j), _BEST.remove(0), strict=False))]
                    out.append(pa.table([*fixed, *(pa.array(v, f.type) for v, f in zip(values, list(schema)[4:], strict=True))], schema=schema))
        return pa.concat_tables(out)

    return place


def registrations(subject: DataFrame, reference: DataFrame, side: int, p: SearchParameters, per_block: int = 8) -> DataFrame:
    """As ``placement.registrations``, of tables of tiles with one ``surface_id`` for each pair and fields of one shape.

    One shuffle brings a block of the subject's whole cells and what a block of angles reads of the
    reference around it to one task, which turns, places, and gives the best displacement of each cell at
    each angle. Both fields travel once for each ``per_block`` neighbouring angles. Cells larger than
    ``side`` are done in parts, whose (2 limit + 1)**2 sums at each angle are added by a second shuffle.
    """
    check_search(p)
    turns = angle_blocks(H.angles(p.rotation_range_deg, p.rotation_step_deg), per_block)
    small = (F.ceil(F.col("n_rows") / p.grid) <= side) & (F.ceil(F.col("n_cols") / p.grid) <= side)
    bounds, limit = blocks(p.grid, side), p.translation_limit

    def met(which, whole_cells: bool, ddl: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(len(turns) - 1))).alias("angle_block")
        own = pieces_around(subject.where(which), bounds, 0, 0).select("*", numbers)
        other = reference.where(which).select(*FIELD, *PLACE, "heights").mapInArrow(_parts(bounds, turns, limit, False), _PARTS_DDL)
        return own.groupBy(*KEY).cogroup(other.groupBy(*KEY)).applyInArrow(_placed(p, turns, whole_cells), ddl)

    cell = ["surface_id", "angle_deg", "cell_r", "cell_c"]
    sums = met(~small, False, _ADDED_DDL).groupBy(*cell, "down", "across").agg(*(F.sum(c).alias(c) for c in ("size", "measured", *SUMS)))
    enough = (F.col("measured") >= F.lit(p.minimum_valid) * F.col("size")) & (F.col("overlap") >= F.greatest(F.lit(1), F.ceil(F.lit(p.minimum_valid) * F.col("size"))))
    value = guarded_correlation(F.col("overlap"), *(F.col(c) for c in SUMS[1:]))
    rank = Window.partitionBy(*cell).orderBy(F.round("correlation", 12).desc(), "down", "across")
    added = sums.where(enough).withColumn("correlation", value).where("correlation IS NOT NULL").withColumn("_rank", F.row_number().over(rank)).where("_rank = 1")
    return met(small, True, _BEST_DDL).unionByName(added.select(*cell, "down", "across", "overlap", "correlation"))
