"""Fields of any size as tables of tiles: no row, and no task, holds more than a tile and its surroundings.

``tiles``: surface_id, the field's shape and spacings, the tile's number down and across, where it
begins, its shape, and its heights row by row (null where absent). A tile has ``side`` rows and columns,
those at the field's far edges what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .surfaces import SHAPE, fields_of, heights_array

FIELD = ("surface_id", *SHAPE)
PLACE = ("tile_r", "tile_c", "top", "left", "rows", "cols")
KEY = ("surface_id", "tile_r", "tile_c")
FIELD_DDL = "surface_id string, n_rows int, n_cols int, spacing_y double, spacing_x double"
TILES_DDL = f"{FIELD_DDL}, tile_r int, tile_c int, top int, left int, rows int, cols int, heights array<double>"
_META = pa.schema([("surface_id", pa.string()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("spacing_y", pa.float64()), ("spacing_x", pa.float64()), *((n, pa.int32()) for n in PLACE)])
TILES = pa.schema([*_META, ("heights", pa.list_(pa.float64()))])
_PIECES = pa.schema([*_META, ("at_r", pa.int32()), ("at_c", pa.int32()), ("high", pa.int32()), ("wide", pa.int32()), ("piece", pa.binary())])
_PIECES_DDL = TILES_DDL.replace("heights array<double>", "at_r int, at_c int, high int, wide int, piece binary")


def place(row: dict, tile_r: int, tile_c: int, side: int) -> dict:
    """Where a tile of the row's field lies."""
    top, left = tile_r * side, tile_c * side
    return {"tile_r": tile_r, "tile_c": tile_c, "top": top, "left": left, "rows": min(side, row["n_rows"] - top), "cols": min(side, row["n_cols"] - left)}


def tiles_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict]]:
    """Heights (NaN where absent) and the other columns of each tile in a batch."""
    meta = batch.drop_columns(["heights"]).to_pylist()
    shapes = pa.RecordBatch.from_arrays([batch.column("heights"), batch.column("rows"), batch.column("cols")], names=["heights", "n_rows", "n_cols"])
    yield from zip(fields_of(shapes), meta, strict=True)


def tile_batch(rows: list[dict], heights: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[f.name] for r in rows], f.type) for f in _META), heights_array(heights)], schema=TILES)


def tiled(surfaces: DataFrame, side: int) -> DataFrame:
    """Tiles of fields that are a row each: one narrow pass."""

    def scan(batches):
        for batch in batches:
            meta = batch.drop_columns(["heights"]).to_pylist()
            for h, row in zip(fields_of(batch), meta, strict=True):
                places = [place(row, i, j, side) for i in range(-(-row["n_rows"] // side)) for j in range(-(-row["n_cols"] // side))]
                for p in places:
                    yield tile_batch([row | p], [h[p["top"] : p["top"] + p["rows"], p["left"] : p["left"] + p["cols"]]])

    return surfaces.select(*FIELD, "heights").mapInArrow(scan, TILES_DDL)


def tiled_rows(rows: DataFrame, side: int) -> DataFrame:
    """Tiles of fields given by rows: the field's columns, ``r`` and ``values``, each row of a field once.

    A row is sliced where it lies; a group is one tile's ``side`` slices, whatever the field's size.
    """
    cut = rows.select(*FIELD, "r", "values", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_cols") - 1) / side).cast("int"))).alias("tile_c"))
    cut = cut.select(*FIELD, F.floor(F.col("r") / side).cast("int").alias("tile_r"), "tile_c", "r", F.slice("values", F.col("tile_c") * side + 1, F.lit(side)).alias("piece"))
    held = cut.groupBy(*FIELD, "tile_r", "tile_c").agg(F.array_sort(F.collect_list(F.struct("r", "piece"))).alias("_rows"))
    top, left = F.col("tile_r") * side, F.col("tile_c") * side
    return held.select(*FIELD, "tile_r", "tile_c", top.alias("top"), left.alias("left"), F.size("_rows").alias("rows"), F.least(F.lit(side), F.col("n_cols") - left).alias("cols"), F.flatten("_rows.piece").alias("heights"))


def tile_samples(tiles: DataFrame) -> DataFrame:
    """``samples`` of a table of tiles. A narrow operation."""
    out = tiles.select(*FIELD, "top", "left", "cols", F.posexplode("heights").alias("_at", "h"))
    return out.select("surface_id", (F.col("top") + F.floor(F.col("_at") / F.col("cols"))).cast("int").alias("r"), (F.col("left") + F.col("_at") % F.col("cols")).cast("int").alias("c"), "h", *SHAPE)


def mapped_tiles(tiles: DataFrame, of: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Each tile's heights replaced by what ``of(heights, row)`` makes of it, in one pass."""

    def scan(batches):
        for batch in batches:
            for h, row in tiles_of(batch):
                yield tile_batch([row], [of(h, row)])

    return tiles.select(*FIELD, *PLACE, "heights").mapInArrow(scan, TILES_DDL)


Bounds = Callable[[int], list[int]]


def every(side: int) -> Bounds:
    """Where the tiles of so many rows (or columns) begin, and where the last one ends."""
    return lambda n: [*range(0, n, side), n]


def _around(bounds: Bounds, down: int, across: int):
    """The parts of each tile that lie in a block of ``bounds`` or in its border ``down`` and ``across`` wide, keyed by that block."""

    def met(edges: list[int], low: int, high: int) -> range:
        first, last = np.searchsorted(edges, (low, high - 1), "right") - 1
        return range(max(0, int(first)), min(len(edges) - 2, int(last)) + 1)

    def scan(batches):
        for batch in batches:
            for h, row in tiles_of(batch):
                out: dict[str, list] = {n: [] for n in _PIECES.names}
                r, q = bounds(row["n_rows"]), bounds(row["n_cols"])
                for i in met(r, row["top"] - down, row["top"] + row["rows"] + down):
                    for j in met(q, row["left"] - across, row["left"] + row["cols"] + across):
                        to = row | {"tile_r": i, "tile_c": j, "top": r[i], "left": q[j], "rows": r[i + 1] - r[i], "cols": q[j + 1] - q[j]}
                        a, b = max(row["top"], to["top"] - down), min(row["top"] + row["rows"], to["top"] + to["rows"] + down)
                        c, d = max(row["left"], to["left"] - across), min(row["left"] + row["cols"], to["left"] + to["cols"] + across)
                        part = h[a - row["top"] : b - row["top"], c - row["left"] : d - row["left"]]
                        for name, value in (to | {"at_r": a, "at_c": c, "high": b - a, "wide": d - c, "piece": np.ascontiguousarray(part).tobytes()}).items():
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PIECES], schema=_PIECES)

    return scan


def pieces_around(tiles: DataFrame, bounds: Bounds, down: int, across: int) -> DataFrame:
    """For each block of a field the pieces, its own ones too, that make it up with its border."""
    return tiles.select(*FIELD, *PLACE, "heights").mapInArrow(_around(bounds, down, across), _PIECES_DDL)


_PACKED = pa.schema([("surface_id", pa.string()), ("tile_r", pa.int32()), ("tile_c", pa.int32()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), *((n, pa.binary()) for n in ("starts", "lengths", "values"))])
_PACKED_DDL = "surface_id string, tile_r int, tile_c int, n_rows int, n_cols int, starts binary, lengths binary, values binary"


def _packed(side: int, border: int):
    width = side + 2 * border

    def scan(batches):
        for batch in batches:
            names = batch.column("surface_id").dictionary_encode()
            code, r, c, rows, cols = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names.indices, *(batch.column(n) for n in ("r", "c", "n_rows", "n_cols"))))
            h = batch.column("h").to_numpy(zero_copy_only=False).astype(np.float64)
            for i in range(-(-2 * border // side) + 1):
                for j in range(-(-2 * border // side) + 1):
                    tile_r, tile_c = (r - border) // side + i, (c - border) // side + j
                    met = np.flatnonzero((tile_r >= 0) & (tile_c >= 0) & (tile_r <= (r + border) // side) & (tile_c <= (c + border) // side))
                    at = (r - tile_r * side + border) * width + c - tile_c * side + border
                    met = met[np.lexsort((at[met], tile_c[met], tile_r[met], code[met]))]
                    if not met.size:
                        continue
                    apart = np.any([np.diff(x[met]) != 0 for x in (code, tile_r, tile_c)], axis=0)
                    ends = np.append(np.flatnonzero(apart) + 1, met.size)
                    runs = np.append(0, np.flatnonzero(apart | (np.diff(at[met]) != 1)) + 1)
                    lengths, first = np.diff(np.append(runs, met.size)), np.append(0, ends[:-1])
                    starts, own = at[met[runs]].astype(np.int32), np.searchsorted(runs, np.append(first, met.size))
                    keys = met[first]
                    binary = [[starts[a:b].tobytes() for a, b in zip(own, own[1:], strict=False)], [lengths[a:b].astype(np.int32).tobytes() for a, b in zip(own, own[1:], strict=False)], [h[met[a:b]].tobytes() for a, b in zip(first, ends, strict=True)]]
                    columns = [names.dictionary.take(pa.array(code[keys])), *(x[keys] for x in (tile_r, tile_c, rows, cols)), *binary]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)

    return scan


def packed(samples: DataFrame, side: int, border: int = 0) -> DataFrame:
    """For each tile of ``side`` the samples in it and ``border`` around it, as runs of values, a row or more for each tile. A narrow operation.

    Samples may lie in any order; those of a field next to each other travel as 8 bytes each.
    """
    return samples.where("surface_id IS NOT NULL").select("surface_id", "r", "c", "n_rows", "n_cols", F.col("h").cast("double").alias("h")).mapInArrow(_packed(side, border), _PACKED_DDL)


def unpacked(pieces: pa.Table, side: int, border: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A tile with its border, NaN where absent, and which samples were given, from what ``packed`` made of it."""
    width = side + 2 * border
    h, given = np.full(width * width, np.nan), np.zeros(width * width, bool)
    for starts, lengths, values in zip(*(pieces.column(n).to_pylist() for n in ("starts", "lengths", "values")), strict=True):
        lengths = np.frombuffer(lengths, np.int32).astype(np.int64)
        at = np.arange(lengths.sum()) + np.repeat(np.frombuffer(starts, np.int32) - np.cumsum(lengths) + lengths, lengths)
        h[at], given[at] = np.frombuffer(values), True
    return h.reshape(width, width), given.reshape(width, width)


def bordered(row: dict, pieces: list[dict], down: int, across: int, whole: bool = False) -> np.ndarray:
    """A tile with its border from its pieces: as far as the field goes, or ``whole``, absent beyond it."""
    top, left = row["top"] - down, row["left"] - across
    if not whole:
        top, left = max(0, top), max(0, left)
    bottom, right = row["top"] + row["rows"] + down, row["left"] + row["cols"] + across
    h = np.full(((bottom if whole else min(row["n_rows"], bottom)) - top, (right if whole else min(row["n_cols"], right)) - left), np.nan)
    for p in pieces:
        h[p["at_r"] - top : p["at_r"] - top + p["high"], p["at_c"] - left : p["at_c"] - left + p["wide"]] = np.frombuffer(p["piece"]).reshape(p["high"], p["wide"])
    return h


def with_border(tiles: DataFrame, side: int, down: int, across: int, of: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Each tile's heights replaced by what ``of`` makes of the tile with its border, cut to the tile.

    ``of(heights, row)`` gets the tile with ``down`` rows and ``across`` columns around it, as far as the
    field goes, and gives an array of that shape; a result that depends on no sample further away is the
    whole field's. One shuffle: each tile goes to its own key whole and to its neighbours as strips, so
    (side + 2 down)(side + 2 across) / side**2 times the field's bytes. A task holds one tile with its
    border, as pieces and as an array: 16 bytes for each of its samples, and what ``of`` needs.
    """

    def assembled(group: pa.Table) -> pa.Table:
        pieces = group.to_pylist()
        row = pieces[0]
        r, c = min(down, row["top"]), min(across, row["left"])
        out = of(bordered(row, pieces, down, across), row)
        return pa.Table.from_batches([tile_batch([row], [out[r : r + row["rows"], c : c + row["cols"]]])])

    return pieces_around(tiles, every(side), down, across).groupBy(*KEY).applyInArrow(assembled, TILES_DDL)
