"""Forms fitted to fields in tiles: triangular factors that tasks merge, robust passes, and what is left.

A tile's equations become a triangle as wide as the form has terms. A task merges the triangles of its
tiles, a field's group those of the tasks, so that nothing grows with a field's samples; the solution
is that of the whole least-squares problem, orthogonal throughout. Reweighting sends coefficients and a
limit back to the tiles; the limit's medians are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions.heights import MAD_SCALE
from ..plans.scratch import cut
from ..sources.tiles import FIELD, PLACE, TILES_DDL, tile_batch, tiles_of
from .regions import medians

#: Fields whose triangles a task holds at once.
HELD = 4096


@dataclass(frozen=True)
class Polynomial:
    """All terms of total degree up to ``degree`` in coordinates divided by the field's extent."""

    degree: int

    @property
    def terms(self) -> int:
        return (self.degree + 1) * (self.degree + 2) // 2

    def equations(self, v: np.ndarray, u: np.ndarray, z: np.ndarray, extent: float) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([v**k * u ** (total - k) for total in range(self.degree + 1) for k in range(total + 1)], axis=-1), z

    def heights(self, v: np.ndarray, u: np.ndarray, extent: float, solution: np.ndarray) -> list[np.ndarray]:
        return [self.equations(v, u, v, extent)[0] @ solution]


@dataclass(frozen=True)
class Sphere:
    """v2 + u2 + z2 = 2av + 2bu + 2cz + k, in lengths divided by the field's extent; of both branches the one that fits better."""

    terms: int = 4

    def equations(self, v, u, z, extent):
        z = z / extent
        return np.stack([2 * v, 2 * u, 2 * z, np.ones(v.shape)], axis=-1), v * v + u * u + z * z

    def heights(self, v, u, extent, solution):
        a, b, c, k = solution
        inner = k + a * a + b * b + c * c - (v - a) ** 2 - (u - b) ** 2
        root = np.sqrt(np.where(inner < 0, np.nan, inner))
        return [(c - root) * extent, (c + root) * extent]


Form = Polynomial | Sphere


def _coordinates(row: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """Each sample's place down and across from the field's centre, divided by the extent, and the extent."""
    y = (row["top"] + np.arange(row["rows"]) - (row["n_rows"] - 1) / 2.0) * row["spacing_y"]
    x = (row["left"] + np.arange(row["cols"]) - (row["n_cols"] - 1) / 2.0) * row["spacing_x"]
    extent = max((row["n_rows"] - 1) / 2.0 * row["spacing_y"], (row["n_cols"] - 1) / 2.0 * row["spacing_x"]) or 1.0
    shape = row["rows"], row["cols"]
    return np.broadcast_to(y[:, None] / extent, shape), np.broadcast_to(x[None, :] / extent, shape), extent


def _system(h: np.ndarray, row: dict, form: Form) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The measured samples, and their equations."""
    v, u, extent = _coordinates(row)
    seen = ~np.isnan(h)
    return (seen, *form.equations(v[seen], u[seen], h[seen], extent))


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of equations and their right sides (or of triangles on top of each other)."""
    out = np.zeros((rows.shape[1], rows.shape[1]))
    if len(rows):
        r = np.linalg.qr(rows, mode="r")
        out[: len(r)] = r
    return out


def _factors(form: Form, tuning: float | None):
    """A task's triangle for each of its fields; weighted by the last solution's residuals where there is one."""
    schema = pa.schema([("surface_id", pa.string()), ("n", pa.int64()), ("factor", pa.list_(pa.float64()))])

    def given(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([f.ravel() for _, f in held.values()], schema.field(2).type)], schema=schema)

    def scan(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for h, row in tiles_of(batch):
                _, design, values = _system(h, row, form)
                rows = np.column_stack([design, values])
                if tuning is not None:
                    size = np.abs(values - design @ np.array(row["solution"]))
                    rows *= np.sqrt(np.where(size <= row["limit"], 1.0, row["limit"] / np.maximum(size, row["limit"])))[:, None]
                n, factor = held.get(row["surface_id"], (0, np.zeros((0, form.terms + 1))))
                held[row["surface_id"]] = n + len(rows), triangle(np.concatenate([factor, rows]))
            if len(held) > HELD:
                yield given(held)
                held = {}
        yield given(held)

    return scan


_FIT_DDL = "surface_id string, n long, solution array<double>"


def _solved(form: Form):
    schema = pa.schema([("surface_id", pa.string()), ("n", pa.int64()), ("solution", pa.list_(pa.float64()))])

    def solve(group: pa.Table) -> pa.Table:
        side = form.terms + 1
        factor = np.zeros((0, side))
        for one in group.column("factor").to_pylist():
            factor = triangle(np.concatenate([factor, np.array(one).reshape(side, side)]))
        n = sum(group.column("n").to_pylist())
        solution, _, rank, _ = np.linalg.lstsq(factor[:-1, :-1], factor[:-1, -1], rcond=np.finfo(float).eps * max(n, form.terms))
        return pa.table([group.column("surface_id")[:1], pa.array([n]), pa.array([solution if rank == form.terms else None], schema.field(2).type)], schema=schema)

    return solve


def _with(tiles: DataFrame, state: DataFrame) -> DataFrame:
    return tiles.select(*FIELD, *PLACE, "heights").join(state, "surface_id")


def _residuals(form: Form):
    def scan(batches):
        for batch in batches:
            for h, row in tiles_of(batch):
                seen, design, values = _system(h, row, form)
                out = np.full(h.shape, np.nan)
                out[seen] = values - design @ np.array(row["solution"])
                yield tile_batch([row], [out])

    return scan


def fitted(tiles: DataFrame, form: Form, tuning: float | None = None, passes: int | None = None) -> DataFrame:
    """(surface_id, n, solution) of each field's least-squares form; no solution where the samples don't determine it.

    ``passes`` reweight by Huber's rule: residuals beyond ``tuning`` normal deviations count in proportion
    less. A field whose residuals have no spread keeps its solution. One scan for a fit; for a pass, those
    of two exact medians and one more fit.
    """

    def solve(rows, tuned):
        factors = rows.mapInArrow(_factors(form, tuned), "surface_id string, n long, factor array<double>")
        return cut(factors.groupBy("surface_id").applyInArrow(_solved(form), _FIT_DDL))

    fits = solve(tiles.select(*FIELD, *PLACE, "heights"), None)
    for _ in range(passes or 0):
        known = fits.where("solution IS NOT NULL")
        left = cut(_with(tiles, known).mapInArrow(_residuals(form), TILES_DDL))
        off = _with(left, medians(left)).withColumn("heights", F.transform("heights", lambda h: F.abs(h - F.col("median"))))
        limits = medians(off).select("surface_id", (F.col("median") * (tuning * MAD_SCALE)).alias("limit")).where("limit > 0")
        again = solve(_with(tiles, known.join(limits, "surface_id").select("surface_id", "solution", "limit")), tuning)
        fits = cut(again.unionByName(fits.join(again.select("surface_id"), "surface_id", "left_anti")))
    return fits


def _errors(form: Form):
    """For each branch the squares that it leaves, and how many samples it doesn't span."""
    schema = pa.schema([("surface_id", pa.string()), ("branch", pa.int32()), ("error", pa.float64()), ("missed", pa.int64())])

    def scan(batches):
        for batch in batches:
            rows = []
            for h, row in tiles_of(batch):
                v, u, extent = _coordinates(row)
                if row["solution"] is not None:
                    rows += [(row["surface_id"], k, float(np.nansum((h - f) ** 2)), int(np.isnan(f).sum())) for k, f in enumerate(form.heights(v, u, extent, np.array(row["solution"])))]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scan


def level(tiles: DataFrame, form: Form, tuning: float | None = None, passes: int | None = None) -> DataFrame:
    """The tiles less their field's form.

    A field that doesn't determine the form is refused (``rank-deficient``), and so is one that the
    sphere doesn't span (``sphere-too-small``).
    """
    fits = fitted(tiles, form, tuning, passes).select("surface_id", "solution")
    judged = _with(tiles, fits).mapInArrow(_errors(form), "surface_id string, branch int, error double, missed long")
    branches = judged.groupBy("surface_id", "branch").agg(F.sum("error").alias("error"), F.sum("missed").alias("missed"))
    best = branches.groupBy("surface_id").agg(F.min(F.struct("error", "branch"))["branch"].alias("branch"), F.max("missed").alias("missed"))

    def scan(batches):
        for batch in batches:
            for h, row in tiles_of(batch):
                if row["solution"] is None:
                    raise Refusal("rank-deficient", f"the measured samples of {row['surface_id']} do not determine the form")
                if row["missed"]:
                    raise Refusal("sphere-too-small", f"the sphere fitted to {row['surface_id']} does not span the field")
                v, u, extent = _coordinates(row)
                yield tile_batch([row], [h - form.heights(v, u, extent, np.array(row["solution"]))[row["branch"]]])

    return _with(tiles, fits.join(best, "surface_id", "left")).mapInArrow(scan, TILES_DDL)
