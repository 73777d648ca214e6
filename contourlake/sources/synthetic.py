"""Generated fields with known truth: bowl, striae, pin, groove, noise and lost edges.

A table of parameters (one row for each field) becomes a table of fields in one narrow pass, so any
number of fields is generated where it is used.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.heights import axes, frame_mask
from .surfaces import SURFACES, heights_array

COMPONENTS = 16
OTHER_SOURCE = 10_007


@dataclass(frozen=True)
class FieldParameters:
    rows: int = 256
    columns: int = 256
    pixel_spacing_um: float = 4.0
    striae_depth_um: float = 2.0
    striae_spacing_um: float = 40.0
    striae_angle_deg: float = 0.0
    form_depth_um: float = 12.0
    firing_pin_radius_um: float = 160.0
    firing_pin_depth_um: float = 25.0
    drag_mark_width_um: float = 30.0
    drag_mark_depth_um: float = 6.0
    drag_mark_position: float = 0.25
    noise_um: float = 0.2
    edge_dropout_fraction: float = 0.0
    seed: int = 0


def _striae(y, x, p: FieldParameters, source: int, shift: tuple[float, float], turn: float) -> np.ndarray:
    """Sixteen waves near one spacing, drawn from the source, along the turned and shifted normal."""
    a = math.radians(p.striae_angle_deg + turn)
    along = (x - shift[1] * p.pixel_spacing_um) * math.cos(a) + (y - shift[0] * p.pixel_spacing_um) * math.sin(a)
    rng = np.random.default_rng(source)
    detune, size, phase = rng.uniform(-0.08, 0.08, COMPONENTS), rng.uniform(0.3, 1.0, COMPONENTS), rng.uniform(0.0, 2 * math.pi, COMPONENTS)
    wave = sum(s * np.sin(2 * math.pi * (1 + d) / p.striae_spacing_um * along + f) for d, s, f in zip(detune, size, phase, strict=True))
    span = float(np.ptp(wave))
    return np.zeros_like(wave) if span == 0 else p.striae_depth_um * ((wave - wave.min()) / span - 0.5)


def generate(p: FieldParameters, source: int | None = None, shift: tuple[float, float] = (0.0, 0.0), turn: float = 0.0) -> np.ndarray:
    """Heights in micrometres; the shift (rows, columns) and turn move only the striae."""
    source = p.seed if source is None else source
    y, x = axes((p.rows, p.columns), p.pixel_spacing_um, p.pixel_spacing_um)
    rho = np.hypot(y, x)
    most = float(rho.max())
    h = p.form_depth_um * (rho / most) ** 2 if most else np.zeros(rho.shape)
    h = h + _striae(y, x, p, source, shift, turn)
    h = h - np.where(rho <= p.firing_pin_radius_um, p.firing_pin_depth_um, 0.0)
    groove = (p.drag_mark_position - 0.5) * p.rows * p.pixel_spacing_um
    h = h - np.where(np.abs(y - groove) <= p.drag_mark_width_um / 2, p.drag_mark_depth_um, 0.0)
    if p.noise_um > 0:
        h = h + np.random.default_rng((p.seed, source)).normal(0.0, p.noise_um, h.shape)
    lost = [round(n * p.edge_dropout_fraction) for n in h.shape]
    return np.where(frame_mask(h.shape, *lost), np.nan, h) if any(lost) else h


PARAMETERS = T.StructType(
    [T.StructField("surface_id", T.StringType())]
    + [T.StructField(n, T.LongType() if f in ("int", int) else T.DoubleType()) for n, f in FieldParameters.__annotations__.items()]
    + [T.StructField("source_id", T.LongType()), T.StructField("shift_rows", T.DoubleType()), T.StructField("shift_columns", T.DoubleType()), T.StructField("turn_deg", T.DoubleType())]
)


def row(surface_id: str, p: FieldParameters, source: int | None = None, shift: tuple[float, float] = (0.0, 0.0), turn: float = 0.0) -> tuple:
    values = [float(v) if isinstance(PARAMETERS[k].dataType, T.DoubleType) else int(v) for k, v in asdict(p).items()]
    return (surface_id, *values, p.seed if source is None else source, float(shift[0]), float(shift[1]), float(turn))


def matching(name: str, p: FieldParameters, shift=(3.0, -2.0), turn: float = 7.0) -> list[tuple]:
    """Parameters of two fields of one source, the second measured anew, moved and turned."""
    from dataclasses import replace

    return [row(f"{name}/subject", p), row(f"{name}/reference", replace(p, seed=p.seed + 1), p.seed, shift, turn)]


def non_matching(name: str, p: FieldParameters, other: int | None = None) -> list[tuple]:
    from dataclasses import replace

    return [row(f"{name}/subject", p), row(f"{name}/reference", replace(p, seed=p.seed + 1), p.seed + OTHER_SOURCE if other is None else other)]


def parameter_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PARAMETERS)


def generated(parameters: DataFrame) -> DataFrame:
    """The fields of a table of parameters."""
    kind = SURFACES["provenance"].dataType

    def scan(batches):
        names = list(FieldParameters.__annotations__)
        for batch in batches:
            rows = batch.to_pylist()
            fields = [generate(FieldParameters(**{n: r[n] for n in names}), r["source_id"], (r["shift_rows"], r["shift_columns"]), r["turn_deg"]) for r in rows]
            n = len(rows)
            spacing = pa.array([r["pixel_spacing_um"] for r in rows], pa.float64())
            empty = pa.array([[]] * n, pa.list_(pa.struct([(f.name, pa.string()) for f in kind.elementType])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["surface_id"] for r in rows], pa.string()), pa.array([f.shape[0] for f in fields], pa.int32()), pa.array([f.shape[1] for f in fields], pa.int32()), spacing, spacing, pa.array(["um"] * n), pa.array(["y-down"] * n), heights_array(fields), empty],
                names=SURFACES.names,
            )

    return parameters.mapInArrow(scan, SURFACES)
