"""Preprocessing steps: parameter records, the registry, order checking and execution of chains.

A chain is checked whole on the driver and then runs as one narrow pass over a table of fields, each
step on each field in turn; every step appends a record to the field's provenance.
"""

from __future__ import annotations

import dataclasses
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from enum import Enum
from typing import Any, ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import Refusal, number, one_of, whole
from ..functions import heights as H
from ..sources.surfaces import fields_of, heights_array


class Property(Enum):
    EDGES_TRIMMED = "edges-trimmed"
    MASKED = "masked"
    OUTLIERS_MARKED = "outliers-marked"
    LEVELLED = "levelled"
    FILTERED = "filtered"


@dataclass(frozen=True)
class Field:
    """A field on an executor: heights with NaN for absent samples, and its spacings."""

    h: np.ndarray
    spacing_y: float
    spacing_x: float

    @property
    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        return H.axes(self.h.shape, self.spacing_y, self.spacing_x)

    def without(self, mask: np.ndarray, step: str) -> np.ndarray:
        if np.isnan(self.h).all():
            raise Refusal("nothing-measured", step)
        out = np.where(mask, np.nan, self.h)
        if np.isnan(out).all():
            raise Refusal("nothing-left", step)
        return out


class Step(Protocol):
    """What the registry holds: a named, versioned transform of one field."""

    identifier: ClassVar[str]
    version: ClassVar[str]
    parameters: ClassVar[type]
    produces: ClassVar[frozenset[Property]]
    requires: ClassVar[frozenset[Property]]
    refuses: ClassVar[frozenset[Property]]

    def check(self, p: Any) -> None: ...

    def apply(self, field: Field, p: Any) -> tuple[np.ndarray, dict[str, Any]]: ...


_UNFILTERED = frozenset({Property.FILTERED})


@dataclass(frozen=True)
class EdgeParameters:
    width: float
    criterion: str


class TrimEdge:
    """Samples near the frame, or near absent samples, become absent."""

    identifier, version, parameters = "trim-edge", "1", EdgeParameters
    produces, requires, refuses = frozenset({Property.EDGES_TRIMMED}), frozenset(), _UNFILTERED

    def check(self, p: EdgeParameters) -> None:
        number(p.width, "width", above=0)
        one_of(p.criterion, "criterion", ("frame", "grow"))

    def apply(self, field: Field, p: EdgeParameters):
        down, across = (H.samples_within(p.width, s) for s in (field.spacing_y, field.spacing_x))
        mask = H.frame_mask(field.h.shape, down, across) if p.criterion == "frame" else H.grown_mask(field.h, down, across)
        return field.without(mask, self.identifier), {}


@dataclass(frozen=True)
class MarkParameters:
    drag_width: float
    drag_position: float
    drag_angle_deg: float
    exclude_drag: bool
    extractor_radius: float
    extractor_distance: float
    extractor_angle_deg: float
    exclude_extractor: bool


class MaskMarks:
    """A drag band and an extractor disc become absent, as far as they are to be excluded."""

    identifier, version, parameters = "mask-marks", "1", MarkParameters
    produces, requires, refuses = frozenset({Property.MASKED}), frozenset(), _UNFILTERED

    def check(self, p: MarkParameters) -> None:
        number(p.drag_width, "drag_width", above=0)
        number(p.extractor_radius, "extractor_radius", above=0)
        number(p.extractor_distance, "extractor_distance", least=0)
        for name in ("drag_position", "drag_angle_deg", "extractor_angle_deg"):
            number(getattr(p, name), name)
        for name in ("exclude_drag", "exclude_extractor"):
            if not isinstance(getattr(p, name), bool):
                raise Refusal("not-a-flag", name)

    def apply(self, field: Field, p: MarkParameters):
        y, x = field.axes
        a = math.radians(p.extractor_angle_deg)
        band = H.band_mask(y, x, p.drag_width, p.drag_position, p.drag_angle_deg)
        disc = H.disc_mask(y, x, p.extractor_distance * math.cos(a), p.extractor_distance * math.sin(a), p.extractor_radius)
        seen = ~np.isnan(field.h)
        counts = {"drag_samples": int((band & seen).sum()), "extractor_samples": int((disc & seen).sum())}
        mask = np.zeros(field.h.shape, bool)
        for wanted, region, count in ((p.exclude_drag, band, "drag_samples"), (p.exclude_extractor, disc, "extractor_samples")):
            if wanted:
                if not counts[count]:
                    raise Refusal("mask-covers-nothing", count)
                mask |= region
        return field.without(mask, self.identifier), counts


@dataclass(frozen=True)
class PinParameters:
    method: str
    declared_centre_y: float | None
    declared_centre_x: float | None
    declared_radius: float | None
    depth_threshold: float | None
    dilation: float


class MaskPin:
    """A round impression becomes absent, where it is declared or detected to be."""

    identifier, version, parameters = "mask-firing-pin", "1", PinParameters
    produces, requires, refuses = frozenset({Property.MASKED}), frozenset(), _UNFILTERED

    def check(self, p: PinParameters) -> None:
        one_of(p.method, "method", ("fixed", "detected"))
        number(p.dilation, "dilation", least=0)
        declared = (p.declared_centre_y, p.declared_centre_x, p.declared_radius)
        if p.method == "fixed":
            if p.depth_threshold is not None:
                raise Refusal("unused-parameter", "depth_threshold")
            number(p.declared_centre_y, "declared_centre_y")
            number(p.declared_centre_x, "declared_centre_x")
            number(p.declared_radius, "declared_radius", above=0)
        else:
            if any(v is not None for v in declared):
                raise Refusal("unused-parameter", "declared circle")
            number(p.depth_threshold, "depth_threshold", above=0)

    def apply(self, field: Field, p: PinParameters):
        if np.isnan(field.h).all():
            raise Refusal("nothing-measured", self.identifier)
        y, x = field.axes
        if p.method == "fixed":
            circle = (p.declared_centre_y, p.declared_centre_x, p.declared_radius)
        else:
            circle = H.detected_pin(field.h, y, x, p.depth_threshold, field.spacing_y, field.spacing_x)
        mask = H.disc_mask(y, x, circle[0], circle[1], circle[2] + p.dilation)
        taken = int((mask & ~np.isnan(field.h)).sum())
        if not taken:
            raise Refusal("mask-covers-nothing", self.identifier)
        names = ("centre_y", "centre_x", "radius", "masked_radius", "masked_samples")
        return field.without(mask, self.identifier), dict(zip(names, (*circle, circle[2] + p.dilation, taken), strict=True))


@dataclass(frozen=True)
class OutlierParameters:
    criterion: str
    threshold: float
    neighbourhood: float | None


class RejectOutliers:
    """Samples too far from the centre, of the field or of their neighbourhood, become absent."""

    identifier, version, parameters = "reject-outliers", "1", OutlierParameters
    produces, requires, refuses = frozenset({Property.OUTLIERS_MARKED}), frozenset(), _UNFILTERED

    def check(self, p: OutlierParameters) -> None:
        one_of(p.criterion, "criterion", ("median-absolute-deviation", "standard-deviation"))
        number(p.threshold, "threshold", above=0)
        if p.neighbourhood is not None:
            number(p.neighbourhood, "neighbourhood", above=0)

    def apply(self, field: Field, p: OutlierParameters):
        if np.isnan(field.h).all():
            raise Refusal("nothing-measured", self.identifier)
        reach = None if p.neighbourhood is None else tuple(H.samples_within(p.neighbourhood, s, "neighbourhood") for s in (field.spacing_y, field.spacing_x))
        centre, spread = H.centre_and_spread(field.h, p.criterion, reach)
        seen = ~np.isnan(field.h)
        with np.errstate(invalid="ignore"):
            mask = seen & (np.abs(field.h - centre) > p.threshold * spread)
        return field.without(mask, self.identifier), {"rejected_samples": int(mask.sum()), "measured_samples": int(seen.sum())}


@dataclass(frozen=True)
class LevelParameters:
    model: str
    order: int | None
    robust_tuning: float | None
    robust_passes: int | None


def _robust(tuning, passes) -> None:
    if (tuning is None) != (passes is None):
        raise Refusal("half-robust", "robust_tuning and robust_passes go together")
    if tuning is not None:
        number(tuning, "robust_tuning", above=0)
        whole(passes, "robust_passes", least=1)


class RemoveForm:
    """A fitted plane, polynomial or sphere is subtracted."""

    identifier, version, parameters = "level", "1", LevelParameters
    produces, requires, refuses = frozenset({Property.LEVELLED}), frozenset(), _UNFILTERED

    def check(self, p: LevelParameters) -> None:
        one_of(p.model, "model", ("plane", "polynomial", "sphere"))
        if p.model == "polynomial":
            whole(p.order, "order", least=2)
        elif p.order is not None:
            raise Refusal("unused-parameter", "order")
        _robust(p.robust_tuning, p.robust_passes)

    def apply(self, field: Field, p: LevelParameters):
        if np.isnan(field.h).all():
            raise Refusal("nothing-measured", self.identifier)
        y, x = field.axes
        robust = (p.robust_tuning, p.robust_passes)
        form = H.sphere_form(field.h, y, x, *robust) if p.model == "sphere" else H.polynomial_form(field.h, y, x, p.order or 1, *robust)
        return field.h - form, {}


@dataclass(frozen=True)
class BandParameters:
    short_cutoff: float
    long_cutoff: float
    robust_tuning: float | None
    robust_passes: int | None


class Bandpass:
    """Difference of two Gaussian means that absent samples don't take part in."""

    identifier, version, parameters = "bandpass", "1", BandParameters
    produces, requires, refuses = frozenset({Property.FILTERED}), frozenset(), frozenset()

    def check(self, p: BandParameters) -> None:
        number(p.short_cutoff, "short_cutoff", above=0)
        number(p.long_cutoff, "long_cutoff", above=0)
        if p.short_cutoff >= p.long_cutoff:
            raise Refusal("cutoffs-out-of-order", f"{p.short_cutoff} and {p.long_cutoff}")
        _robust(p.robust_tuning, p.robust_passes)

    def apply(self, field: Field, p: BandParameters):
        if np.isnan(field.h).all():
            raise Refusal("nothing-measured", self.identifier)
        return H.bandpassed(field.h, p.short_cutoff, p.long_cutoff, field.spacing_y, field.spacing_x, p.robust_tuning, p.robust_passes), {}


class Registry:
    """Steps by identifier, each admitted once and only with a sound declaration."""

    def __init__(self, steps: Iterable[Step] = ()):
        self._steps: dict[str, Step] = {}
        for step in steps:
            self.register(step)

    def register(self, step: Step) -> None:
        if not step.identifier or not step.version:
            raise Refusal("unnamed-step", repr(step))
        if step.identifier in self._steps:
            raise Refusal("registered-twice", step.identifier)
        check_record(step.parameters)
        for properties in (step.produces, step.requires, step.refuses):
            if not isinstance(properties, frozenset) or not all(isinstance(x, Property) for x in properties):
                raise Refusal("not-properties", step.identifier)
        if step.requires & step.refuses or step.produces & step.refuses:
            raise Refusal("contradicts-itself", step.identifier)
        self._steps[step.identifier] = step

    def __getitem__(self, identifier: str) -> Step:
        if identifier not in self._steps:
            raise Refusal("unknown-step", identifier)
        return self._steps[identifier]

    def __iter__(self) -> Iterator[Step]:
        return iter(self._steps[k] for k in sorted(self._steps))

    def __contains__(self, identifier: str) -> bool:
        return identifier in self._steps


def check_record(record: type) -> None:
    """A parameter record is a frozen dataclass with fields and without defaults."""
    if not (dataclasses.is_dataclass(record) and record.__dataclass_params__.frozen):
        raise Refusal("not-a-frozen-record", record.__name__)
    fields = dataclasses.fields(record)
    if not fields or any(f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING for f in fields):
        raise Refusal("record-with-defaults", record.__name__)


STEPS = Registry([TrimEdge(), MaskMarks(), MaskPin(), RejectOutliers(), RemoveForm(), Bandpass()])


@dataclass(frozen=True)
class Applied:
    """A step by identifier with its parameters."""

    identifier: str
    parameters: Any


def check_chain(chain: list[Applied], registry: Registry = STEPS) -> dict[Property, str]:
    """Refuses an impossible chain; gives the first step that establishes each property."""
    if not chain:
        raise Refusal("empty-chain")
    established: dict[Property, str] = {}
    for applied in chain:
        step = registry[applied.identifier]
        if type(applied.parameters) is not step.parameters:
            raise Refusal("wrong-record", applied.identifier)
        step.check(applied.parameters)
        if missing := step.requires - established.keys():
            raise Refusal("too-early", f"{applied.identifier} needs {sorted(p.value for p in missing)}")
        if spoiled := step.refuses & established.keys():
            raise Refusal("too-late", f"{applied.identifier} after {sorted(established[p] for p in spoiled)}")
        for p in step.produces:
            established.setdefault(p, applied.identifier)
    return established


def compact(value: Any) -> str:
    return json.dumps(value, sort_keys=True)


def apply_chain(field: Field, chain: list[Applied], registry: Registry = STEPS) -> tuple[Field, list[dict[str, str]]]:
    """All steps on one field, with their records."""
    records = []
    for applied in chain:
        step = registry[applied.identifier]
        h, outcomes = step.apply(field, applied.parameters)
        field = Field(h, field.spacing_y, field.spacing_x)
        records.append({"name": step.identifier, "version": step.version, "parameters": compact(dataclasses.asdict(applied.parameters)), "outcomes": compact(outcomes)})
    return field, records


def run_chain(surfaces: DataFrame, chain: list[Applied], registry: Registry = STEPS) -> DataFrame:
    """The fields after the chain, each with one more provenance record for each step; no shuffle."""
    check_chain(chain, registry)

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out, provenance = [], []
            before = batch.column("provenance").to_pylist()
            for h, sy, sx, held in zip(fields_of(batch), batch.column("spacing_y").to_pylist(), batch.column("spacing_x").to_pylist(), before, strict=True):
                field, records = apply_chain(Field(h, sy, sx), chain, registry)
                out.append(field.h)
                provenance.append([*(held or []), *records])
            new = {"heights": heights_array(out), "provenance": pa.array(provenance, batch.schema.field("provenance").type)}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return surfaces.mapInArrow(scan, surfaces.schema)
