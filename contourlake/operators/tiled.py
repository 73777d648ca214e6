"""Neighbourhood operators over tables of tiles: the same values as for fields in one row, at any size of field."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..errors import Refusal
from ..functions import heights as H
from ..sources.tiles import with_border


def _spacings(tiles: DataFrame, spacing: tuple[float, float] | None) -> tuple[float, float]:
    """The one spacing down and across that borders are measured in; other fields in the table are refused."""
    if spacing is not None:
        return spacing
    found = tiles.select("spacing_y", "spacing_x").distinct().limit(2).collect()
    if len(found) != 1:
        raise Refusal("several-spacings" if found else "no-field", "name the spacing, or do fields of each spacing by themselves")
    return tuple(found[0])


def _measured(h: np.ndarray) -> np.ndarray:
    return (~np.isnan(h)).astype(float)


def _same_spacing(row: dict, spacing: tuple[float, float]) -> None:
    if (row["spacing_y"], row["spacing_x"]) != tuple(spacing):
        raise Refusal("several-spacings", f"{row['surface_id']} has {row['spacing_y']}, {row['spacing_x']}")


def smooth(tiles: DataFrame, side: int, cutoff: float, spacing: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian mean of the measured samples in reach, absent where there is none.

    A border as wide as the kernel's half is exchanged once for both directions.
    """
    spacing = _spacings(tiles, spacing)
    down, across = (len(H.gaussian_kernel(cutoff, s)) // 2 for s in spacing)

    def of(h, row):
        _same_spacing(row, spacing)
        return H.smoothed(h, _measured(h), cutoff, *spacing)

    return with_border(tiles, side, down, across, of)


def bandpass(tiles: DataFrame, side: int, short: float, long: float, spacing: tuple[float, float] | None = None) -> DataFrame:
    """Smooth at ``short`` less smooth at ``long``, from one exchange of the wider border; absent samples stay absent."""
    spacing = _spacings(tiles, spacing)
    down, across = (len(H.gaussian_kernel(max(short, long), s)) // 2 for s in spacing)

    def of(h, row):
        _same_spacing(row, spacing)
        return H.bandpassed(h, short, long, *spacing)

    return with_border(tiles, side, down, across, of)


def trim_grow(tiles: DataFrame, side: int, down: int, across: int) -> DataFrame:
    """Samples within a rectangle around an absent one become absent."""
    return with_border(tiles, side, down, across, lambda h, _: np.where(H.grown_mask(h, down, across), np.nan, h))


def reject_local(tiles: DataFrame, side: int, criterion: str, threshold: float, down: int, across: int) -> DataFrame:
    """Samples further than ``threshold`` spreads from the centre of the rectangle around them become absent."""

    def of(h, _):
        centre, spread = H.centre_and_spread(h, criterion, (down, across))
        with np.errstate(invalid="ignore"):
            return np.where(np.abs(h - centre) > threshold * spread, np.nan, h)

    return with_border(tiles, side, down, across, of)
