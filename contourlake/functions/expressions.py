"""Column expressions of the data model; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micrometres in one of each unit of length.
MICROMETRES = {"nm": 0.001, "um": 1.0, "mm": 1000.0, "m": 1_000_000.0}


def micrometres(value: Column, unit: Column) -> Column:
    """A length in micrometres; an unknown unit gives null."""
    factors = F.create_map(*[x for u, f in MICROMETRES.items() for x in (F.lit(u), F.lit(f))])
    return value * F.try_element_at(factors, unit)


def centred(index: Column, size: Column, spacing: Column) -> Column:
    """Coordinate of a row or column, with the origin in the middle of the field."""
    return (index - (size - F.lit(1)) / F.lit(2.0)) * spacing


def part_of(index: Column, size: Column, parts: int) -> Column:
    """Which of ``parts`` nearly equal parts holds an index; the first size mod parts are one longer."""
    q, longer = F.floor(size / F.lit(parts)), size % F.lit(parts)
    cut = longer * (q + 1)
    return F.when(index < cut, F.floor(index / (q + 1))).otherwise(longer + F.floor((index - cut) / F.greatest(q, F.lit(1)))).cast("int")


def absent_where(condition: Column, height: Column) -> Column:
    """The height, absent (null) where the condition holds."""
    return F.when(~condition, height)


def guarded_correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, flat: float = 1e-12) -> Column:
    """Correlation from six sums; null where either side has no variance to speak of."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    ratio = (sxy - sx * sy / n) / F.sqrt(vx * vy)
    return F.when((n > 0) & (vx > sxx * flat) & (vy > syy * flat), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
