"""Masks and rejections over ``samples``, in DataFrame operations only: predicates, windows and one stencil."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import absent_where, centred


def y_of() -> Column:
    return centred(F.col("r"), F.col("n_rows"), F.col("spacing_y"))


def x_of() -> Column:
    return centred(F.col("c"), F.col("n_cols"), F.col("spacing_x"))


def reach(width: float, spacing: str) -> Column:
    """A length in whole samples, halves to even; refused if it is none."""
    n = F.rint(F.lit(width) / F.col(spacing)).cast("int")
    return F.when(n >= 1, n).otherwise(F.raise_error(F.lit("narrower-than-a-sample")).cast("int"))


def trim_frame(samples: DataFrame, width: float) -> DataFrame:
    d, a = reach(width, "spacing_y"), reach(width, "spacing_x")
    edge = (F.col("r") < d) | (F.col("r") >= F.col("n_rows") - d) | (F.col("c") < a) | (F.col("c") >= F.col("n_cols") - a)
    return samples.withColumn("h", absent_where(edge, F.col("h")))


def trim_grow(samples: DataFrame, down: int, across: int) -> DataFrame:
    """Samples within a rectangle around an absent one become absent: a maximum along columns, then along rows.

    The two windows are over one column or row of one field, so partitions stay small.
    """
    near = samples.withColumn("_gone", F.col("h").isNull().cast("int"))
    for keys, order, n in ((("surface_id", "c"), "r", down), (("surface_id", "r"), "c", across)):
        near = near.withColumn("_gone", F.max("_gone").over(Window.partitionBy(*keys).orderBy(order).rangeBetween(-n, n)))
    return near.withColumn("h", absent_where(F.col("_gone") == 1, F.col("h"))).drop("_gone")


def band(width: float, position: float, angle_deg: float) -> Column:
    a = math.radians(angle_deg)
    return F.abs(y_of() * math.cos(a) - x_of() * math.sin(a) - position) <= width / 2


def disc(centre_y: float, centre_x: float, radius: float) -> Column:
    return F.sqrt((y_of() - centre_y) * (y_of() - centre_y) + (x_of() - centre_x) * (x_of() - centre_x)) <= radius


def mask(samples: DataFrame, region: Column) -> DataFrame:
    return samples.withColumn("h", absent_where(region, F.col("h")))


def mask_counts(samples: DataFrame, **regions: Column) -> DataFrame:
    """How many measured samples each region takes."""
    seen = F.col("h").isNotNull()
    return samples.groupBy("surface_id").agg(*(F.count_if(seen & region).alias(name) for name, region in regions.items()))


def reject_global(samples: DataFrame, criterion: str, threshold: float) -> DataFrame:
    """Samples further than ``threshold`` spreads from the field's centre become absent.

    Centre and spread are aggregates of each field joined back on surface_id; of medians, both are exact.
    """
    if criterion == "median-absolute-deviation":
        centre = samples.groupBy("surface_id").agg(F.median("h").alias("_centre"))
        spread = samples.join(centre, "surface_id").groupBy("surface_id", "_centre").agg(F.median(F.abs(F.col("h") - F.col("_centre"))).alias("_spread"))
    else:
        spread = samples.groupBy("surface_id").agg(F.avg("h").alias("_centre"), F.stddev_pop("h").alias("_spread"))
    far = F.abs(F.col("h") - F.col("_centre")) > F.lit(threshold) * F.col("_spread")
    return samples.join(spread, "surface_id").withColumn("h", absent_where(F.coalesce(far, F.lit(False)), F.col("h"))).drop("_centre", "_spread")


def level_plane(samples: DataFrame) -> DataFrame:
    """The least-squares plane of the measured samples subtracted, from nine sums of each field."""
    seen = samples.where("h IS NOT NULL").select("surface_id", y_of().alias("y"), x_of().alias("x"), "h")
    y, x, h = F.col("y"), F.col("x"), F.col("h")
    sums = seen.groupBy("surface_id").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.avg("h").alias("mh"), F.sum(y * y).alias("yy"), F.sum(x * x).alias("xx"), F.sum(y * x).alias("yx"), F.sum(y * h).alias("yh"), F.sum(x * h).alias("xh"))
    centred_sums = sums.selectExpr("surface_id", "my", "mx", "mh", "yy - n * my * my AS yy", "xx - n * mx * mx AS xx", "yx - n * my * mx AS yx", "yh - n * my * mh AS yh", "xh - n * mx * mh AS xh")
    solved = centred_sums.selectExpr("surface_id", "my", "mx", "mh", "(yh * xx - xh * yx) / (yy * xx - yx * yx) AS a", "(xh * yy - yh * yx) / (yy * xx - yx * yx) AS b")
    plane = F.col("mh") + F.col("a") * (y_of() - F.col("my")) + F.col("b") * (x_of() - F.col("mx"))
    return samples.join(solved, "surface_id").withColumn("h", F.col("h") - plane).drop("my", "mx", "mh", "a", "b")
