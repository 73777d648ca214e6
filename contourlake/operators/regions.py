"""Connected regions, holes and exact medians of fields in tiles.

A tile's samples are labelled where they lie. Labels that meet at a line between tiles are joined by
the line's samples, and the pairs of labels by stars of the least label (large and small ones in turn),
so that neither a region nor a field is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heights import labelled
from ..plans.scratch import cut
from ..sources.tiles import FIELD, KEY, PLACE, TILES_DDL, tile_batch, tiles_of

Mask = Callable[[np.ndarray, dict], np.ndarray]

#: What is seen of a tile's labels: a part of a region, or a sample at a horizontal or vertical line between tiles.
PART, ACROSS, DOWN = 0, 1, 2
_SEEN = pa.schema([("surface_id", pa.string()), ("kind", pa.int32()), ("tile_r", pa.int32()), ("tile_c", pa.int32()), ("line", pa.int32()), ("at", pa.int32()), ("beyond", pa.bool_()), ("id", pa.int64()), ("size", pa.int64()), ("sum_r", pa.int64()), ("sum_c", pa.int64()), ("at_edge", pa.bool_())])
_SEEN_DDL = "surface_id string, kind int, tile_r int, tile_c int, line int, at int, beyond boolean, id long, size long, sum_r long, sum_c long, at_edge boolean"


def numbered(mask: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Labels within a tile, and for each from 0 its id: the place of its first sample in the field, row by row (-1 for none)."""
    label = labelled(mask)
    known, first = np.unique(label, return_index=True)
    ids = np.full(int(label.max(initial=0)) + 1, -1, np.int64)
    r, c = np.divmod(first, mask.shape[1])
    ids[known] = (row["top"] + r) * row["n_cols"] + row["left"] + c
    ids[0] = -1
    return label, ids


def _seen(mask_of: Mask):
    def lines(row, ids):
        """The tile's sides that other tiles touch: kind, line between rows or columns, first place on it, which side of it, ids."""
        if row["top"]:
            yield ACROSS, row["top"], row["left"], True, ids[0]
        if row["top"] + row["rows"] < row["n_rows"]:
            yield ACROSS, row["top"] + row["rows"], row["left"], False, ids[-1]
        if row["left"]:
            yield DOWN, row["left"], row["top"], True, ids[:, 0]
        if row["left"] + row["cols"] < row["n_cols"]:
            yield DOWN, row["left"] + row["cols"], row["top"], False, ids[:, -1]

    def scan(batches):
        for batch in batches:
            for h, row in tiles_of(batch):
                label, ids = numbered(mask_of(h, row), row)
                out: dict[str, list[np.ndarray]] = {n: [] for n in _SEEN.names[1:]}

                def put(n, out=out, row=row, **values):
                    rest = {"tile_r": row["tile_r"], "tile_c": row["tile_c"], "line": 0, "at": 0, "beyond": False, "size": 0, "sum_r": 0, "sum_c": 0, "at_edge": False}
                    for name, value in (rest | values).items():
                        out[name].append(np.broadcast_to(value, n))

                r, c = np.nonzero(label)
                flat, n = label[r, c], len(ids)
                edge = (row["top"] + r == 0) | (row["left"] + c == 0) | (row["top"] + r == row["n_rows"] - 1) | (row["left"] + c == row["n_cols"] - 1)
                size, rs, cs, es = (np.bincount(flat, w, n)[1:].astype(np.int64) for w in (None, r, c, edge))
                put(n - 1, kind=PART, id=ids[1:], size=size, sum_r=rs + size * row["top"], sum_c=cs + size * row["left"], at_edge=es > 0)
                for kind, line, first, beyond, side in lines(row, ids[label]):
                    at = np.flatnonzero(side >= 0)
                    put(len(at), kind=kind, line=line, at=first + at, beyond=beyond, id=side[at])
                columns = [np.concatenate(out[n]) for n in _SEEN.names[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([row["surface_id"]] * len(columns[0]), pa.string()), *(pa.array(v, _SEEN.field(k + 1).type) for k, v in enumerate(columns))], schema=_SEEN)

    return scan


def joined(links: DataFrame) -> DataFrame:
    """(surface_id, id, root) of every id in links (surface_id, a, b): the least id that links lead to; roots aren't listed.

    Each round costs two joins whose one side has unique keys; rounds grow with the logarithm of a
    chain's length. The driver sees two numbers a round.
    """
    edges = links.where("a <> b").select("surface_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        both = edges.select("surface_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select("surface_id", F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("surface_id", "u").agg(F.min("v").alias("m")).select("surface_id", "u", F.least("m", "u").alias("m"))
        large = both.join(least, ["surface_id", "u"]).where("v > u").select("surface_id", F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        centre = large.groupBy("surface_id", "a").agg(F.min("b").alias("m"))
        near = large.join(centre, ["surface_id", "a"])
        small = near.where("b <> m").select("surface_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("surface_id", "a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("surface_id", "a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select("surface_id", F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def _parts(tiles: DataFrame, mask_of: Mask) -> DataFrame:
    """Each tile's parts of regions, with ``region``: the place of the whole region's first sample."""
    seen = cut(tiles.select(*FIELD, *PLACE, "heights").mapInArrow(_seen(mask_of), _SEEN_DDL))
    line = ["surface_id", "kind", "line", "at"]
    one, other = (seen.where((F.col("kind") != PART) & (F.col("beyond") == side)).select(*line, F.col("id").alias(name)) for side, name in ((False, "a"), (True, "b")))
    roots = joined(one.join(other, line).select("surface_id", "a", "b").distinct())
    parts = seen.where(F.col("kind") == PART).select("surface_id", "tile_r", "tile_c", "id", "size", "sum_r", "sum_c", "at_edge")
    return parts.join(roots, ["surface_id", "id"], "left").withColumn("region", F.coalesce("root", "id")).drop("root")


def _whole(parts: DataFrame) -> DataFrame:
    return parts.groupBy("surface_id", "region").agg(F.sum("size").alias("size"), F.sum("sum_r").alias("sum_r"), F.sum("sum_c").alias("sum_c"), F.bool_or("at_edge").alias("at_edge"))


def regions(tiles: DataFrame, mask_of: Mask) -> DataFrame:
    """Regions of samples that touch (down or across) where ``mask_of(heights, row)`` is set.

    surface_id, region (where its first sample lies, row by row), size, sum_r and sum_c of its samples'
    rows and columns, and whether it reaches the field's edge.
    """
    return _whole(_parts(tiles, mask_of))


def filled(tiles: DataFrame) -> DataFrame:
    """Tiles of a mask (1 where set, absent elsewhere) with its holes set: what isn't set and doesn't reach the field's edge."""
    parts = _parts(tiles, lambda h, _: np.isnan(h))
    holes = parts.join(_whole(parts).where("NOT at_edge").select("surface_id", "region"), ["surface_id", "region"], "left_semi")
    by_tile = holes.groupBy(*KEY).agg(F.collect_set("id").alias("holes"))  # no more than a tile has samples

    def scan(batches):
        for batch in batches:
            ids = batch.column("holes").to_pylist()
            for (h, row), hole in zip(tiles_of(batch.drop_columns(["holes"])), ids, strict=True):
                if hole:
                    label, known = numbered(np.isnan(h), row)
                    h = np.where(np.isin(known, hole)[label], 1.0, h)
                yield tile_batch([row], [h])

    return tiles.select(*FIELD, *PLACE, "heights").join(by_tile, list(KEY), "left").select(*FIELD, *PLACE, "heights", "holes").mapInArrow(scan, TILES_DDL)


#: Bits of a value that one pass of the selection settles.
DIGIT = 16


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the values' order; 0 and -0 are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    high = keys >> np.uint64(63)
    return np.where(high, keys ^ np.uint64(1 << 63), ~keys).view(np.float64)


def _digits(level: int):
    """For values that begin with a wanted prefix, how many have each next digit."""
    schema = pa.schema([("surface_id", pa.string()), ("prefix", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])
    shift = np.uint64(64 - DIGIT * (level + 1))

    def scan(batches):
        for batch in batches:
            wanted = batch.column("prefixes").to_pylist()
            offsets = np.append(0, np.cumsum(batch.column("heights").value_lengths().fill_null(0).to_numpy()))
            values = batch.column("heights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for k, surface in enumerate(batch.column("surface_id").to_pylist()):
                own = values[offsets[k] : offsets[k + 1]]
                keys = ordered_bits(own[~np.isnan(own)]) >> shift
                for prefix in sorted(set(wanted[k])):
                    some = keys if not level else keys[keys >> np.uint64(DIGIT) == np.uint64(prefix)]
                    digit, n = np.unique(some & np.uint64((1 << DIGIT) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([surface] * len(n), pa.string()), pa.array([prefix] * len(n), pa.int64()), pa.array(digit.astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    return scan


def _value(batches):
    for batch in batches:
        keys = batch.column("prefix").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("surface_id"), pa.array(from_ordered_bits(keys))], names=["surface_id", "value"])


def medians(tiles: DataFrame) -> DataFrame:
    """(surface_id, median) of the measured samples, exact; fields without any are left out.

    Selection by digits: four passes over the tiles count, for the middle ranks, the next 16 bits of the
    values still in question. A field sends at most 65,536 counts a task and pass, whatever its size.
    """
    rows = tiles.select("surface_id", "heights")
    state = rows.select("surface_id").distinct().select("surface_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("rank"))
    for level in range(64 // DIGIT):
        wanted = state.groupBy("surface_id").agg(F.collect_set("prefix").alias("prefixes"))  # one or two
        counted = rows.join(wanted, "surface_id").select("surface_id", "heights", "prefixes").mapInArrow(_digits(level), "surface_id string, prefix long, digit int, n long")
        counted = counted.groupBy("surface_id", "prefix", "digit").agg(F.sum("n").alias("n"))
        each = Window.partitionBy("surface_id", "which")
        running = state.join(counted, ["surface_id", "prefix"]).withColumn("total", F.sum("n").over(each)).withColumn("upto", F.sum("n").over(each.orderBy("digit")))
        rank = F.coalesce(F.col("rank"), F.floor((F.col("total") - 1 + F.col("which")) / 2))
        found = running.withColumn("rank", rank).where("upto > rank AND upto - n <= rank")
        state = cut(found.select("surface_id", "which", F.expr(f"shiftleft(prefix, {DIGIT}) | digit").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
    values = state.select("surface_id", "prefix").mapInArrow(_value, "surface_id string, value double")
    return values.groupBy("surface_id").agg(F.avg("value").alias("median"))


def depressions(tiles: DataFrame, threshold: float) -> DataFrame:
    """Tiles with 1 where a sample lies more than ``threshold`` below its field's median, absent elsewhere."""
    deep = F.transform("heights", lambda h: F.when(h < F.col("median") - threshold, F.lit(1.0)))
    return tiles.join(medians(tiles), "surface_id", "left").withColumn("heights", deep).select(*FIELD, *PLACE, "heights")


def detected_pins(tiles: DataFrame, threshold: float) -> DataFrame:
    """Centre, equal-area radius and size of each field's largest depression, its holes filled.

    One row for each field. ``refused`` says why there is no answer: ``no-depression``, or
    ``depression-off-centre`` where the field's centre lies outside. Of equal sizes the one that begins first.
    """
    whole = regions(filled(depressions(tiles, threshold)), lambda h, _: ~np.isnan(h))
    best = whole.groupBy("surface_id").agg(F.max(F.struct("size", -F.col("region"), "sum_r", "sum_c")).alias("best"))
    found = tiles.select(*FIELD).distinct().join(best, "surface_id", "left")
    y = (F.col("best.sum_r") / F.col("best.size") - (F.col("n_rows") - 1) / 2) * F.col("spacing_y")
    x = (F.col("best.sum_c") / F.col("best.size") - (F.col("n_cols") - 1) / 2) * F.col("spacing_x")
    radius = F.sqrt(F.col("best.size") * F.col("spacing_y") * F.col("spacing_x") / F.pi())
    placed = found.select("surface_id", F.col("best.size").alias("size"), y.alias("centre_y"), x.alias("centre_x"), radius.alias("radius"))
    refused = F.when(F.col("size").isNull(), "no-depression").when(F.hypot("centre_y", "centre_x") > F.col("radius"), "depression-off-centre")
    return placed.withColumn("refused", refused)
