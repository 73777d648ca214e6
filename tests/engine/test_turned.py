"""Turned tiles and registrations over tiles: the same as of whole fields; what travels doesn't grow with the angles."""

import numpy as np
import pytest
from contourlake.functions import heights as H
from contourlake.operators import placement as P
from contourlake.operators import turned as U
from contourlake.sources import tiles as T
from contourlake.sources.surfaces import mapped, samples

from .test_tiles import field, heights, same, table

FIELDS = {"a": field(37, 29, seed=1), "b": field(8, 40, seed=2), "c": field(1, 1, 0.0, seed=3), "d": np.full((9, 9), np.nan)}


@pytest.mark.parametrize("side,per_block", [(8, 1), (8, 4), (50, 8)])
def test_turned_tiles_equal_turned_fields(spark, side, per_block):
    angles = [-90.0, -7.0, 0.0, 0.5, 33.0, 180.0]
    found = U.turn(T.tiled(table(spark, FIELDS), side), side, angles, per_block)
    for degrees in angles:
        want = samples(mapped(table(spark, FIELDS), lambda h, _, degrees=degrees: H.rotated(h, degrees)))
        same(heights(T.tile_samples(found.where(f"angle_deg = {degrees}"))), heights(want))


def test_no_field_gives_no_tile(spark):
    assert U.turn(T.tiled(table(spark, FIELDS).limit(0), 8), 8, [5.0]).count() == 0


def pairs_of(spark, subject, reference):
    s, r = (table(spark, x).selectExpr("surface_id AS pair_id", "*") for x in (subject, reference))
    return P.paired(s, r)


SUBJECT = {"a": field(41, 36, seed=5), "b": field(24, 24, seed=6)}
REFERENCE = {k: np.roll(H.rotated(h, 3.0), (2, -1), (0, 1)) + 0.01 * field(*h.shape, 0.0, seed=7) + 100.0 for k, h in SUBJECT.items()}
SEARCH = P.SearchParameters(3, 0.4, 6.0, 1.5, 3)


def placed(rows):
    return {(r["angle_deg"], r["cell_r"], r["cell_c"], r["key"]): (r["down"], r["across"], r["overlap"], round(r["correlation"], 6)) for r in rows.collect()}


@pytest.mark.parametrize("side,per_block", [(14, 1), (16, 3), (60, 20), (7, 4)])
def test_registrations_over_tiles_equal_those_of_whole_fields(spark, side, per_block):
    want = placed(P.registrations(pairs_of(spark, SUBJECT, REFERENCE), SEARCH).withColumnRenamed("pair_id", "key"))
    s, r = (T.tiled(table(spark, x), side) for x in (SUBJECT, REFERENCE))
    got = placed(U.registrations(s, r, side, SEARCH, per_block).withColumnRenamed("surface_id", "key"))
    assert want and got == want


def test_blocks_of_angles_change_nothing(spark):
    pairs = pairs_of(spark, SUBJECT, REFERENCE)
    one, many = (placed(P.registrations(pairs, SEARCH, n).withColumnRenamed("pair_id", "key")) for n in (1, 40))
    assert one == many and len({k[0] for k in one}) == 9


def test_what_travels_does_not_grow_with_the_angles():
    """Forty angles of a quarter degree in one block: each tile sends little more than one angle's part."""
    row = {"surface_id": "a", "n_rows": 400, "n_cols": 400, "spacing_y": 1.0, "spacing_x": 1.0}
    tiles = [T.tile_batch([row | (at := T.place(row, i, j, 50))], [np.zeros((at["rows"], at["cols"]))]) for i in range(8) for j in range(8)]

    def sent(angles):
        return sum(len(p) for b in U._parts(T.every(50), [angles], 0, True)(iter(tiles)) for p in b.column("piece").to_pylist())

    one, many = sent([5.0]), sent([5.0 + k / 160 for k in range(40)])
    assert one < 2.6 * 400 * 400 * 8 and many < 1.1 * one


def test_fields_of_different_shapes_are_not_registered(spark):
    a, b = T.tiled(table(spark, {"a": FIELDS["a"]}), 8), T.tiled(table(spark, {"a": FIELDS["b"]}), 8)
    with pytest.raises(Exception, match="different-shapes"):
        U.registrations(a, b, 8, SEARCH).collect()
