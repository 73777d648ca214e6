"""Tiles: the same values as whole fields, whatever the side; regions, holes and medians across tiles."""

import numpy as np
import pytest
from contourlake.errors import Refusal
from contourlake.functions import heights as H
from contourlake.operators import blocked as B
from contourlake.operators import forms as FM
from contourlake.operators import placement as P
from contourlake.operators import regions as R
from contourlake.operators import tiled as O
from contourlake.operators.wording import conclusion_words
from contourlake.sources import tiles as T
from contourlake.sources.surfaces import SURFACES, mapped, samples

rng = np.random.default_rng(4)


def field(rows, cols, absent=0.1, seed=0):
    r = np.random.default_rng(seed)
    h = np.cumsum(r.normal(size=(rows, cols)), 0) / 3 + r.normal(size=(rows, cols))
    h[r.random((rows, cols)) < absent] = np.nan
    return h


def table(spark, fields, spacing=(2.0, 3.0)):
    rows = [(k, *h.shape, *spacing, "um", "y-down", [None if np.isnan(v) else float(v) for v in h.ravel()], []) for k, h in fields.items()]
    return spark.createDataFrame(rows, SURFACES)


def heights(rows):
    return {(r["surface_id"], r["r"], r["c"]): r["h"] for r in rows.select("surface_id", "r", "c", "h").collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert (v is None) == (b[k] is None) and (v is None or abs(v - b[k]) < 1e-9), k


FIELDS = {"a": field(37, 23), "b": field(5, 61, 0.4, 1), "c": field(1, 1, 0.0, 2), "d": np.full((9, 9), np.nan)}


@pytest.mark.parametrize("side", [4, 11, 100])
def test_neighbourhoods_equal_those_of_whole_fields(spark, side):
    whole = table(spark, FIELDS)
    tiles = T.tiled(whole, side).cache()
    same(heights(T.tile_samples(tiles)), heights(samples(whole)))
    same(heights(T.tile_samples(O.smooth(tiles, side, 15.0))), heights(samples(mapped(whole, lambda h, _: H.smoothed(h, (~np.isnan(h)).astype(float), 15.0, 2.0, 3.0)))))
    same(heights(T.tile_samples(O.bandpass(tiles, side, 8.0, 15.0))), heights(samples(mapped(whole, lambda h, _: H.bandpassed(h, 8.0, 15.0, 2.0, 3.0)))))
    same(heights(T.tile_samples(O.trim_grow(tiles, side, 1, 5))), heights(samples(mapped(whole, lambda h, _: np.where(H.grown_mask(h, 1, 5), np.nan, h)))))


def test_fields_by_rows_make_the_same_tiles(spark):
    h = FIELDS["a"]
    rows = spark.createDataFrame([("a", *h.shape, 2.0, 3.0, k, [None if np.isnan(v) else float(v) for v in h[k]]) for k in range(len(h))], f"{T.FIELD_DDL}, r int, values array<double>")
    by_row = T.tiled_rows(rows.repartition(5), 7)
    same(heights(T.tile_samples(by_row)), heights(T.tile_samples(T.tiled(table(spark, {"a": h}), 7))))
    same(heights(T.tile_samples(O.trim_grow(by_row, 7, 2, 2))), heights(T.tile_samples(O.trim_grow(T.tiled(table(spark, {"a": h}), 7), 7, 2, 2))))


def test_a_border_is_cut_at_the_field_and_no_wider(spark):
    def of(h, row):
        top, left = max(0, row["top"] - 3), max(0, row["left"] - 9)
        assert h.shape == (min(row["n_rows"], row["top"] + row["rows"] + 3) - top, min(row["n_cols"], row["left"] + row["cols"] + 9) - left)
        r, c = np.indices(h.shape)
        assert np.array_equal(h, (r + top) * 100.0 + c + left)
        return h

    r, c = np.indices((20, 30))
    tiles = T.tiled(table(spark, {"n": r * 100.0 + c}), 6)
    same(heights(T.tile_samples(T.with_border(tiles, 6, 3, 9, of))), heights(T.tile_samples(tiles)))


def test_spacings_must_be_one(spark):
    both = table(spark, {"a": FIELDS["a"]}).unionByName(table(spark, {"b": FIELDS["b"]}, (1.0, 1.0)))
    with pytest.raises(Refusal):
        O.smooth(T.tiled(both, 8), 8, 15.0)
    with pytest.raises(Refusal):
        O.smooth(T.tiled(both.limit(0), 8), 8, 15.0)


def brute_regions(fields, mask_of):
    out = []
    for k, h in fields.items():
        label = H.labelled(mask_of(h))
        for n in range(1, label.max() + 1):
            r, c = np.nonzero(label == n)
            edge = bool((r == 0).any() or (c == 0).any() or (r == h.shape[0] - 1).any() or (c == h.shape[1] - 1).any())
            out.append((k, int(r[0] * h.shape[1] + c[0]), len(r), int(r.sum()), int(c.sum()), edge))
    return sorted(out)


def spiral(n):
    """A one-sample-wide path that winds inwards: one region through every tile many times."""
    h = np.full((n, n), np.nan)
    r = c = 0
    dr, dc = 0, 1
    h[0, 0] = 1.0
    for length in [n - 1, *[k for m in range(n - 1, 1, -2) for k in (m, m)]]:
        for _ in range(length):
            r, c = r + dr, c + dc
            h[r, c] = 1.0
        dr, dc = dc, -dr
    return h


@pytest.mark.parametrize("side", [5, 64])
def test_regions_across_tiles(spark, side):
    fields = {"noise": field(41, 33, 0.45, 7), "spiral": spiral(31), "none": np.full((6, 6), np.nan), "full": np.ones((17, 12))}
    got = R.regions(T.tiled(table(spark, fields), side), lambda h, _: ~np.isnan(h)).collect()
    assert sorted(tuple(r) for r in got) == brute_regions(fields, lambda h: ~np.isnan(h))


def test_holes_are_filled_across_tiles(spark):
    ring = np.full((20, 20), np.nan)
    ring[3:17, 3:17] = 1.0
    ring[5:15, 5:15] = np.nan
    ring[8:11, 8:11] = 1.0
    fields = {"ring": ring, "open": np.where(np.indices((20, 20))[1] == 12, np.nan, ring), "noise": field(41, 33, 0.35, 8)}
    ones = {k: np.where(np.isnan(h), np.nan, 1.0) for k, h in fields.items()}
    got = heights(T.tile_samples(R.filled(T.tiled(table(spark, ones), 6))))
    for k, h in ones.items():
        mask = H.filled(~np.isnan(h))
        assert all((got[k, r, c] is not None) == mask[r, c] for r in range(h.shape[0]) for c in range(h.shape[1]))


def test_long_chains_are_joined(spark):
    n = 700
    links = spark.createDataFrame([("s", k, k + 1) for k in range(n)] + [("t", 5, 3), ("t", 3, 5), ("t", 9, 9), ("t", 5, 4)], "surface_id string, a long, b long")
    got = {(r["surface_id"], r["id"]): r["root"] for r in R.joined(links).collect()}
    assert got == {("s", k): 0 for k in range(1, n + 1)} | {("t", 4): 3, ("t", 5): 3}
    assert R.joined(links.limit(0)).count() == 0


def test_medians_are_exact(spark):
    fields = dict(FIELDS) | {"ties": np.array([[0.0, -0.0, 1.0, 1.0]]), "even": np.array([[-3.5, 2.25, np.nan, 1e300, -1e-300]]), "wide": field(50, 50, 0.2, 9) * 1e-9}
    got = {r["surface_id"]: r["median"] for r in R.medians(T.tiled(table(spark, fields), 8)).collect()}
    assert got == {k: float(np.nanmedian(h)) for k, h in fields.items() if not np.isnan(h).all()}


def test_bits_keep_the_order_of_values():
    x = np.sort(np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, np.inf, -np.inf, 5e-324]]))
    keys = R.ordered_bits(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and (R.from_ordered_bits(keys) == x).all()


def test_pins_of_whole_fields(spark):
    r, c = np.indices((40, 40))
    pin = field(40, 40, 0.05, 3) * 0.01 - 20.0 * (np.hypot(r - 18, c - 22) < 9)
    off = field(40, 40, 0.05, 4) * 0.01 - 20.0 * (np.hypot(r - 3, c - 3) < 3)
    got = {x["surface_id"]: x for x in R.detected_pins(T.tiled(table(spark, {"pin": pin, "off": off, "flat": np.zeros((8, 8))}), 7), 5.0).collect()}
    y, x = H.axes(pin.shape, 2.0, 3.0)
    assert (got["pin"]["centre_y"], got["pin"]["centre_x"], got["pin"]["radius"]) == pytest.approx(H.detected_pin(pin, y, x, 5.0, 2.0, 3.0))
    assert [got[k]["refused"] for k in ("pin", "off", "flat")] == [None, "depression-off-centre", "no-depression"]


def test_words_of_a_line_are_found_in_one_walk(spark):
    text = "Match xmatch  identifier EXCLUDED_match\r\nidentifiers identifierx  concluding\x85match" + "\n" + "matched " * 20_000
    got = conclusion_words(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "id", "text").collect()
    assert [(r["line"], r["column"], r["word"]) for r in got[:6]] == [(1, 1, "Match"), (1, 26, "EXCLUDED"), (1, 35, "match"), (2, 13, "identifierx"), (2, 26, "concluding"), (3, 1, "match")]
    assert [r["column"] for r in got[6:]] == [8 * k + 1 for k in range(20_000)] and {r["source"] for r in got} == {1}




@pytest.mark.parametrize("side", [9, 64])
def test_forms_equal_those_of_whole_fields(spark, side):
    fields = {"a": field(37, 23) + np.indices((37, 23))[0] * 0.7, "b": field(25, 61, 0.3, 1)}
    fields["a"][3:6, 4:9] += 500.0
    whole, tiles = table(spark, fields), T.tiled(table(spark, fields), side)
    for degree, tuning, passes in ((1, None, None), (2, None, None), *([(2, 4.0, 2)] if side == 9 else [])):
        want = mapped(whole, lambda h, _, p=(degree, tuning, passes): h - H.polynomial_form(h, *H.axes(h.shape, 2.0, 3.0), *p))
        same(heights(T.tile_samples(FM.level(tiles, FM.Polynomial(degree), tuning, passes))), heights(samples(want)))


@pytest.mark.parametrize("sign", [-1.0, 1.0])
def test_spheres_of_either_branch(spark, sign):
    y, x = H.axes((30, 40), 2.0, 3.0)
    h = sign * (np.sqrt(300.0**2 - y**2 - x**2) - 290.0) + field(30, 40, 0.1, 6) * 0.01
    got = heights(T.tile_samples(FM.level(T.tiled(table(spark, {"s": h}), 11), FM.Sphere())))
    want = h - H.sphere_form(h, y, x)
    same(got, {("s", r, c): None if np.isnan(want[r, c]) else want[r, c] for r in range(30) for c in range(40)})


def test_forms_that_samples_do_not_determine_are_refused(spark):
    line = np.full((12, 12), np.nan)
    line[:, 5] = 1.0
    tiles = T.tiled(table(spark, {"line": line, "none": np.full((4, 4), np.nan)}), 5)
    assert {r["surface_id"]: r["solution"] for r in FM.fitted(tiles, FM.Polynomial(1)).collect()} == {"line": None, "none": None}
    with pytest.raises(Exception, match="rank-deficient"):
        FM.level(tiles, FM.Polynomial(1)).collect()
    small = field(20, 20, 0.0, 3) * 50
    with pytest.raises(Exception, match="sphere-too-small"):
        FM.level(T.tiled(table(spark, {"s": small}), 8), FM.Sphere()).collect()


def test_fields_without_spread_keep_their_solution(spark):
    got = FM.fitted(T.tiled(table(spark, {"flat": np.zeros((10, 10)), "noise": field(10, 10, 0.0, 2)}), 4), FM.Polynomial(1), 3.0, 1).collect()
    assert {r["surface_id"] for r in got} == {"flat", "noise"} and all(r["n"] == 100 for r in got)


@pytest.mark.parametrize("side", [7, 64])
def test_blocks_of_cells_place_as_samples_do(spark, side, monkeypatch):
    subject = {"a": field(37, 23, 0.2, 1), "b": field(20, 41, 0.5, 2) + 1000.0}
    moved = {k: np.roll(h, (2, -1), (0, 1)) for k, h in subject.items()}
    cells = P.CellParameters(3, 0.5)
    want = {tuple(r)[:5]: r for r in P.correlations(samples(table(spark, subject)), samples(table(spark, moved)), cells, 3).select("surface_id", "cell_r", "cell_c", "down", "across", "overlap", "correlation").collect()}
    monkeypatch.setattr(B, "DIRECT", 1 << 21 if side == 7 else 0)
    got = B.blocked_correlations(T.tiled(table(spark, subject), side), T.tiled(table(spark, moved), side), side, cells, 3).collect()
    assert {tuple(r)[:5] for r in got} == want.keys()
    for r in got:
        assert r["overlap"] == want[tuple(r)[:5]]["overlap"] and abs(r["correlation"] - want[tuple(r)[:5]]["correlation"]) < 1e-6


def test_blocks_by_fft_equal_direct_ones(monkeypatch):
    block, around = field(9, 7, 0.3, 1) + 50.0, field(21, 19, 0.3, 2) - 20.0
    direct = B.overlap_sums(block, around)
    monkeypatch.setattr(B, "DIRECT", 0)
    for a, b in zip(direct, B.overlap_sums(block, around), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-7)


def test_fields_of_different_shapes_are_not_placed(spark):
    a, b = T.tiled(table(spark, {"a": FIELDS["a"]}), 8), T.tiled(table(spark, {"a": FIELDS["b"]}), 8)
    with pytest.raises(Exception, match="different-shapes"):
        B.blocked_correlations(a, b, 8, P.CellParameters(3, 0.5), 2).collect()
