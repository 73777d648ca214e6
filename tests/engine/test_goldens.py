"""Published figures that the engine must reproduce, on fields built from parameters."""

import math

import numpy as np
import pytest

from contourlake.errors import Refusal
from contourlake.functions import heights as H
from contourlake.operators import agreement as A
from contourlake.operators import placement as P
from contourlake.plans.steps import Applied, BandParameters, EdgeParameters, Field, LevelParameters, MarkParameters, OutlierParameters, PinParameters, apply_chain
from contourlake.sources.surfaces import SURFACES, collected, samples
from contourlake.sources.synthetic import FieldParameters, generate

SEARCH = P.SearchParameters(4, 0.5, 10.0, 2.0, 6)


def one(h, spacing, *steps):
    field, records = apply_chain(Field(h, spacing, spacing), [Applied(*s) for s in steps])
    return field.h, records


def crossed(sources, seed, turn=0.0, shift=(0.0, 0.0)):
    flat = {"rows": 192, "columns": 192, "form_depth_um": 0.0, "firing_pin_depth_um": 0.0, "drag_mark_depth_um": 0.0}
    along = generate(FieldParameters(**flat, striae_angle_deg=0.0, striae_spacing_um=40.0, seed=seed), sources[0], shift, turn)
    return along + generate(FieldParameters(**flat, striae_angle_deg=90.0, striae_spacing_um=56.0, seed=seed + 1), sources[1], shift, turn)


def row(name, h, spacing=4.0):
    return (name, *h.shape, spacing, spacing, "um", "y-down", [None if math.isnan(x) else float(x) for x in h.ravel()], [])


@pytest.fixture(scope="module")
def by_angle(spark):
    subjects = spark.createDataFrame([row("match", crossed((11, 22), 5, 6.0, (2.0, -3.0))), row("other", crossed((31, 42), 5, 6.0, (2.0, -3.0)))], SURFACES)
    reference = crossed((11, 22), 1)
    references = spark.createDataFrame([row("match", reference), row("other", reference)], SURFACES)
    pairs = P.paired(subjects.selectExpr("surface_id AS pair_id", "*"), references.selectExpr("surface_id AS pair_id", "*"))
    return P.registrations(pairs, SEARCH).cache()


def rule(**changed):
    return A.AgreementRule(**({"down_threshold": 1.0, "across_threshold": 1.0, "rotation_threshold_deg": 2.0, "correlation_threshold": 0.5, "consensus": "median"} | changed))


HIGH = A.HighAgreementRule(1.0, 1.0, 0.5, "median", 1)


def test_scores_separate_the_pairs(by_angle):
    found = {r["pair_id"]: r for r in A.score(by_angle, rule()).collect()}
    assert (found["match"]["congruent"], found["other"]["congruent"]) == (16, 4)
    assert found["match"]["eligible"] == found["other"]["eligible"] == 16
    assert (found["match"]["down_at"], found["match"]["across_at"], found["match"]["angle_deg_at"]) == (-2, 3, 6)
    assert (found["other"]["failed_across"], found["other"]["failed_correlation"], found["other"]["discarded"]) == (12, 5, 12)


def test_histogram_rule(by_angle):
    found = {r["pair_id"]: r["congruent"] for r in A.score(by_angle, rule(consensus="histogram-mode", translation_bin=2.0, rotation_bin_deg=2.0)).collect()}
    assert found == {"match": 16, "other": 6}


def test_high_rule_and_disagreements(by_angle):
    high = A.score_high(by_angle, HIGH, H.angles(10.0, 2.0))
    found = {r["pair_id"]: r for r in high.collect()}
    assert (found["match"]["congruent"], found["other"]["congruent"]) == (16, 7)
    counts = A.angle_counts(by_angle, HIGH).where("pair_id = 'match'").groupBy("angle_deg").agg({"agrees": "count"})
    assert counts.count() == 11
    per_angle = {r["angle_deg"]: r["n"] for r in A.angle_counts(by_angle, HIGH).where("pair_id = 'match'").selectExpr("angle_deg", "int(agrees) AS n").groupBy("angle_deg").sum("n").toDF("angle_deg", "n").collect()}
    assert [per_angle[a] for a in H.angles(10.0, 2.0)] == [0, 0, 0, 0, 0, 0, 2, 4, 16, 4, 0]
    apart = {r["pair_id"]: r for r in A.disagreements(A.score(by_angle, rule()), high).collect()}
    assert apart["other"]["only_original"] == [] and [tuple(c) for c in apart["other"]["only_high"]] == [(0, 2), (1, 2), (3, 3)]


def test_direct_sums_and_transforms_place_alike():
    rng = np.random.default_rng(3)
    reference = rng.normal(size=(60, 70))
    reference[rng.random(reference.shape) < 0.2] = np.nan
    tile = reference[20:40, 22:44].copy()
    tile[3, 4] = np.nan
    a = H.Searched(reference, 5).place(tile, 18, 25, 10)
    big = H.Searched(reference, 18).place(tile, 18, 25, 10)
    assert a[:2] == big[:2] == (2, -3) and abs(a[2] - 1) < 1e-9 and abs(big[2] - 1) < 1e-9 and a[3] == big[3]
    assert H.Searched(reference, 5).place(np.ones((5, 5)), 5, 5, 1) is None


def test_outliers():
    h = generate(FieldParameters(rows=48, columns=48, seed=20260808))
    spikes = np.random.default_rng(7).choice(48 * 48, size=25, replace=False)
    h.ravel()[spikes] += 60.0
    for criterion, k, reach, want in (("median-absolute-deviation", 3.0, None, 118), ("median-absolute-deviation", 6.0, None, 25), ("median-absolute-deviation", 3.0, 12.0, 29), ("standard-deviation", 12.0, None, 0)):
        out, records = one(h, 4.0, ("reject-outliers", OutlierParameters(criterion, k, reach)))
        assert np.isnan(out).sum() == want
        if reach is None:
            assert f'"rejected_samples": {want}' in records[0]["outcomes"]


def test_marks():
    h = generate(FieldParameters(rows=64, columns=64, noise_um=0.0, seed=20260808))
    base = {"drag_width": 30.0, "drag_position": -64.0, "drag_angle_deg": 0.0, "extractor_radius": 40.0, "extractor_distance": 100.0, "extractor_angle_deg": 90.0}
    for drag, extractor, angle, want in ((True, False, 0.0, 512), (False, True, 0.0, 286), (True, True, 0.0, 798), (True, False, 30.0, 480), (False, False, 0.0, 0)):
        out, _ = one(h, 4.0, ("mask-marks", MarkParameters(**(base | {"drag_angle_deg": angle, "exclude_drag": drag, "exclude_extractor": extractor}))))
        assert np.isnan(out).sum() == want


def test_growth_around_one_hole():
    h = np.ones((40, 40))
    h[20, 20] = np.nan
    assert np.isnan(one(h, 4.0, ("trim-edge", EdgeParameters(4.0, "grow")))[0]).sum() == 9


def test_pin_is_found():
    h = generate(FieldParameters(rows=128, columns=128, pixel_spacing_um=8.0, seed=20260808))
    y, x, r = H.detected_pin(h, *H.axes(h.shape, 8.0, 8.0), 10.0, 8.0, 8.0)
    assert abs(y) < 1e-9 and abs(x) < 1e-9 and abs(r - 160) <= 4


def tilted_bowl():
    h = generate(FieldParameters(rows=48, columns=48, striae_depth_um=0.0, firing_pin_depth_um=0.0, drag_mark_depth_um=0.0, noise_um=0.0, seed=20260808))
    y, x = H.axes(h.shape, 4.0, 4.0)
    return h + 0.05 * y - 0.03 * x


def test_levelling_residuals():
    for model, order, want, within in (("plane", None, 2.636, 1e-3), ("polynomial", 2, 0.0, 1e-12), ("sphere", None, 0.01393, 1e-5)):
        out, _ = one(tilted_bowl(), 4.0, ("level", LevelParameters(model, order, None, None)))
        assert abs(math.sqrt(np.mean(out**2)) - want) < within
    spiked = tilted_bowl()
    spiked[5:8, 5:8] += 500.0
    clean = np.ones(spiked.shape, bool)
    clean[5:8, 5:8] = False
    robust, _ = one(spiked, 4.0, ("level", LevelParameters("polynomial", 2, 1.5, 5)))
    assert np.abs(robust[clean]).max() <= 1e-6


def test_absent_samples_take_no_part_in_fits_or_means():
    h = tilted_bowl()
    h[:12, :12] = np.nan
    out, _ = one(h, 4.0, ("level", LevelParameters("polynomial", 2, None, None)))
    assert np.nanmax(np.abs(out)) < 1e-10 and np.isnan(out).sum() == 144
    flat = np.full((60, 60), 7.0)
    flat[20:30, 20:30] = np.nan
    band, _ = one(flat, 4.0, ("bandpass", BandParameters(20.0, 60.0, None, None)))
    assert np.nanmax(np.abs(band)) < 1e-12


def test_transmission_of_a_sinusoid():
    x = np.arange(192) * 2.0
    for wave in (24.0, 40.0, 90.0):
        h = np.tile(np.sin(2 * math.pi * x / wave), (192, 1))
        out, _ = one(h, 2.0, ("bandpass", BandParameters(20.0, 120.0, None, None)))
        middle = slice(88, 104)
        want = H.transmission(20.0, wave) - H.transmission(120.0, wave)
        assert np.abs(out[96, middle] - want * h[96, middle]).max() < 1e-6


def test_every_step_summary():
    h = generate(FieldParameters(seed=20260809))
    marks = MarkParameters(30.0, -256.0, 0.0, True, 40.0, 100.0, 90.0, True)
    out, records = one(
        h,
        4.0,
        ("mask-marks", marks),
        ("mask-firing-pin", PinParameters("detected", None, None, None, 10.0, 8.0)),
        ("trim-edge", EdgeParameters(40.0, "frame")),
        ("reject-outliers", OutlierParameters("median-absolute-deviation", 5.0, None)),
        ("level", LevelParameters("polynomial", 2, None, None)),
        ("bandpass", BandParameters(20.0, 120.0, 4.0, 3)),
    )
    seen = out[~np.isnan(out)]
    assert len(seen) == 48264 and len(records) == 6
    for got, want in ((seen.mean(), 0.0011719714009580454), (seen.std(), 0.3301963273789033), (seen.min(), -0.9495392545489562), (seen.max(), 0.937361936492634)):
        assert abs(got - want) < 1e-9


def test_turning():
    h = np.random.default_rng(1).normal(size=(31, 31))
    assert np.array_equal(H.rotated(h, 0.0), h)
    assert np.allclose(H.rotated(h, 90.0), np.rot90(h, 1)) or np.allclose(H.rotated(h, 90.0), np.rot90(h, -1))
    h[15, 15] = np.nan
    assert 3 <= np.isnan(H.rotated(h, 6.0))[8:23, 8:23].sum() <= 9


def test_samples_and_fields_are_inverse(spark):
    h = np.arange(12.0).reshape(3, 4)
    h[1, 2] = np.nan
    table = spark.createDataFrame([row("a", h), row("b", h * 2)], SURFACES)
    again = {r["surface_id"]: r["heights"] for r in collected(samples(table)).collect()}
    assert again == {r["surface_id"]: r["heights"] for r in table.collect()}


def test_refusals():
    flat = np.ones((8, 8))
    for step, p, reason in (
        ("trim-edge", EdgeParameters(1.0, "frame"), "narrower-than-a-sample"),
        ("trim-edge", EdgeParameters(40.0, "frame"), "nothing-left"),
        ("mask-firing-pin", PinParameters("detected", None, None, None, 1.0, 0.0), "no-depression"),
        ("bandpass", BandParameters(2.0, 40.0, None, None), "cutoff-under-a-sample"),
        ("level", LevelParameters("polynomial", 9, None, None), "rank-deficient"),
    ):
        with pytest.raises(Refusal) as e:
            one(flat, 4.0, (step, p))
        assert e.value.reason == reason
