"""Sliding medians against sorting every rectangle."""

import time

import numpy as np
import pytest
from contourlake.functions import heights as H
from contourlake.functions import sliding as S


@pytest.mark.filterwarnings("ignore")
def test_equal_to_sorting_every_rectangle(monkeypatch):
    monkeypatch.setattr(H, "LARGE", 10**9)
    rng = np.random.default_rng(3)
    for t in range(40):
        h = rng.normal(size=rng.integers(1, 30, 2)) if t % 2 else rng.integers(0, 4, rng.integers(1, 30, 2)).astype(float)
        h[rng.random(h.shape) < rng.choice([0, 0.3, 0.9, 1])] = np.nan
        reach = tuple(int(n) for n in rng.integers(0, 8, 2))
        for mine, sorted_ in zip(S.medians_and_deviations(h, *reach), H.centre_and_spread(h, "median-absolute-deviation", reach), strict=True):
            assert np.array_equal(mine, sorted_, equal_nan=True)


def test_strips_are_bounded_and_large_rectangles_slide(monkeypatch):
    h = np.random.default_rng(4).normal(size=(50, 40))
    whole = S.medians_and_deviations(h, 15, 15)
    monkeypatch.setattr(S, "MOST", 20_000)
    for a, b in zip(S.medians_and_deviations(h, 15, 15), whole, strict=True):
        assert np.array_equal(a, b)
    for a, b in zip(H.centre_and_spread(h, "median-absolute-deviation", (15, 15)), whole, strict=True):
        assert np.array_equal(a, b)


def test_cost_grows_less_than_area():
    h = np.random.default_rng(5).normal(size=(96, 96))
    took = {}
    for reach in (8, 32):
        began = time.process_time()
        S.medians_and_deviations(h, reach, reach)
        took[reach] = time.process_time() - began
    assert took[32] < 6 * took[8]  # the area is 15 times as large
