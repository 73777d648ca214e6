"""Correlations of samples: against sums by hand, and without a row for each sample and displacement in a shuffle."""

import math

import numpy as np
import pytest
from contourlake.functions.heights import cell_bounds
from contourlake.operators import placement as P

DDL = "surface_id string, r int, c int, h double, n_rows int, n_cols int, spacing_y double, spacing_x double"


def rows_of(name, h, missing=()):
    return [(name, r, c, None if np.isnan(h[r, c]) else float(h[r, c]), *h.shape, 1.0, 1.0) for r in range(h.shape[0]) for c in range(h.shape[1]) if (r, c) not in missing]


def field(rows, cols, seed):
    r = np.random.default_rng(seed)
    h = r.normal(size=(rows, cols)) + 5.0
    h[r.random((rows, cols)) < 0.1] = np.nan
    return h


def by_hand(subject, other, missing, grid, share, limit):
    out = {}
    rows, cols = cell_bounds(subject.shape[0], grid), cell_bounds(subject.shape[1], grid)
    for i in range(grid):
        for j in range(grid):
            cell = [(r, c) for r in range(rows[i], rows[i + 1]) for c in range(cols[j], cols[j + 1]) if (r, c) not in missing]
            seen = [x for x in cell if not np.isnan(subject[x])]
            if not cell or len(seen) < share * len(cell):
                continue
            for down in range(-limit, limit + 1):
                for across in range(-limit, limit + 1):
                    met = [(subject[r, c], other[r + down, c + across]) for r, c in seen if 0 <= r + down < other.shape[0] and 0 <= c + across < other.shape[1] and not np.isnan(other[r + down, c + across])]
                    if len(met) >= max(1, math.ceil(share * len(cell))):
                        out[i, j, down, across] = len(met), float(np.corrcoef(np.array(met).T)[0, 1])
    return out


@pytest.mark.parametrize("side, limit", [(128, 2), (7, 2), (3, 5)])
def test_samples_in_any_order_equal_sums_by_hand(spark, monkeypatch, side, limit):
    monkeypatch.setattr(P, "TILE", side)
    a, b, missing = field(23, 17, 1), field(19, 20, 2), {(0, 0), (0, 1), (9, 9), (22, 16)}
    shuffled = np.random.default_rng(3).permutation
    own, other = ([rows[k] for k in shuffled(len(rows))] for rows in (rows_of("a", a, missing) + rows_of("alone", a), rows_of("a", b)))
    found = P.correlations(spark.createDataFrame(own, DDL), spark.createDataFrame(other, DDL), P.CellParameters(3, 0.5), limit)
    got, want = {tuple(r)[1:5]: (r["overlap"], r["correlation"]) for r in found.select("surface_id", "cell_r", "cell_c", "down", "across", "overlap", "correlation").collect()}, by_hand(a, b, missing, 3, 0.5, limit)
    assert got.keys() == want.keys()
    for k, (n, value) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(value, abs=1e-9), k


def written(spark):
    """Records that all stages up to now have written to shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_no_sample_is_shuffled_once_for_each_displacement(spark):
    h = field(60, 60, 4)
    table = spark.createDataFrame(rows_of("a", h), DDL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = written(spark)
        assert P.correlations(table, table, P.CellParameters(2, 0.5), 5).count() == 4 * 11**2
        assert written(spark) - start < h.size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
