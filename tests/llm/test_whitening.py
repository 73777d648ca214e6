"""Whitening against exact fractions and a direct eigen-solve."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from contourlake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dims=6, seed=0, offset=0.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * np.arange(1, dims + 1) + offset).astype(np.float32)


def stored(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def exact_covariance(x):
    """Of the distinct rows of whole numbers, as fractions."""
    fit = sorted({tuple(r) for r in x.tolist()})
    n, d = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit), n**3) for j in range(d)] for i in range(d)]
    return n, s, v


def test_outer_products_lose_nothing():
    rng = np.random.default_rng(5)
    steps = np.concatenate([rng.integers(-(10**6), 10**6, (1500, 4)), rng.integers(-3, 3, (200, 4))])
    centre = W.Centre(len(steps), tuple(int(s) for s in steps.sum(0)))
    total = W.OuterProducts(4)
    for low in range(0, len(steps), W.BLOCK):
        total.add(*centre.parts(centre.scaled(steps[low : low + W.BLOCK])))
    n, s = len(steps), [int(v) for v in steps.sum(0)]
    rows = steps.tolist()
    for i in range(4):
        for j in range(4):
            want = Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows), n * n)
            mine = Fraction(float(total.high[i, j])) + Fraction(float(total.low[i, j]))
            assert abs(mine - want) <= Fraction(total.high[i, i]) * Fraction(1, 2**85)


def test_sums_and_products_without_error():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200)
    for f, op in ((W.two_sum, Fraction.__add__), (W.two_product, Fraction.__mul__)):
        for x, y, s, e in zip(a, b, *f(a, b), strict=True):
            assert op(Fraction(float(x)), Fraction(float(y))) == Fraction(float(s)) + Fraction(float(e))


def test_rows_are_packed_by_their_widest_entry():
    steps = np.array([[1, -2], [40000, 0], [-32768, 32767], [2**40, -(2**40)], [-(2**31), 2**31 - 1]])
    rows = W.packed(steps)
    assert [len(r) for r in rows] == [4, 8, 4, 16, 8]
    assert (W.unpacked(pa.array(rows, pa.binary()), 2) == steps).all()


def test_query_against_fractions(spark, tmp_path):
    x = vectors(offset=3.0)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (rows[3][0], rows[3][1], 1), (None, rows[5][1], None)]
    left_out = [(2000, None, 1), (2001, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1), (2004, [], 1), (2005, [1.0] * 5, 1)]
    got = W.op13_embedding_whitening(spark, stored(spark, tmp_path, rows + left_out)).collect()
    whole = {r[0]: np.floor(64 * np.array(r[1], np.float64)).astype(np.int64) + 1_000_000 for r in rows}
    n, s, v = exact_covariance(np.array(list(whole.values())))
    values, axes = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 6 * len(rows) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    for k in range(1, 7):
        ids = [i for i in whole if i is not None]
        want = np.array([[float(Fraction(int(c) * n - s[j], n)) for j, c in enumerate(whole[i])] for i in ids]) @ axes[:, k - 1] / np.sqrt(values[k - 1])
        mine = np.array([by[k][i]["whitened"] for i in ids])
        assert np.allclose(mine, want * np.sign(mine[0] * want[0]), atol=1e-9)
        assert abs(by[k][0]["explained"] - values[k - 1] / values.sum()) < 1e-12
    for i in whole:
        assert by[1][i]["deviation"] == sum((n * int(c) - s[j]) ** 2 for j, c in enumerate(whole[i]))
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_components_without_variance_are_left_out(spark, tmp_path):
    x = vectors(50, 3)
    rows = [(i, [*map(float, r), 1.0, float(np.floor(64 * np.float64(r[0])) / 64)], 0) for i, r in enumerate(x)]
    got = W.op13_embedding_whitening(spark, stored(spark, tmp_path, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and max(r["identity_error"] for r in got) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_tables_without_variance_give_no_rows(spark, tmp_path, rows):
    got = W.op13_embedding_whitening(spark, stored(spark, tmp_path, rows))
    assert got.count() == 0 and set(got.columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}


def test_wide_entries_and_clashing_columns(spark):
    rows = [(f"k{i}", [float(2.0 ** (20 + i)), float(-i)], 1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, v array<double>, steps int, dims int")
    model = W.fit_whitening(df, "v")
    got = W.whitened(df, model, "key", "v").orderBy("key").collect()
    n, sums = model.centre.n, model.centre.sums
    for r in got:
        i = int(r["key"][1:])
        assert int(r["deviation"]) == (n * 64 * 2 ** (20 + i) - sums[0]) ** 2 + (n * 64 * -i - sums[1]) ** 2
