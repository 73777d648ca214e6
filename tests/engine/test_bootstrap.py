"""The bootstrap over sources against plain Python: numbering, draws, weights, ranks."""

import hashlib
import math
import random
from collections import Counter

import pytest
from contourlake.errors import Refusal
from contourlake.operators import evidence as V
from contourlake.plans.scratch import cut
from pyspark.sql import functions as F

DDL = "set_name string, n_cells int, score int, source_a string, source_b string"


def comparisons(n, sources, seed, hot=0.3):
    r = random.Random(seed)

    def one():
        return "hot" if r.random() < hot else f"s{r.randrange(sources):03}"

    return [(r.choice("ab"), 10, r.randrange(4), one(), one()) for _ in range(n)]


def test_sums_over_ranges_equal_sums_in_order(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), k, r.randrange(5)) for k in r.sample(range(10_000), 3000)]
    table = spark.createDataFrame(rows, "g string, k int, w long").repartition(7)
    got = {(x["g"], x["k"]): x["before"] for x in V.cumulated(table, ["g"], ["k"], "w").collect()}
    want, sums = {}, Counter()
    for g, k, w in sorted(rows):
        want[g, k] = sums[g]
        sums[g] += w
    assert got == want


def test_sources_are_numbered_in_order_without_null(spark):
    names = [f"s{k * 7 % 500}" for k in range(1000)] + [None, ""]
    got = sorted(tuple(r) for r in V.numbered(spark.createDataFrame([(n,) for n in names], "source string")).collect())
    assert got == [(n, k) for k, n in enumerate(sorted({n for n in names if n is not None}))]
    assert V.numbered(spark.createDataFrame([], "source string")).count() == 0


def brute(rows, score, resamples, seed):
    names = sorted({x for r in rows for x in r[3:] if x is not None})
    out = {}
    for b in range(resamples):
        m = Counter(names[int(hashlib.md5(f"{seed}-{b}-{j}".encode()).hexdigest()[:8], 16) % len(names)] for j in range(len(names)))
        for s in {r[0] for r in rows}:
            sums = [0] * 4
            for _, _, at, x, y in (r for r in rows if r[0] == s):
                w = m[x] if x == y else m[x] * m[y]
                sums[0 if x == y else 2] += w * (at == score)
                sums[1 if x == y else 3] += w
            a, n, c, k = sums
            known = n and k and (a or c)
            out[s, b] = None if not known else -math.inf if not a else math.inf if not c else math.log10((a / n) / (c / k))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_resamples_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "RESAMPLES", block)
    rows = comparisons(120, 9, 1)
    table = spark.createDataFrame(rows, DDL)
    sources = table.select(F.explode(F.array("source_a", "source_b")).alias("source"))
    found = V.resampled(table, 2, V.hashed_draws(spark, sources, 20, 5))
    got, want = {(r["set_name"], r["resample"]): r["log_ratio"] for r in found.collect()}, brute(rows, 2, 20, 5)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=1e-12)), k


@pytest.mark.parametrize("values", [[None] * 4, [1.0], [2.0] * 50 + [3.0], [float(k % 17) for k in range(400)] + [None, -math.inf, math.inf]])
def test_ranks_equal_those_of_a_sorted_list(spark, values):
    table = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)] + [("t", 0, 5.0)], "set_name string, resample int, log_ratio double")
    got = {r["set_name"]: tuple(r)[1:] for r in V.interval(table).collect()}
    v = sorted(x for x in values if x is not None)
    tail = (1 - V.LEVEL) / 2
    ends = (v[math.floor(tail * (len(v) - 1))], v[math.ceil((1 - tail) * (len(v) - 1))]) if v else (None, None)
    assert got == {"s": (*ends, values.count(None)), "t": (5.0, 5.0, 0)}


def test_a_sequence_too_long_for_the_driver_is_refused_and_hashed_draws_are_not(spark, monkeypatch):
    monkeypatch.setattr(V, "SEQUENTIAL", 100)
    rows = [r for r in comparisons(200, 20, 4) if r[0] == "a"] + [("a", 10, 2, "x", "x"), ("a", 10, 2, "x", "y")]
    table, p = spark.createDataFrame(rows, DDL), V.Propositions("same", "different", "some")
    with pytest.raises(Refusal, match="too-many-draws"):
        V.log_ratio(table, 2, propositions=p, evaluated=("v", "w"), resamples=30, seed=3)
    held = V.log_ratio(table, 2, propositions=p, evaluated=("v", "w"), resamples=30, seed=3, draws="hashed")
    assert held.low <= held.high and held.resamples == 30


def test_no_comparison_gives_no_interval(spark):
    table = spark.createDataFrame([], DDL)
    sources = table.select(F.col("source_a").alias("source"))
    assert V.interval(V.resampled(table, 2, V.hashed_draws(spark, sources, 20, 5))).count() == 0


def test_many_small_groups_equal_brute_force(spark, monkeypatch):
    for name, value in (("PAIRS", 5), ("SOURCES", 3), ("AT_ONCE", 2), ("RESAMPLES", 6)):
        monkeypatch.setattr(V, name, value, raising=False)
    rows = comparisons(150, 12, 8) + [("b", 10, 2, None, "hot"), ("b", 10, 2, "s001", None), ("nulls", 10, 1, None, None)]
    table = spark.createDataFrame(rows, DDL)
    sources = table.select(F.explode(F.array("source_a", "source_b")).alias("source"))
    found = V.resampled(table, 2, V.hashed_draws(spark, sources, 20, 5))
    got = {(r["set_name"], r["resample"]): r["log_ratio"] for r in found.collect()}
    want = brute([r for r in rows if r[3] and r[4]], 2, 20, 5) | {("nulls", k): None for k in range(20)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (v if v is None else pytest.approx(v, abs=1e-12)), k


def test_pairs_are_shuffled_without_their_weights(spark):
    table = spark.createDataFrame(comparisons(6000, 200, 1, hot=0.0), DDL)
    sources = table.select(F.explode(F.array("source_a", "source_b")).alias("source"))
    draws, before = cut(V.hashed_draws(spark, sources, 250, 5)), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = written(spark)
        assert V.interval(V.resampled(table, 2, draws)).count() == 2
        assert written(spark) - start < 200 * 6000  # a pair's weights alone take 2,000 bytes, before compression
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def written(spark):
    """Bytes that all stages up to now have written to shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))
