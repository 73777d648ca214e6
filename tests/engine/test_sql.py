"""Chains called from SQL text."""

import math

import numpy as np
import pytest

from contourlake.errors import Refusal
from contourlake.plans import sql as Q
from contourlake.plans.steps import Applied, EdgeParameters, LevelParameters, run_chain
from contourlake.sources.surfaces import SURFACES, samples

CHAIN = [Applied("trim-edge", EdgeParameters(4.0, "frame")), Applied("level", LevelParameters("plane", None, None, None))]


def fields(spark):
    rng, rows = np.random.default_rng(3), []
    for name, shape in (("a", (8, 6)), ("b", (5, 9)), ("b2", (5, 9))):
        h = [None if k % 11 == 3 else float(v) for k, v in enumerate(rng.normal(size=shape).ravel())]
        rows.append((name, *shape, 4.0, 4.0, "um", "y-down", h, []))
    return spark.createDataFrame(rows, SURFACES)


def called(spark, table, text):
    return spark.sql("SELECT f.surface_id, s.* FROM {f} AS f, LATERAL preprocessed(f.n_rows, f.n_cols, f.spacing_y, f.spacing_x, f.heights, {t}) AS s", f=table, t=text)


def test_samples_equal_those_of_the_chain(spark):
    from pyspark.sql import functions as F

    Q.register(spark)
    key = lambda r: (r["surface_id"], r["r"], r["c"])
    got = sorted(called(spark, fields(spark), Q.chain_text(CHAIN)).collect(), key=key)
    want = sorted(samples(run_chain(fields(spark), CHAIN)).select("surface_id", "r", "c", "h").collect(), key=key)
    assert len(got) == 48 + 45 + 45 and [key(r) for r in got] == [key(r) for r in want]
    assert all((a["h"] is None) == (b["h"] is None) and (a["h"] is None or math.isclose(a["h"], b["h"], abs_tol=1e-12)) for a, b in zip(got, want, strict=True))
    assert called(spark, fields(spark).limit(0), Q.chain_text(CHAIN)).count() == 0
    assert called(spark, fields(spark).withColumn("heights", F.lit(None).cast("array<double>")), Q.chain_text(CHAIN)).count() == 0
    with pytest.raises(Exception, match="empty-chain"):
        called(spark, fields(spark), "[]").collect()


def test_chains_as_text():
    assert Q.chain_of(Q.chain_text(CHAIN)) == CHAIN
    with pytest.raises(Refusal):
        Q.chain_of('[["no-such-step", {}]]')
