"""Comparisons without an answer fail; what is counted while rows go by is right."""

import numpy as np
import pytest
from contourlake.operators import guards as G
from contourlake.operators import masks as M
from contourlake.operators import placement as P
from contourlake.sources.surfaces import samples
from pyspark.sql import Observation
from pyspark.sql import functions as F

from .test_tiles import field, table

CELLS, SEARCH = P.CellParameters(3, 0.5), P.SearchParameters(3, 0.5, 2.0, 2.0, 1)


def pairs(spark, subjects, references):
    named = F.col("surface_id").alias("pair_id")
    return P.paired(table(spark, subjects).select(named, "*"), table(spark, references).select(named, "*"))


def test_pairs_with_answers_pass(spark):
    h = field(24, 24, 0.0, 1)
    both = pairs(spark, {"a": h, "b": field(24, 24, 0.0, 2)}, {"a": h, "b": h})
    key = ("pair_id", "cell_r", "cell_c", "down", "across")
    assert {tuple(r) for r in G.compare(both, CELLS).select(*key).collect()} == {tuple(r) for r in P.compare(both, CELLS).select(*key).collect()}
    assert G.register(both, SEARCH).where("pair_id = 'a' AND down = 0 AND across = 0").count() == 9


def test_no_usable_cell_fails(spark):
    h = field(24, 24, 0.0, 1)
    holed = np.where(np.arange(24)[None, :] % 3 > 0, np.nan, h)
    both = pairs(spark, {"a": h, "b": holed}, {"a": h, "b": h})
    for f, p in ((G.compare, CELLS), (G.register, SEARCH)):
        with pytest.raises(Exception, match="no-usable-cell: b"):
            f(both, p).collect()
    assert {r["pair_id"]: (r["usable"], r["correlations"]) for r in G.work_of(both, SEARCH).collect()} == {"a": (9, 27), "b": (0, 0)}


def test_no_match_at_all_fails(spark):
    h = field(24, 24, 0.0, 1)
    both = pairs(spark, {"a": h, "c": h}, {"a": h, "c": np.zeros((24, 24))})
    for f, p in ((G.compare, CELLS), (G.register, SEARCH)):
        with pytest.raises(Exception, match="no-match: c"):
            f(both, p).collect()


def test_outcomes_are_counted_in_the_same_pass(spark):
    rows, seen = samples(table(spark, {"a": field(24, 24, 0.3, 1), "b": field(9, 9, 0.1, 2)})), Observation()
    got = G.masked(rows, M.disc(0.0, 0.0, 9.0), seen).where("h IS NOT NULL").count()
    counts = seen.get
    assert counts["measured_samples"] == rows.where("h IS NOT NULL").count() and counts["measured_samples"] - counts["masked_samples"] == got > 0
