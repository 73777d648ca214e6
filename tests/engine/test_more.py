import dataclasses
import json
import math
import random

import numpy as np
import pytest

from contourlake import queries
from contourlake.errors import Refusal
from contourlake.functions import heights as H
from contourlake.operators import agreement as A
from contourlake.operators import evidence as V
from contourlake.operators import placement as P
from contourlake.plans import design, manifest
from contourlake.plans.determinism import seeded_only
from contourlake.plans.steps import Field
from contourlake.sources import container
from contourlake.sources import format as container_format
from contourlake.sources.synthetic import FieldParameters, generate, generated, matching, parameter_table

from .test_plans import a_profile, refused


def test_shared_generators_are_refused():
    with seeded_only():
        assert np.random.default_rng(1).normal() == pytest.approx(0.345584192064786)
        generate(FieldParameters(rows=16, columns=16))
        for draw in (np.random.default_rng, np.random.rand, random.random):
            with pytest.raises(Refusal):
                draw()
    assert 0 <= random.random() < 1


def test_window_callable_is_the_local_median():
    h = np.random.default_rng(2).normal(size=(12, 15))
    h[3, 4] = np.nan
    centre, _ = H.centre_and_spread(h, "median-absolute-deviation", (1, 2))
    assert np.allclose(H.windowed(h, 1, 2, np.median), centre)


def test_components_and_holes():
    mask = np.array([[1, 1, 0, 0, 1], [1, 0, 1, 0, 1], [1, 1, 1, 0, 1], [0, 0, 0, 0, 1], [1, 0, 1, 1, 1]], bool)
    assert H.labelled(mask).tolist() == [[1, 1, 0, 0, 2], [1, 0, 1, 0, 2], [1, 1, 1, 0, 2], [0, 0, 0, 0, 2], [3, 0, 2, 2, 2]]
    ring = np.ones((5, 5), bool)
    ring[2, 2] = ring[0, 0] = False
    assert H.filled(ring).sum() == 24


def test_designs_from_documents(tmp_path):
    (tmp_path / "small.json").write_text(json.dumps(a_profile()))
    data = {
        "name": "try", "version": "1", "description": "d", "generator": "full-factorial", "profile": "small.json", "surface": {"rows": 64, "columns": 64},
        "search": dataclasses.asdict(P.SearchParameters(3, 0.5, 2.0, 2.0, 4)), "rule": dataclasses.asdict(A.AgreementRule(1.0, 1.0, 1.0, 0.5, "median")),
        "pairs": [{"name": "m", "kind": "matching", "seed": 1}],
        "vary": [{"parameter": "trim-edge.criterion"}, {"parameter": "trim-edge.width", "points": 3}, {"parameter": "compare.register.grid", "values": [3, 4]}],
    }
    bounds = design.ranges({"parameters": {"trim-edge.criterion": {"kind": "set", "values": ["frame", "grow"]}, "trim-edge.width": {"kind": "float", "lower": {"value": 4.0}, "upper": {"value": 12.0}}, "compare.register.grid": {"kind": "int", "lower": 3, "upper": 12}}})
    path = tmp_path / "try.json"
    path.write_text(json.dumps(data))
    found, profile, search, rule = design.load(path, bounds=bounds)
    assert len(found.assignments()) == 12 and found.vary["trim-edge.width"] == [4.0, 8.0, 12.0] and profile.name == "small"
    record = A.record(search, rule)
    assert record["method"] == "congruent-matching-cells" and list(record["parameters"]) == sorted(record["parameters"])
    path.write_text(json.dumps(data | {"vary": [{"parameter": "trim-edge.width"}]}))
    refused("no-values", design.load, path, bounds=bounds)
    path.write_text(json.dumps({k: v for k, v in data.items() if k != "rule"}))
    refused("keys-differ", design.load, path, bounds=bounds)


def test_manifests_as_a_table(spark, tmp_path):
    from contourlake.plans.profile import parse

    _, made = manifest.record_run(Field(generate(FieldParameters(rows=48, columns=48, seed=3)), 4.0, 4.0), parse(json.dumps(a_profile())), 3)
    (tmp_path / "a.manifest.json").write_text(made.text())
    row = manifest.scan(spark, str(tmp_path)).first()
    assert (row["schema_version"], row["seed"], row["profile"]["name"]) == (4, 3, "small")


def test_data_source_and_pairs(spark, tmp_path):
    fields = generated(parameter_table(spark, matching("p", FieldParameters(rows=48, columns=48))))
    container.write(fields, f"file://{tmp_path}/in").count()
    container_format.register(spark)
    found = spark.read.format("surface-container").load(f"file://{tmp_path}/in")
    assert found.count() == 2 and found.columns == fields.columns
    side = found.selectExpr("'p' AS pair_id", "surface_id LIKE '%subject%' AS first", "*")
    pairs = P.paired(side.where("first"), side.where("NOT first"))
    search = P.SearchParameters(2, 0.5, 2.0, 2.0, 4)
    scored, record = A.score_pairs(pairs, search, A.AgreementRule(4.0, 4.0, 4.0, -1.0, "median"))
    high, other = A.score_pairs(pairs, search, A.HighAgreementRule(4.0, 4.0, -1.0, "median", 0))
    assert scored.first()["eligible"] == high.first()["eligible"] == 4 and record["method"] != other["method"]


def test_interval_of_200_resamples_leaves_the_extremes_out(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [("s", str(rng.randrange(12)), str(rng.randrange(12)), rng.randrange(5, 9)) for _ in range(400)]
    table = spark.createDataFrame(rows, "set_name string, source_a string, source_b string, score int")
    monkeypatch.setattr(queries, "comparisons", lambda s, d: table)
    sources = table.selectExpr("explode(array(source_a, source_b)) AS source")
    draws = sorted(r["log_ratio"] for r in V.resampled(table, 7, V.hashed_draws(spark, sources, 200, 11)).collect() if r["log_ratio"] is not None)
    (found,) = queries.QUERIES["bootstrap_interval_200"](spark, str(tmp_path)).collect()
    last = len(draws) - 1
    assert last > 150 and found["unusable"] == 200 - len(draws)
    assert [found["low"], found["high"]] == pytest.approx([draws[math.floor(0.025 * last)], draws[math.ceil(0.975 * last)]], abs=1e-6)
    assert draws[0] < found["low"] < found["high"] < draws[-1]


def test_nearly_flat_fields_far_from_zero_have_no_correlation():
    rng = np.random.default_rng(5)
    noise = rng.normal(size=(24, 24))
    for spread, found in ((1e-7, False), (1.0, True)):
        h = 1000.0 + spread * noise
        searched = H.Searched(h, 2)
        assert (searched.place(h[6:14, 6:14], 6, 6, 1) is not None) == found
        assert bool(list(H.compared(h, h, 3, 0.5))) == found
        assert bool(list(H.placements(h, h, 0.0, 3, 0.5, 2))) == found
        x = h[6:14, 6:14].ravel()
        assert (np.var(x) > H.FLAT * np.mean(x * x)) == found
