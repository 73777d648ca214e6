import dataclasses
import json

import numpy as np
import pytest

from contourlake.errors import Refusal
from contourlake.operators import agreement as A
from contourlake.operators import evidence as V
from contourlake.operators import placement as P
from contourlake.operators.wording import conclusion_fields, conclusion_words
from contourlake.plans import audit, design, manifest, profile, steps, sweep
from contourlake.plans.steps import STEPS, Applied, BandParameters, EdgeParameters, Field, LevelParameters, OutlierParameters, Registry, TrimEdge, check_chain
from contourlake.sources import container
from contourlake.sources.surfaces import SURFACES
from contourlake.sources.synthetic import FieldParameters, generate, generated, matching, non_matching, parameter_table
from contourlake.streaming import arrivals


def refused(reason, call, *args, **kwargs):
    with pytest.raises(Refusal) as e:
        call(*args, **kwargs)
    assert e.value.reason == reason


def test_chains_are_checked_before_they_run():
    trim, band = Applied("trim-edge", EdgeParameters(4.0, "frame")), Applied("bandpass", BandParameters(8.0, 40.0, None, None))
    assert [s for s in check_chain([trim, band]).values()] == ["trim-edge", "bandpass"]
    refused("too-late", check_chain, [band, trim])
    refused("empty-chain", check_chain, [])
    refused("unknown-step", check_chain, [Applied("polish", EdgeParameters(4.0, "frame"))])
    refused("wrong-record", check_chain, [Applied("bandpass", EdgeParameters(4.0, "frame"))])
    refused("registered-twice", Registry([TrimEdge()]).register, TrimEdge())
    assert [s.identifier for s in STEPS] == ["bandpass", "level", "mask-firing-pin", "mask-marks", "reject-outliers", "trim-edge"]


@pytest.mark.parametrize(
    ("step", "parameters", "reason"),
    [
        ("trim-edge", EdgeParameters(True, "frame"), "not-a-number"),
        ("trim-edge", EdgeParameters(float("nan"), "frame"), "not-finite"),
        ("trim-edge", EdgeParameters(4.0, "round"), "unknown-choice"),
        ("level", LevelParameters("plane", 2, None, None), "unused-parameter"),
        ("level", LevelParameters("polynomial", 1, None, None), "out-of-range"),
        ("level", LevelParameters("plane", None, 4.0, None), "half-robust"),
        ("bandpass", BandParameters(40.0, 8.0, None, None), "cutoffs-out-of-order"),
        ("reject-outliers", OutlierParameters("standard-deviation", 0.0, None), "out-of-range"),
    ],
)
def test_parameters_are_checked(step, parameters, reason):
    refused(reason, check_chain, [Applied(step, parameters)])


def test_search_and_rule_checks():
    refused("step-does-not-divide", P.check_search, P.SearchParameters(4, 0.5, 10.0, 3.0, 4))
    refused("out-of-range", P.check_search, P.SearchParameters(4, 0.0, 10.0, 2.0, 4))
    refused("not-a-whole-number", P.check_search, P.SearchParameters(4.0, 0.5, 10.0, 2.0, 4))
    refused("unused-parameter", A.check_rule, A.AgreementRule(1.0, 1.0, 1.0, 0.5, "median", 2.0))
    refused("not-a-number", A.check_rule, A.AgreementRule(1.0, 1.0, 1.0, 0.5, "histogram-mode"))
    refused("grid-too-fine", P.work, (3, 3), P.SearchParameters(4, 0.5, 0.0, 1.0, 4))


def test_unlike_surfaces_are_not_compared(spark):
    def table(unit):
        return spark.createDataFrame([("p", 8, 8, 1.0, 1.0, unit, "y-down", [float(i % 7) for i in range(64)], [])], SURFACES).selectExpr("surface_id AS pair_id", "*")

    with pytest.raises(Exception, match="not-comparable"):
        P.compare(P.paired(table("um"), table("nm")), P.CellParameters(2, 0.5)).collect()


def test_containers(spark, tmp_path):
    h = np.array([[1.5, -2.25, 3.0], [np.nan, 5.5, 6.125]])
    record = {"name": "trim-edge", "version": "1", "parameters": '{"width": 4.0}', "outcomes": "{}"}
    content = container.encode(h, 4.0, 2.5, "y-up", [record])
    assert content == container.encode(h, 4.0, 2.5, "y-up", [record])
    found = container.decode(content)
    assert np.allclose(found["heights"], h, rtol=0, atol=1e-9, equal_nan=True) and np.isnan(found["heights"][1, 0])
    assert (found["spacing_y"], found["orientation"], found["provenance"]) == (pytest.approx(4.0), "y-up", [record])
    surfaces = spark.createDataFrame([("a/b", 2, 3, 4.0, 2.5, "um", "y-up", [None if np.isnan(x) else float(x) for x in h.ravel()], [tuple(record.values())])], SURFACES)
    assert container.write(surfaces, f"file://{tmp_path}/out").count() == 1
    (tmp_path / "out" / "broken.x3p").write_bytes(b"nothing")
    rows = {r["surface_id"].rsplit("/", 1)[-1]: r for r in container.read(spark, f"file://{tmp_path}/out").collect()}
    assert rows["broken.x3p"]["refused"] == "not-a-container" and rows["a_b.x3p"]["refused"] is None
    assert rows["a_b.x3p"]["heights"][3] is None
    with pytest.raises(Exception, match="not-a-container"):
        container.read(spark, f"file://{tmp_path}/out", strict=True).collect()


def rezipped(content, change):
    import io
    import zipfile

    source = zipfile.ZipFile(io.BytesIO(content))
    entries = {n: source.read(n) for n in source.namelist()}
    change(entries)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in entries.items():
            z.writestr(n, b)
    return out.getvalue()


def swap(old, new):
    def change(entries):
        entries["main.xml"] = entries["main.xml"].replace(old.encode(), new.encode(), 1)

    return change


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda e: e.pop("main.xml"), "no-metadata-document"),
        (lambda e: e.update({"deep/MAIN.xml": e["main.xml"]}), "several-metadata-documents"),
        (lambda e: e.update({"../up": b""}), "entry-outside-the-archive"),
        (lambda e: e.update({"main.xml": b"<a>"}), "not-xml"),
        (lambda e: e.update({"main.xml": b"<!DOCTYPE a><a/>"}), "document-type-declaration"),
        (lambda e: e.update({"bindata/data.bin": b"\0" * 48}), "point-data-checksum-mismatch"),
        (lambda e: e.pop("bindata/data.bin"), "element-missing"),
        (swap("<p:SizeX>3", "<p:SizeX>4"), "size-disagrees-with-the-payload"),
        (swap("<p:SizeZ>1", "<p:SizeZ>2"), "recognised-and-unsupported"),
        (swap("<p:SizeY>2", "<p:SizeY>two"), "not-a-number"),
        (swap("2.5e-06", "-2.5e-06"), "increment-not-positive"),
        (swap("<p:AxisType>A", "<p:AxisType>R"), "recognised-and-unsupported"),
        (swap("<p:AxisType>A</p:AxisType>", ""), "element-missing"),
        (swap("2.5e-06", "inf"), "not-a-number"),
    ],
)
def test_containers_are_refused_for_their_reason(change, reason):
    content = container.encode(np.arange(6.0).reshape(2, 3), 4.0, 2.5)
    refused(reason, container.decode, rezipped(content, change))


def test_heights_that_cannot_be():
    refused("height-range-implausible", container.decode, container.encode(np.array([[0.0, 2000.0]]), 1.0, 1.0))
    refused("height-not-finite", container.decode, container.encode(np.array([[0.0, np.inf]]), 1.0, 1.0))
    assert np.isnan(container.decode(container.encode(np.full((2, 2), np.nan), 1.0, 1.0))["heights"]).all()


def a_profile():
    def source(p):
        return {f.name: {"origin": "stated", "where": "x", "confidence": "high"} for f in dataclasses.fields(p)}

    chain = [("trim-edge", EdgeParameters(8.0, "frame")), ("level", LevelParameters("plane", None, None, None))]
    return {"name": "small", "version": "1", "description": "d", "steps": [{"transform": n, "parameters": dataclasses.asdict(p), "sources": source(p)} for n, p in chain]}


def test_profiles(tmp_path):
    text = json.dumps(a_profile())
    found = profile.parse(text, stem="small")
    assert [a.identifier for a in found.chain] == ["trim-edge", "level"]
    assert profile.unprofiled([found]) == ["bandpass", "mask-firing-pin", "mask-marks", "reject-outliers"]
    refused("named-otherwise", profile.parse, text, stem="large")
    data = a_profile()
    data["steps"][0]["parameters"]["extra"] = 1
    refused("keys-differ", profile.parse, json.dumps(data))
    data = a_profile()
    data["steps"][0]["parameters"]["width"] = True
    refused("wrong-type", profile.parse, json.dumps(data))
    data = a_profile()
    data["steps"][0]["parameters"]["width"] = 8
    assert profile.parse(json.dumps(data)).chain[0].parameters.width == 8.0
    (tmp_path / "small.json").write_text(text)
    assert profile.load_folder(tmp_path)[0].name == "small"


def test_manifests():
    field = Field(generate(FieldParameters(rows=48, columns=48, seed=3)), 4.0, 4.0)
    out, made = manifest.record_run(field, profile.parse(json.dumps(a_profile())), 3)
    again = manifest.parse(made.text())
    assert again == made and np.array_equal(manifest.rerun(again, field).h, out.h, equal_nan=True)
    refused("other-input", manifest.rerun, again, Field(field.h + 1, 4.0, 4.0))
    refused("other-schema", manifest.parse, made.text().replace('"schema_version": 4', '"schema_version": 5'))
    refused("keys-differ", manifest.parse, json.dumps({k: v for k, v in json.loads(made.text()).items() if k != "seed"}))
    refused("other-version", manifest.resolve, manifest.parse(made.text().replace('"identifier": "level",\n      "version": "1"', '"identifier": "level",\n      "version": "2"')))


def a_design():
    base = sweep.base_of(profile.parse(json.dumps(a_profile())), P.SearchParameters(3, 0.5, 2.0, 2.0, 4), A.AgreementRule(2.0, 2.0, 2.0, 0.3, "median"))
    return design.Design("small", "1", "one-at-a-time", base, {"trim-edge.width": [8.0, 16.0], "compare.cmc.down_threshold": [1.0, 2.0]}, (design.Pair("m", "matching", 1), design.Pair("n", "non-matching", 2)), {"rows": 64, "columns": 64})


def test_designs(spark):
    d = a_design()
    bounds = {"trim-edge.width": design.Bound("float", 4.0, 400.0), "compare.cmc.down_threshold": design.Bound("float", 0.0, 20.0)}
    d.check(bounds)
    assert len(d.assignments()) == 3 and d.cells(spark).count() == 6
    assert len(dataclasses.replace(d, generator="full-factorial").assignments()) == 4
    refused("outside-its-range", dataclasses.replace(d, vary={"trim-edge.width": [1.0, 8.0]}).check, bounds)
    refused("values-not-distinct", dataclasses.replace(d, vary={"trim-edge.width": [8.0, 8.0]}).check, bounds)
    refused("undeclared-parameter", dataclasses.replace(d, vary={"level.order": [2, 3]}).check, bounds)
    refused("seed-in-surface", dataclasses.replace(d, surface={"seed": 1}).check, bounds)
    bound = design.Bound("int", 2, 4)
    assert bound.spread(3) == [2, 3, 4] and bound.admits(3) and not bound.admits(3.0) and not bound.admits(True) and not bound.admits(None)
    refused("points-coincide", bound.spread, 5)


def test_sweeps_resume_and_repeat(spark, tmp_path):
    d, p = a_design(), profile.parse(json.dumps(a_profile()))
    search, rule = P.SearchParameters(3, 0.5, 2.0, 2.0, 4), A.AgreementRule(2.0, 2.0, 2.0, 0.3, "median")
    folder = str(tmp_path / "run")
    assert sweep.run(spark, d, p, search, rule, folder) == {"computed": 6, "reused": 0, "total": 6}
    assert sweep.run(spark, d, p, search, rule, folder) == {"computed": 0, "reused": 6, "total": 6}
    cell = sweep.finished(spark, folder).first()["cell"]
    sweep.rerun_cell(spark, d, p, search, rule, folder, cell)
    sweep.write_table(spark, folder, list(d.vary), str(tmp_path / "csv"))
    head = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert head[0] == "cell,pair,same_source,compare.cmc.down_threshold,trim-edge.width,congruent,eligible,discarded" and len(head) == 7
    assert [x.split(",")[0] for x in head[1:]] == sorted(x.split(",")[0] for x in head[1:])


def comparisons(spark, rows, cells=20):
    return spark.createDataFrame([("s", cells, s, a, b) for s, a, b in rows], "set_name string, n_cells int, score int, source_a string, source_b string")


def test_evidence(spark):
    eight = [(14 + i % 3, str(i), str(i)) for i in range(8)] + [((i + j) % 4, str(i), str(j)) for i in range(8) for j in range(i + 1, 8)]
    rows = comparisons(spark, eight)
    at = {(r["proposition"], r["score"]): r["frequency"] for r in V.score_distribution(rows).collect()}
    assert at["same-source", 14] == 3 / 8 and at["same-source", 0] == 0 and len(at) == 42
    bound = V.supportable_range(rows).first()
    assert bound["high"] == pytest.approx(np.log10(8)) and bound["low"] == pytest.approx(-np.log10(8))
    ten = [(8 if i % 2 == 0 else 10, str(i), str(i)) for i in range(10)] + [(8 if (i + j) % 2 == 0 else 6, str(i), str(j)) for i in range(10) for j in range(i + 1, 10)]
    rows = comparisons(spark, ten)
    assert {(r["proposition"], r["pairs"], r["sources"]) for r in V.proposition_counts(rows).collect()} == {("same-source", 10, 10), ("different-source", 45, 10)}
    p = V.Propositions("same", "different", "some")
    held = V.log_ratio(rows, 10, propositions=p, evaluated=("x", "y"), resamples=20, seed=1)
    assert held.raw == float("inf") and held.value == pytest.approx(1.0) and held.width == float("inf") and "held" in str(held)
    refused("quoted-alone", format, held, ".2f")
    refused("reference-touches-the-pair", V.log_ratio, rows, 10, propositions=p, evaluated=("3", "y"), resamples=20, seed=1)
    refused("no-ratio", V.log_ratio, rows, 3, propositions=p, evaluated=("x", "y"), resamples=20, seed=1)
    refused("equal-propositions", V.Propositions, "a", "a", "b")
    two = comparisons(spark, [(5, "a", "a"), (5, "b", "b"), (3, "a", "b")])
    assert V.log_ratio(two, 5, propositions=p, evaluated=("x", "y"), resamples=200, seed=7).unusable == 105


def test_generated_pairs(spark):
    base = FieldParameters(rows=32, columns=32)
    rows = {r["surface_id"]: r for r in generated(parameter_table(spark, matching("m", base) + non_matching("n", base))).collect()}
    assert len(rows) == 4 and rows["m/subject"]["heights"] == rows["n/subject"]["heights"] != rows["m/reference"]["heights"]


def test_wording(spark):
    text = "a match\nno Matching [cited: someone] here\nthe identifier\x0bIdentified, excluded-match Ident\nmatchbox is a name"
    rows = spark.createDataFrame([("d", text), ("e", None)], "source string, text string")
    got = {(r["line"], r["column"], r["word"]) for r in conclusion_words(rows, "source", "text", names=("matchbox",)).collect()}
    assert got == {(1, 3, "match"), (4, 1, "Identified"), (4, 13, "excluded"), (4, 22, "match")}
    schema = spark.createDataFrame([], "is_match boolean, exclude_x string, nested struct<identified: boolean, identifier: boolean>").schema
    assert conclusion_fields(schema) == ["is_match", "nested.identified"]


def test_audit():
    assert audit.unregistered(steps) == []
    assert audit.undeclared_numbers(steps) == []


def test_stream_takes_each_container_once(spark, tmp_path):
    table = generated(parameter_table(spark, matching("m", FieldParameters(rows=24, columns=24))))
    container.write(table, f"file://{tmp_path}/in").count()
    chain = [Applied("level", LevelParameters("plane", None, None, None))]
    for _ in range(2):
        arrivals.preprocess(spark, f"file://{tmp_path}/in", chain, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 2 and all(r["provenance"][-1]["name"] == "level" for r in rows)
