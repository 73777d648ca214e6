"""Sweeps by cell: rows before manifests, resumption, repetition from a manifest, reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from contourlake.errors import Refusal
from contourlake.operators import agreement as A
from contourlake.operators import placement as P
from contourlake.plans import manifest as N
from contourlake.plans import sweep as S
from contourlake.plans.profile import Profile
from contourlake.plans.steps import Applied, EdgeParameters
from contourlake.sources.surfaces import SURFACES

SEARCH, RULE = P.SearchParameters(2, 0.3, 0.0, 1.0, 2), A.AgreementRule(1.0, 1.0, 1.0, 0.3, "median")
PROFILE = Profile("frame", "1", "d", (Applied("trim-edge", EdgeParameters(4.0, "frame")),), ())
VARIED = "compare.cmc.correlation_threshold"


def pairs_of(spark, names, spoiled=()):
    rng = np.random.default_rng(5)
    sides = {"subject": [], "reference": []}
    for name in names:
        h = rng.normal(size=(16, 16))
        for side in sides:
            heights = [None] * 256 if name in spoiled else (h + (side == "reference")).ravel().tolist()
            sides[side].append((name, 16, 16, 4.0, 4.0, "um", "y-down", heights, []))
    s, r = (spark.createDataFrame(rows, SURFACES).withColumnRenamed("surface_id", "pair_id") for rows in sides.values())
    return P.paired(s, r)


def swept(spark, pairs, values, **changed):
    made = S.assigned(spark, PROFILE, SEARCH, RULE, [{VARIED: v, **changed} for v in values])
    named = pairs.select(F.col("pair_id").alias("pair"), (F.col("pair_id") < "c").alias("same_source"), F.lit(7).cast("long").alias("seed"))
    return S.cells_of("d", "1", made, named), made


def test_a_run_that_fails_midway_is_taken_up_at_its_missing_cells(spark, tmp_path):
    folder, names = str(tmp_path / "run"), ["a", "b", "c", "d"]
    whole, spoiled = pairs_of(spark, names), pairs_of(spark, names, spoiled={"c"})
    cells, made = swept(spark, whole, [0.3, 0.5])
    with pytest.raises(Exception, match="nothing-measured|no-match"):
        S.run_cells(cells, made, spoiled, PROFILE, folder, per_portion=1)
    before = {r["cell"] for r in S.finished(spark, folder).collect()}
    told = S.run_cells(cells, made, whole, PROFILE, folder, per_portion=3)
    assert told == {"computed": 8 - len(before), "reused": len(before), "total": 8}
    rows = S.finished(spark, folder).collect()
    assert len(rows) == 8 and len({r["cell"] for r in rows}) == 8 and all(r["congruent"] == 4 for r in rows)
    more, further = swept(spark, whole, [0.3, 0.5, 0.7])
    assert S.run_cells(more, further, whole, PROFILE, folder) == {"computed": 4, "reused": 8, "total": 12}
    assert S.run_cells(more, further, whole, PROFILE, folder) == {"computed": 0, "reused": 12, "total": 12}


def test_rows_without_their_manifest_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "run")
    pairs = pairs_of(spark, ["a", "b"])
    cells, made = swept(spark, pairs, [0.3])
    rows, _ = S.results(cells, made, pairs)
    rows.write.parquet(f"{folder}/rows/attempt=a-killed")
    assert S.finished(spark, folder).count() == 0
    assert S.run_cells(cells, made, pairs, PROFILE, folder)["computed"] == 2
    twice = spark.read.schema(S.ROWS).parquet(f"{folder}/rows").where("attempt != 'a-killed'").drop("attempt")
    twice.write.parquet(f"{folder}/rows/attempt=a-again")
    spark.read.schema(S.MANIFESTS).parquet(f"{folder}/manifests").drop("attempt").write.parquet(f"{folder}/manifests/attempt=a-again")
    assert S.finished(spark, folder).count() == 2 and S.manifests(spark, folder).count() == 2


def test_an_altered_row_is_computed_again(spark, tmp_path):
    folder = str(tmp_path / "run")
    pairs = pairs_of(spark, ["a", "b"])
    cells, made = swept(spark, pairs, [0.3])
    rows, records = S.results(cells, made, pairs)
    rows.withColumn("congruent", F.col("congruent") + (F.col("pair") == "a").cast("long")).write.parquet(f"{folder}/rows/attempt=a-1")
    marks = rows.select("cell", S._row_digest().alias("row_sha256")).join(records, "cell")
    marks.select("cell", "row_sha256", F.parse_json(S._manifest(PROFILE)).alias("manifest")).write.parquet(f"{folder}/manifests/attempt=a-1")
    assert [r["pair"] for r in S.finished(spark, folder).collect()] == ["b"]
    assert S.run_cells(cells, made, pairs, PROFILE, folder) == {"computed": 1, "reused": 1, "total": 2}


def test_repetition_from_a_manifest(spark, tmp_path):
    folder = str(tmp_path / "run")
    pairs = pairs_of(spark, ["a", "b"])
    cells, made = swept(spark, pairs, [0.3])
    S.run_cells(cells, made, pairs, PROFILE, folder)
    cell = S.finished(spark, folder).where("pair = 'a'").first()["cell"]
    S.rerun(spark, folder, cell, pairs)
    told = N.parse(S.manifests(spark, folder).where(F.col("cell") == cell).select(F.to_json("manifest")).first()[0])
    assert told.seed == 7 and [f["role"] for f in told.inputs] == ["subject", "reference"] and told.comparison == A.record(SEARCH, RULE)
    other = pairs.withColumn("r_heights", F.transform("r_heights", lambda h: h + 1))
    for reason, call in (("other-input", lambda: S.rerun(spark, folder, cell, other)), ("unknown-cell", lambda: S.rerun(spark, folder, "none", pairs))):
        with pytest.raises(Refusal) as e:
            call()
        assert e.value.reason == reason


def test_both_consensus_rules_as_columns(spark):
    pairs = pairs_of(spark, ["a", "b"])
    mode = {"compare.cmc.consensus": "histogram-mode", "compare.cmc.translation_bin": 2.0, "compare.cmc.rotation_bin_deg": 4.0}
    cells, made = swept(spark, pairs, [0.3], **mode)
    plain, more = swept(spark, pairs, [0.3, 0.999999])
    rows, _ = S.results(cells.union(plain), made.union(more), pairs)
    rule = A.AgreementRule(1.0, 1.0, 1.0, 0.3, "histogram-mode", 2.0, 4.0)
    assert {json.loads(r["assignment"]).get("compare.cmc.consensus") for r in rows.collect()} == {None, "histogram-mode"}
    trimmed = S.prepared(made.select("chain").crossJoin(pairs.select(F.col("pair_id").alias("pair"))), pairs).withColumnRenamed("pair", "pair_id")
    expected = {r["pair_id"]: r["congruent"] for r in A.score(P.registrations(trimmed, SEARCH), rule).collect()}
    assert {r["pair"]: r["congruent"] for r in rows.where("assignment LIKE '%mode%'").collect()} == expected


def test_refusals_before_anything_runs(spark):
    for changed, reason in (({"compare.cmc.down_threshold": -1.0}, "out-of-range"), ({"trim-edge.width": 0.0}, "out-of-range"), ({"compare.register.grid": 0}, "out-of-range")):
        with pytest.raises(Refusal) as e:
            S.assigned(spark, PROFILE, SEARCH, RULE, [changed])
        assert e.value.reason == reason
    with pytest.raises(Refusal):
        S.assigned(spark, PROFILE, SEARCH, RULE, [])


def test_reports_and_inputs(spark, tmp_path):
    folder = str(tmp_path / "run")
    pairs = pairs_of(spark, ["a", "b", "c"])
    cells, made = swept(spark, pairs, [0.3, 1.0])
    S.run_cells(cells, made, pairs, PROFILE, folder)
    got = {(r[0], r["grouping"]): (r["cells"], r["same_source"]) for r in S.report(S.finished(spark, folder), [VARIED]).collect()}
    assert got == {("0.3", 0): (3, 2), ("1.0", 0): (3, 2), (None, 1): (6, 4)}
    made = S.manifests(spark, folder)
    files, few = N.digests(made), N.digests(made).limit(11)
    assert files.count() == 12 and N.unequal(files, files).count() == 0 and N.unequal(files, few).select("side").collect() == [("one",)]
    assert N.steps(made).where("identifier = 'trim-edge' AND pos = 0").count() == 6


def test_the_plan_does_not_grow_with_cells(spark):
    sizes = []
    for n in (2, 200):
        pairs = pairs_of(spark, ["a"])
        cells, made = swept(spark, pairs, [k / 1000 for k in range(n)])
        known = cells.join(made, "assignment").select("chain", "pair").distinct()
        sizes.append(len(S.prepared(known, pairs)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]
