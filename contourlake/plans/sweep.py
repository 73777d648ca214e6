"""Sweeps: every cell is an assignment of parameters on a pair, computed once, its row written before its manifest.

Parameters travel as columns, so the plan is the same for any number of cells. Cells that differ in a rule
share a registration, and those that differ in a search share their preprocessed fields.

A run is cut into portions, and each makes an attempt of its own: the rows under ``rows/attempt=...``, then,
read back, the manifests under ``manifests/attempt=...``. A cell is finished if a manifest has the digest of
a row of the same attempt. So what a killed run leaves of an attempt counts as far as it was marked, and no
further; the next run computes the other cells, and a cell that two runs marked has the row of one of them.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refusal, whole
from ..functions import heights as H
from ..operators.agreement import AgreementRule, check_rule, score_each
from ..operators.agreement import record as comparison_record
from ..operators.placement import SIDE, SearchParameters, best_over_angles, check_search, field_of, paired, registrations_each
from ..sources.container import digest
from ..sources.surfaces import heights_array
from ..sources.synthetic import FieldParameters, generated, matching, non_matching, parameter_table
from . import manifest as N
from .design import Design, outstanding
from .profile import Profile, record
from .scratch import cut
from .steps import STEPS, Applied, Field, Registry, apply_chain, check_chain, compact

SEARCH, RULE = "compare.register.", "compare.cmc."
RESULT = ("cell", "pair", "same_source", "assignment", "congruent", "eligible", "discarded")
ROWS = "cell string, pair string, same_source boolean, assignment string, congruent long, eligible long, discarded long, attempt string"
MANIFESTS = "cell string, row_sha256 string, manifest variant, attempt string"
RULES = "down_threshold double, across_threshold double, rotation_threshold_deg double, correlation_threshold double, consensus string, translation_bin double, rotation_bin_deg double"
ASSIGNED = f"assignment string, chain string, search string, grid int, minimum_valid double, translation_limit int, angles array<double>, {RULES}, comparison string"
DIGESTS = ("s_before", "r_before", "s_after", "r_after", "steps")


def base_of(profile: Profile, search: SearchParameters, rule: AgreementRule) -> dict[str, Any]:
    """Every parameter by its dotted name."""
    out = {f"{a.identifier}.{k}": v for a in profile.chain for k, v in dataclasses.asdict(a.parameters).items()}
    for prefix, values in ((SEARCH, search), (RULE, rule)):
        out |= {prefix + k: v for k, v in dataclasses.asdict(values).items()}
    return out


def _with(values: Any, prefix: str, assignment: dict[str, Any]) -> Any:
    return dataclasses.replace(values, **{k.removeprefix(prefix): v for k, v in assignment.items() if k.startswith(prefix)})


def _assigned(chain: list[Applied], search: SearchParameters, rule: AgreementRule, assignment: str, registry: Registry) -> tuple:
    check_chain(chain, registry)
    check_search(search)
    check_rule(rule)
    limits = [float(v) if isinstance(v, int) else v for v in dataclasses.astuple(rule)]
    angles = [float(a) for a in H.angles(search.rotation_range_deg, search.rotation_step_deg)]
    steps = compact([[a.identifier, dataclasses.asdict(a.parameters)] for a in chain])
    return (assignment, steps, compact(dataclasses.asdict(search)), search.grid, float(search.minimum_valid), search.translation_limit, angles, *limits, compact(comparison_record(search, rule)))


def assigned(spark: SparkSession, profile: Profile, search: SearchParameters, rule: AgreementRule, assignments: list[dict[str, Any]], registry: Registry = STEPS) -> DataFrame:
    """A row for each assignment, with all parameters as columns; any that can't run is refused here."""
    if not assignments:
        raise Refusal("no-assignments")
    rows = []
    for a in assignments:
        chain = [Applied(x.identifier, _with(x.parameters, x.identifier + ".", a)) for x in profile.chain]
        rows.append(_assigned(chain, _with(search, SEARCH, a), _with(rule, RULE, a), compact(a), registry))
    return spark.createDataFrame(rows, ASSIGNED)


def cells_of(name: str, version: str, assignments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every assignment on every pair of a table (pair, same_source, seed): (cell, pair, same_source, seed, assignment)."""
    numbered = assignments.select("assignment").orderBy("assignment").collect()  # a design's values, not its cells
    texts = assignments.sparkSession.createDataFrame([(k, r[0]) for k, r in enumerate(numbered)], "_a int, assignment string")
    each = pairs.select("pair", "same_source", "seed", F.explode(F.sequence(F.lit(0), F.lit(len(numbered) - 1))).alias("_a")).join(texts, "_a")
    named = F.to_json(F.struct(F.lit(name).alias("design"), F.lit(version).alias("version"), "pair", "assignment"))
    return each.select(F.sha2(named, 256).alias("cell"), "pair", "same_source", "seed", "assignment")


def prepared(wanted: DataFrame, pairs: DataFrame, registry: Registry = STEPS) -> DataFrame:
    """Both fields of each wanted (chain, pair) after the chain, with digests of before and after and the subject's steps."""
    heights = pa.list_(pa.float64())
    joined = wanted.join(pairs.withColumnRenamed("pair_id", "pair"), "pair").select("chain", "pair", *(f"{s}_{c}" for s in "sr" for c in SIDE))
    schema = "chain string, pair string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema[2:]) + ", " + ", ".join(f"{d} string" for d in DIGESTS)

    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {n: (c[0].values.to_numpy(zero_copy_only=False) if n.endswith("heights") else c[0].as_py()) for n, c in zip(one.schema.names, one.columns, strict=True)}
                chain = [Applied(i, record(registry[i].parameters, p, i)) for i, p in json.loads(row["chain"])]
                new, steps = {}, []
                for side in "rs":
                    before = field_of(row, side)
                    after, steps = apply_chain(Field(before, row[f"{side}_spacing_y"], row[f"{side}_spacing_x"]), chain, registry)
                    new |= {f"{side}_heights": heights_array([after.h]).cast(heights), f"{side}_before": pa.array([digest(before)]), f"{side}_after": pa.array([digest(after.h)])}
                told = [{"identifier": s["name"], "version": s["version"], "parameters": json.loads(s["parameters"]), "outcomes": json.loads(s["outcomes"])} for s in steps]
                new["steps"] = pa.array([compact(told)])
                names = [*one.schema.names, *DIGESTS]
                yield pa.RecordBatch.from_arrays([new.get(n, one.column(n) if n in one.schema.names else None) for n in names], names=names)

    return joined.mapInArrow(scan, schema)


def results(cells: DataFrame, assignments: DataFrame, pairs: DataFrame, registry: Registry = STEPS) -> tuple[DataFrame, DataFrame]:
    """(rows, records): ``RESULT`` of each cell, and what its manifest says. ``cells`` as of ``cells_of``, ``pairs`` as of ``placement.paired``.

    A cell whose pair is missing, or of which no placement was found, fails when it is evaluated, as does a
    chain that refuses a field.
    """
    known = cells.join(assignments, "assignment")
    ready = cut(prepared(known.select("chain", "pair").distinct(), pairs, registry))
    unit = F.sha2(F.to_json(F.struct("chain", "search", "pair")), 256)
    searches = known.select("chain", "pair", "search", "grid", "minimum_valid", "translation_limit", "angles").distinct()
    fields = ready.drop(*DIGESTS).join(searches, ["chain", "pair"]).withColumn("pair_id", unit).drop("chain", "pair", "search")
    best = cut(best_over_angles(registrations_each(fields)))
    rules = [x.split()[0] for x in RULES.split(", ")]
    counted = score_each(best.join(known.select("cell", unit.alias("pair_id"), *rules), "pair_id")).select("cell", "congruent", "eligible", "discarded")
    fails = F.raise_error(F.concat(F.lit("no-match: cell "), F.col("cell"))).cast("long")
    rows = cells.join(counted, "cell", "left").withColumn("congruent", F.coalesce("congruent", fails)).select(*RESULT)
    return rows, known.select("cell", "seed", "comparison", "chain", "pair").join(ready.select("chain", "pair", *DIGESTS), ["chain", "pair"]).drop("chain", "pair")


def _row_digest() -> Column:
    return F.sha2(F.to_json(F.struct(*RESULT)), 256)


def _files(**roles: str) -> Column:
    return F.to_json(F.array(*(F.struct(F.lit(role.replace("_", "-")).alias("role"), F.col(c).alias("sha256")) for role, c in roles.items())))


def _manifest(profile: Profile) -> Column:
    """A record's manifest as JSON text."""
    parts = {
        "schema_version": F.lit(str(N.SCHEMA)),
        "inputs": _files(subject="s_before", reference="r_before"),
        "profile": F.lit(json.dumps({"name": profile.name, "version": profile.version})),
        "steps": F.col("steps"),
        "comparison": F.col("comparison"),
        "seed": F.col("seed").cast("string"),
        "determinism": F.lit(json.dumps(N.MODES)),
        "environment": F.lit(json.dumps(N.environment())),
        "outputs": _files(subject_preprocessed="s_after", reference_preprocessed="r_after"),
    }
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items())), F.lit("}"))


def run_cells(cells: DataFrame, assignments: DataFrame, pairs: DataFrame, profile: Profile, folder: str, *, per_portion: int = 10_000, registry: Registry = STEPS) -> dict[str, int]:
    """Computes what is outstanding under ``folder`` and tells how many cells were computed and reused.

    A run that stops loses at most the portion that it was in. Two runs on one folder may compute a cell twice, but it counts once.
    """
    whole(per_portion, "per_portion", least=1)
    spark, run = cells.sparkSession, uuid.uuid4().hex
    todo = cut(outstanding(cells, finished(spark, folder)))
    n, total = todo.count(), cells.count()
    portions = -(-n // per_portion)
    for k in range(portions):
        attempt = f"a-{run}-{k}"
        rows, records = results(todo.where(F.pmod(F.xxhash64("cell"), F.lit(portions)) == k), assignments, pairs, registry)
        rows.write.parquet(f"{folder}/rows/attempt={attempt}")
        written = spark.read.parquet(f"{folder}/rows/attempt={attempt}").select("cell", _row_digest().alias("row_sha256"))
        made = written.join(records, "cell").select("cell", "row_sha256", F.parse_json(_manifest(profile)).alias("manifest"))
        made.write.parquet(f"{folder}/manifests/attempt={attempt}")
    return {"computed": n, "reused": total - n, "total": total}


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _counting(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, attempt, row) of finished cells, each once."""
    marks = _table(spark, f"{folder}/manifests", MANIFESTS).select("cell", "attempt", "row_sha256")
    rows = _table(spark, f"{folder}/rows", ROWS).select("cell", "attempt", _row_digest().alias("row_sha256"), F.struct(*RESULT).alias("row"))
    return rows.join(marks, ["cell", "attempt", "row_sha256"]).groupBy("cell").agg(F.min("attempt").alias("attempt"), F.min_by("row", "attempt").alias("row"))


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose manifests are there and name them."""
    return _counting(spark, folder).select("row.*")


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, manifest) of finished cells; ``manifest`` is a VARIANT."""
    return _table(spark, f"{folder}/manifests", MANIFESTS).join(_counting(spark, folder).select("cell", "attempt"), ["cell", "attempt"]).select("cell", "manifest")


def report(rows: DataFrame, varied: list[str]) -> DataFrame:
    """Counts over every subset of the varied parameters, in one pass: ``grouping`` tells which are summed over (``grouping_id``), as are null ones.

    Values are texts, by columns named like the parameters with dots as underscores.
    """
    names = [v.replace(".", "_").replace("-", "_") for v in sorted(varied)]
    if len(set(names)) < len(names):
        raise Refusal("names-coincide", str(names))
    values = [F.from_json("assignment", "map<string,string>")[v].alias(n) for v, n in zip(sorted(varied), names, strict=True)]
    counts = rows.select(*values, "same_source", "congruent", "eligible")
    return counts.cube(*names).agg(
        F.grouping_id().alias("grouping"),
        F.count("*").alias("cells"),
        F.sum("congruent").alias("congruent"),
        F.sum("eligible").alias("eligible"),
        F.min("congruent").alias("least"),
        F.max("congruent").alias("most"),
        F.count_if("same_source").alias("same_source"),
    )


def write_table(spark: SparkSession, folder: str, varied: list[str], path: str) -> None:
    """The results as CSV in the order of cells: cell, pair, same_source, a column for each varied parameter, counts."""
    found = finished(spark, folder).withColumn("_a", F.from_json("assignment", "map<string,string>"))
    columns = ["cell", "pair", "same_source", *(F.col("_a")[v].alias(v) for v in sorted(varied)), "congruent", "eligible", "discarded"]
    found.select(*columns).orderBy("cell").coalesce(1).write.mode("overwrite").csv(path, header=True)


def rerun(spark: SparkSession, folder: str, cell: str, pairs: DataFrame, registry: Registry = STEPS) -> None:
    """Computes a finished cell again from its manifest alone; other inputs, counts or preprocessed fields are refused."""
    row = finished(spark, folder).where(F.col("cell") == cell).first()
    if row is None:
        raise Refusal("unknown-cell", cell)
    told = N.parse(manifests(spark, folder).where(F.col("cell") == cell).select(F.to_json("manifest")).first()[0])
    values = told.comparison["parameters"]
    search, rule = (record(kind, {k.removeprefix(p): v for k, v in values.items() if k.startswith(p)}, p) for kind, p in ((SearchParameters, "search."), (AgreementRule, "rule.")))
    one = spark.createDataFrame([_assigned(N.resolve(told, registry), search, rule, row["assignment"], registry)], ASSIGNED)
    again = spark.createDataFrame([(cell, row["pair"], row["same_source"], told.seed, row["assignment"])], "cell string, pair string, same_source boolean, seed long, assignment string")
    rows, records = results(again, one, pairs.where(F.col("pair_id") == row["pair"]), registry)
    seen = records.first()
    if seen is None or N.by_role(told.inputs) != {"subject": seen["s_before"], "reference": seen["r_before"]}:
        raise Refusal("other-input", cell)
    if rows.first() != row:
        raise Refusal("other-counts", f"{row} and {rows.first()}")
    if N.by_role(told.outputs) != {"subject-preprocessed": seen["s_after"], "reference-preprocessed": seen["r_after"]} or json.loads(seen["steps"]) != told.steps:
        raise Refusal("other-result", cell)


def _design_pairs(spark: SparkSession, design: Design) -> DataFrame:
    """The pairs of a design, generated from its seeds."""
    rows = []
    for p in design.pairs:
        rows += (matching if p.kind == "matching" else non_matching)(p.name, FieldParameters(**design.surface, seed=p.seed))
    split = generated(parameter_table(spark, rows)).withColumn("pair_id", F.substring_index("surface_id", "/", 1)).withColumn("side", F.substring_index("surface_id", "/", -1))
    return paired(split.where("side = 'subject'"), split.where("side = 'reference'"))


def run(spark: SparkSession, design: Design, profile: Profile, search: SearchParameters, rule: AgreementRule, folder: str, **options: Any) -> dict[str, int]:
    """``run_cells`` of a design on its own generated pairs."""
    cells = design.cells(spark).select("cell", "pair", (F.col("kind") == "matching").alias("same_source"), "seed", "assignment")
    return run_cells(cells, assigned(spark, profile, search, rule, design.assignments()), _design_pairs(spark, design), profile, folder, **options)


def rerun_cell(spark: SparkSession, design: Design, profile: Profile, search: SearchParameters, rule: AgreementRule, folder: str, cell: str) -> None:
    """``rerun`` of a design's cell on its own pairs, if its manifest names the comparison that the design gives it."""
    known = design.cells(spark).where(F.col("cell") == cell).join(assigned(spark, profile, search, rule, design.assignments()), "assignment").select("comparison").first()
    if known is None:
        raise Refusal("unknown-cell", cell)
    told = manifests(spark, folder).where(F.col("cell") == cell).select(F.to_json(F.variant_get("manifest", "$.comparison", "variant"))).first()
    if told is not None and json.loads(told[0]) != json.loads(known[0]):
        raise Refusal("other-comparison", cell)
    rerun(spark, folder, cell, _design_pairs(spark, design))
