"""Manifests: what ran on which input with which result, enough to run it again and compare."""

from __future__ import annotations

import dataclasses
import json
import platform
import re
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal, one_of
from ..sources.container import digest
from .profile import Profile, exactly, record
from .steps import STEPS, Applied, Field, Registry, apply_chain, check_chain

SCHEMA = 4
_SHA = re.compile(r"[0-9a-f]{64}")
#: Thread controls of the numeric libraries, set to one where sums must come in one order.
THREADS = ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "VECLIB_MAXIMUM_THREADS", "NUMEXPR_NUM_THREADS")


def reference_conf() -> dict[str, str]:
    """Spark settings under which executors' numeric libraries use one thread."""
    return {f"spark.executorEnv.{name}": "1" for name in THREADS}


@dataclass(frozen=True)
class Manifest:
    schema_version: int
    inputs: list[dict[str, str]]
    profile: dict[str, str]
    steps: list[dict[str, Any]]
    comparison: dict[str, Any] | None
    seed: int
    determinism: dict[str, Any]
    environment: dict[str, Any]
    outputs: list[dict[str, str]]

    def check(self) -> Manifest:
        if self.schema_version != SCHEMA:
            raise Refusal("other-schema", str(self.schema_version))
        if not self.inputs or not self.steps:
            raise Refusal("nothing-recorded")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise Refusal("seed-not-whole", repr(self.seed))
        for file in [*self.inputs, *self.outputs]:
            exactly(file, ("role", "sha256"), "file")
            if not _SHA.fullmatch(file["sha256"]):
                raise Refusal("not-a-digest", file["sha256"])
        for step in self.steps:
            exactly(step, ("identifier", "version", "parameters", "outcomes"), "step")
            for bag in (step["parameters"], step["outcomes"]):
                if list(bag) != sorted(bag):
                    raise Refusal("unsorted-keys", step["identifier"])
        return self

    def text(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2) + "\n"


def parse(text: str) -> Manifest:
    data = json.loads(text)
    if data.get("schema_version") != SCHEMA:
        raise Refusal("other-schema", str(data.get("schema_version")))
    exactly(data, [f.name for f in dataclasses.fields(Manifest)], "manifest")
    return Manifest(**data).check()


SCHEMA_DDL = "schema_version int, inputs array<struct<role:string,sha256:string>>, profile struct<name:string,version:string>, seed long, outputs array<struct<role:string,sha256:string>>"


def scan(spark, path: str):
    """Manifests under a path as a table: one row for each file, failing on one that isn't JSON."""
    return spark.read.schema(SCHEMA_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)


#: How sweeps and recorded runs are computed.
MODES = {"mode": "reference", "threads": 1, "reportable": True}


def by_role(files: list[dict[str, str]]) -> dict[str, str]:
    return {f["role"]: f["sha256"] for f in files}


def environment() -> dict[str, Any]:
    import pyspark

    return {"python": platform.python_version(), "dependencies": {"numpy": np.__version__, "pyspark": pyspark.__version__}}


def record_run(field: Field, profile: Profile, seed: int, *, role: str = "subject", comparison: dict | None = None, registry: Registry = STEPS) -> tuple[Field, Manifest]:
    """Runs the profile's chain on one field and records it."""
    check_chain(list(profile.chain), registry)
    out, records = apply_chain(field, list(profile.chain), registry)
    if len(records) != len(profile.chain):
        raise Refusal("records-differ-from-steps")
    steps = [{"identifier": r["name"], "version": r["version"], "parameters": json.loads(r["parameters"]), "outcomes": json.loads(r["outcomes"])} for r in records]
    made = Manifest(SCHEMA, [{"role": role, "sha256": digest(field.h)}], {"name": profile.name, "version": profile.version}, steps, comparison, seed, MODES, environment(), [{"role": role, "sha256": digest(out.h)}])
    return out, made.check()


def resolve(manifest: Manifest, registry: Registry = STEPS) -> list[Applied]:
    """The chain a manifest names; a step that isn't registered in that version is refused."""
    chain = []
    for step in manifest.steps:
        known = registry[step["identifier"]]
        if known.version != step["version"]:
            raise Refusal("other-version", f"{step['identifier']} {step['version']}")
        chain.append(Applied(step["identifier"], record(known.parameters, step["parameters"], step["identifier"])))
    check_chain(chain, registry)
    return chain


def rerun(manifest: Manifest, field: Field, registry: Registry = STEPS) -> Field:
    """Runs a manifest's chain again; a different input or a different result is refused."""
    if digest(field.h) not in [f["sha256"] for f in manifest.inputs]:
        raise Refusal("other-input")
    out, records = apply_chain(field, resolve(manifest, registry), registry)
    if digest(out.h) not in [f["sha256"] for f in manifest.outputs]:
        raise Refusal("other-result")
    if [json.loads(r["outcomes"]) for r in records] != [s["outcomes"] for s in manifest.steps]:
        raise Refusal("other-outcomes")
    return out


def digests(manifests: DataFrame, kind: str = "inputs") -> DataFrame:
    """(cell, role, sha256) of the ``inputs`` or ``outputs`` of a table (cell, manifest) of VARIANTs."""
    one_of(kind, "kind", ("inputs", "outputs"))
    text = f"SELECT cell, variant_get(f.value, '$.role', 'string') AS role, variant_get(f.value, '$.sha256', 'string') AS sha256 FROM {{m}} AS m, LATERAL variant_explode(variant_get(m.manifest, '$.{kind}')) AS f"
    return manifests.sparkSession.sql(text, m=manifests)


def steps(manifests: DataFrame) -> DataFrame:
    """(cell, pos, identifier, version, parameters, outcomes) of each step, the last two as VARIANTs."""
    text = """SELECT cell, s.pos, variant_get(s.value, '$.identifier', 'string') AS identifier, variant_get(s.value, '$.version', 'string') AS version,
      variant_get(s.value, '$.parameters') AS parameters, variant_get(s.value, '$.outcomes') AS outcomes FROM {m} AS m, LATERAL variant_explode(variant_get(m.manifest, '$.steps')) AS s"""
    return manifests.sparkSession.sql(text, m=manifests)


def unequal(one: DataFrame, other: DataFrame) -> DataFrame:
    """(role, sha256, side) that one multiset of files has more often than the other, so many times; empty if they are equal."""
    a, b = (x.select("role", "sha256") for x in (one, other))
    return a.exceptAll(b).withColumn("side", F.lit("one")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))
