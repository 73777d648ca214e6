"""Sweep designs: declared ranges, assignments of parameters, and their cells as a table."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refusal, one_of, whole


@dataclass(frozen=True)
class Bound:
    """What a parameter may be: a closed interval or a set, and whether it may be null."""

    kind: str
    lower: float | None = None
    upper: float | None = None
    values: tuple = ()
    nullable: bool = False

    def admits(self, value: Any) -> bool:
        if value is None:
            return self.nullable
        if self.kind == "set":
            return any(type(v) is type(value) and v == value for v in self.values)
        if isinstance(value, bool) or not isinstance(value, int | float):
            return False
        return not (self.kind == "int" and not isinstance(value, int)) and self.lower <= value <= self.upper

    def spread(self, points: int) -> list:
        """``points`` evenly spaced values with both ends; those of a whole-number range are rounded."""
        if self.kind == "set":
            raise Refusal("no-interval")
        whole(points, "points", least=2)
        out = [float(x) for x in np.linspace(self.lower, self.upper, points)]
        if self.kind == "int":
            out = [int(np.rint(x)) for x in out]
        if len(set(out)) < len(out):
            raise Refusal("points-coincide", str(points))
        return out


def ranges(document: dict) -> dict[str, Bound]:
    """Bounds by parameter from a ranges document."""
    out = {}
    for name, x in document["parameters"].items():
        kind = one_of(x["kind"], f"{name}.kind", ("float", "int", "set"))
        if kind == "set":
            out[name] = Bound("set", values=tuple(v["value"] if isinstance(v, dict) else v for v in x["values"]), nullable=bool(x.get("null")))
        else:
            low, high = (x[k]["value"] if isinstance(x[k], dict) else x[k] for k in ("lower", "upper"))
            out[name] = Bound(kind, low, high, nullable=bool(x.get("null")))
    return out


@dataclass(frozen=True)
class Pair:
    name: str
    kind: str
    seed: int

    def __post_init__(self):
        one_of(self.kind, "pair kind", ("matching", "non-matching"))
        whole(self.seed, "seed")


@dataclass(frozen=True)
class Design:
    """Base values of all parameters, the values each varied one takes, and the pairs to run them on."""

    name: str
    version: str
    generator: str  # one-at-a-time or full-factorial
    base: dict[str, Any]
    vary: dict[str, list]
    pairs: tuple[Pair, ...]
    surface: dict[str, Any] = field(default_factory=dict)

    def check(self, bounds: dict[str, Bound]) -> None:
        one_of(self.generator, "generator", ("one-at-a-time", "full-factorial"))
        if "seed" in self.surface:
            raise Refusal("seed-in-surface", "seeds belong to pairs")
        if not self.pairs or len({p.name for p in self.pairs}) < len(self.pairs):
            raise Refusal("pairs-not-distinct")
        for name, values in self.vary.items():
            if name not in bounds or name not in self.base:
                raise Refusal("undeclared-parameter", name)
            if len(values) < 2 or len({json.dumps(v) for v in values}) < len(values):
                raise Refusal("values-not-distinct", name)
            for v in values:
                if not bounds[name].admits(v):
                    raise Refusal("outside-its-range", f"{name}={v!r}")

    def assignments(self) -> list[dict[str, Any]]:
        base = {k: self.base[k] for k in self.vary}
        if self.generator == "one-at-a-time":
            every = [base, *({**base, k: v} for k in sorted(self.vary) for v in self.vary[k])]
        else:
            every = [{}]
            for k in sorted(self.vary):
                every = [{**a, k: v} for a in every for v in self.vary[k]]
        return list({json.dumps(a, sort_keys=True): a for a in every}.values())

    def identify(self, pair: str, assignment: dict[str, Any]) -> str:
        text = json.dumps({"design": self.name, "version": self.version, "pair": pair, "assignment": assignment}, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:12]

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, pair, kind, seed, assignment as JSON): every assignment on every pair, each once."""
        rows = {}
        for a in self.assignments():
            for p in self.pairs:
                rows.setdefault(cell := self.identify(p.name, a), (cell, p.name, p.kind, p.seed, json.dumps(a, sort_keys=True)))
        return spark.createDataFrame(sorted(rows.values()), "cell string, pair string, kind string, seed long, assignment string")


def one_at_a_time(values: DataFrame) -> DataFrame:
    """The table form: ``values`` (parameter, value, is_base) gives (assignment, parameter, value), the base once."""
    base = values.where("is_base").select("parameter", F.col("value").alias("base"))
    moved = values.where("NOT is_base").select(F.col("parameter").alias("moved"), F.col("value").alias("to"))
    heads = moved.unionByName(values.sparkSession.createDataFrame([(None, None)], "moved string, to string"))
    every = heads.crossJoin(base)  # designs: parameters times values, a handful of each
    return every.select(F.coalesce(F.concat_ws("=", "moved", "to"), F.lit("")).alias("assignment"), "parameter", F.when(F.col("parameter") == F.col("moved"), F.col("to")).otherwise(F.col("base")).alias("value"))


def factorial(values: dict[str, list], spark: SparkSession) -> DataFrame:
    """Every combination, one column for each parameter, by chained explodes."""
    out = spark.range(1)
    for name, these in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, these))))
    return out.drop("id")


def outstanding(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells without a finished result."""
    return cells.join(done.select("cell").distinct(), "cell", "left_anti")


def admitted(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """(parameter, value, admitted) of numeric ``values`` against ``bounds`` (parameter, lower, upper, nullable); an undeclared one isn't."""
    inside = F.when(F.col("value").isNull(), F.col("nullable")).otherwise((F.col("value") >= F.col("lower")) & (F.col("value") <= F.col("upper")))
    return values.join(bounds, "parameter", "left").select("parameter", "value", F.coalesce(inside, F.lit(False)).alias("admitted"))


def load(path, registry=None, bounds: dict[str, Bound] | None = None):
    """(design, profile, search, rule) of a design document; its profile's path is relative to it.

    Keys are exactly name, version, description, generator, profile, surface, search, rule, pairs and
    vary. A varied parameter gives ``values``, or a number of ``points`` over its range; a set may give
    neither and takes all its values.
    """
    from pathlib import Path

    from ..operators.agreement import AgreementRule, check_rule
    from ..operators.placement import SearchParameters, check_search
    from .profile import exactly, record
    from .profile import load as load_profile
    from .steps import STEPS
    from .sweep import base_of

    path, bounds = Path(path), bounds or {}
    data = json.loads(path.read_text(encoding="utf-8"))
    exactly(data, ("name", "version", "description", "generator", "profile", "surface", "search", "rule", "pairs", "vary"), "design")
    if data["name"] != path.stem:
        raise Refusal("named-otherwise", f"{path.stem} and {data['name']}")
    profile = load_profile((path.parent / data["profile"]).resolve(), registry or STEPS)
    search, rule = record(SearchParameters, data["search"], "search"), record(AgreementRule, data["rule"], "rule")
    check_search(search)
    check_rule(rule)
    vary: dict[str, list] = {}
    for item in data["vary"]:
        name = item["parameter"]
        if name not in bounds:
            raise Refusal("undeclared-parameter", name)
        if "values" in item:
            vary[name] = item["values"]
        elif "points" in item:
            vary[name] = bounds[name].spread(item["points"])
        elif bounds[name].kind == "set":
            vary[name] = list(bounds[name].values)
        else:
            raise Refusal("no-values", name)
    pairs = tuple(Pair(**{k: p[k] for k in ("name", "kind", "seed")}) for p in data["pairs"])
    found = Design(data["name"], data["version"], data["generator"], base_of(profile, search, rule), vary, pairs, data["surface"])
    found.check(bounds)
    return found, profile, search, rule
