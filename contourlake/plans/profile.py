"""Profiles: named chains in JSON, with a source stated for every parameter."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..errors import Refusal, one_of
from .steps import STEPS, Applied, Registry, check_chain

ORIGINS = ("stated", "adapted", "not-sourced")


@dataclass(frozen=True)
class Source:
    origin: str
    where: str
    confidence: str


@dataclass(frozen=True)
class Profile:
    name: str
    version: str
    description: str
    chain: tuple[Applied, ...]
    sources: tuple[dict[str, Source], ...]


def exactly(data: dict, keys, what: str) -> None:
    if not isinstance(data, dict) or set(data) != set(keys):
        raise Refusal("keys-differ", f"{what}: {sorted(set(data) ^ set(keys)) if isinstance(data, dict) else data!r}")


def typed(value: Any, kind: Any, name: str) -> Any:
    """A JSON value as a record's field takes it: whole numbers widen to float, flags are never numbers."""
    kinds = typing.get_args(kind) if isinstance(kind, types.UnionType) else (kind,)
    if value is None and type(None) in kinds:
        return None
    for k in kinds:
        if k is float and isinstance(value, int | float) and not isinstance(value, bool):
            return float(value)
        if k is not float and type(value) is k:
            return value
    raise Refusal("wrong-type", f"{name} is {value!r}")


def record(kind: type, data: dict, what: str) -> Any:
    hints = typing.get_type_hints(kind)
    exactly(data, hints, what)
    return kind(**{k: typed(v, hints[k], f"{what}.{k}") for k, v in data.items()})


def parse(text: str, registry: Registry = STEPS, stem: str | None = None) -> Profile:
    data = json.loads(text)
    exactly(data, ("name", "version", "description", "steps"), "profile")
    if stem is not None and stem != data["name"]:
        raise Refusal("named-otherwise", f"{stem} and {data['name']}")
    chain, sources = [], []
    for step in data["steps"]:
        exactly(step, ("transform", "parameters", "sources"), "step")
        kind = registry[step["transform"]].parameters
        chain.append(Applied(step["transform"], record(kind, step["parameters"], step["transform"])))
        exactly(step["sources"], [f.name for f in dataclasses.fields(kind)], f"{step['transform']} sources")
        found = {k: record(Source, v, k) for k, v in step["sources"].items()}
        for k, v in found.items():
            one_of(v.origin, k, ORIGINS)
        sources.append(found)
    check_chain(chain, registry)
    return Profile(data["name"], data["version"], data["description"], tuple(chain), tuple(sources))


def load(path: Path, registry: Registry = STEPS) -> Profile:
    return parse(path.read_text(encoding="utf-8"), registry, path.stem)


def load_folder(folder: Path, registry: Registry = STEPS) -> list[Profile]:
    return [load(p, registry) for p in sorted(folder.glob("*.json"), key=lambda p: p.name)]


def unprofiled(profiles: list[Profile], registry: Registry = STEPS) -> list[str]:
    """Registered steps that no profile uses."""
    used = {a.identifier for p in profiles for a in p.chain}
    return [s.identifier for s in registry if s.identifier not in used]
