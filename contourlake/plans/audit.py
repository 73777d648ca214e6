"""Checks over the library's own sources: undeclared numbers in steps, steps outside the registry."""

from __future__ import annotations

import ast
import inspect
from types import ModuleType

from .steps import STEPS, Registry

#: Numbers that structure code rather than decide results.
STRUCTURAL = (0, 1, 2, -1)


def undeclared_numbers(module: ModuleType) -> list[tuple[int, float]]:
    """(line, value) of numeric literals in functions and methods that aren't structural, unless the line says ``# fixed:``."""
    source = inspect.getsource(module)
    lines, out = source.splitlines(), []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.FunctionDef):
            for x in ast.walk(node):
                if isinstance(x, ast.Constant) and isinstance(x.value, int | float) and not isinstance(x.value, bool) and x.value not in STRUCTURAL and "# fixed:" not in lines[x.lineno - 1]:
                    out.append((x.lineno, x.value))
    return sorted(set(out))


def unregistered(module: ModuleType, registry: Registry = STEPS) -> list[str]:
    """Classes of a module that look like steps and aren't in the registry."""
    known = {type(s) for s in registry}
    parts = ("identifier", "version", "parameters", "produces", "requires", "refuses", "apply")
    return [n for n, c in vars(module).items() if inspect.isclass(c) and c.__module__ == module.__name__ and all(hasattr(c, p) for p in parts) and c not in known and not getattr(c, "_is_protocol", False)]
