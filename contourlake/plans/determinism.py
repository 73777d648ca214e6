"""A guard for code that must draw only from seeded generators."""

from __future__ import annotations

import contextlib
import random
from collections.abc import Iterator
from unittest import mock

import numpy as np

from ..errors import Refusal



def shared_draws() -> list[str]:
    """Functions of NumPy's and Python's shared generators, by dotted name."""
    numpy_draws = [n for n in dir(np.random.RandomState) if n[0] != "_" and n not in ("get_state", "set_state") and hasattr(np.random, n)]
    python_draws = [n for n in dir(random.Random) if n[0] != "_" and n not in ("getstate", "setstate", "VERSION") and hasattr(random, n)]
    return [f"numpy.random.{n}" for n in numpy_draws] + [f"random.{n}" for n in python_draws]


@contextlib.contextmanager
def seeded_only() -> Iterator[None]:
    """While it lasts, draws from shared generators, and generators without a seed, are refused."""

    def refuse(*_, **__):
        raise Refusal("unseeded-draw")

    made = np.random.default_rng

    def with_seed(seed=None):
        return refuse() if seed is None else made(seed)

    with contextlib.ExitStack() as stack:
        for name in shared_draws():
            stack.enter_context(mock.patch(name, refuse))
        stack.enter_context(mock.patch("numpy.random.default_rng", with_seed))
        yield
