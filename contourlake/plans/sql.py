"""Chains from SQL text: a table function over fields.

    SELECT f.surface_id, s.* FROM fields AS f, LATERAL preprocessed(f.n_rows, f.n_cols, f.spacing_y, f.spacing_x, f.heights, '[...]') AS s
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .profile import record
from .steps import STEPS, Applied, Field, apply_chain, check_chain, compact


def chain_text(chain: list[Applied]) -> str:
    """A chain as the table function takes it: a list of (step, parameters) in JSON."""
    from dataclasses import asdict

    return compact([[a.identifier, asdict(a.parameters)] for a in chain])


def chain_of(text: str) -> list[Applied]:
    """The chain of a text; one that can't run is refused."""
    chain = [Applied(i, record(STEPS[i].parameters, p, i)) for i, p in json.loads(text)]
    check_chain(chain)
    return chain


class Preprocessed:
    """Samples (r, c, h) of a field after a chain, absent ones as null. A field is one row, so a task holds one field.

    Null heights, shape or chain give no sample. Rows are plain, for Spark takes no Arrow table function in a lateral join.
    """

    def eval(self, n_rows: int, n_cols: int, spacing_y: float, spacing_x: float, heights: list, chain: str):
        if None in (n_rows, n_cols, spacing_y, spacing_x, chain) or heights is None:
            return
        field = Field(np.array(heights, np.float64).reshape(n_rows, n_cols), spacing_y, spacing_x)
        out = apply_chain(field, chain_of(chain))[0].h
        for r, row in enumerate(out.tolist()):
            for c, h in enumerate(row):
                yield r, c, None if h != h else h


def register(spark: SparkSession, name: str = "preprocessed") -> None:
    """Makes the function known to SQL of this session."""
    spark.udtf.register(name, udtf(Preprocessed, returnType="r int, c int, h double"))
