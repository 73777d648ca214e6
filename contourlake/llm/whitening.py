"""Whitening of embeddings: compensated covariance, then eigenvectors.

Vectors become integers, so counts and sums are exact. A centred entry is kept as two doubles. Outer
products of a block of vectors are matrix products of slices with so few bits that each is exact, and
are added to a pair of matrices, high and low parts, without losing what an addition rounds off. Tasks
give such pairs row by row; a row's pairs are merged the same way. The eigen-solve (reduction to
tridiagonal form, then divide and conquer) is of one matrix as wide as a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

#: A long entry is floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Vectors of one block, and bits of one slice: products of slices summed over a block fit 53 bits.
BLOCK, BITS = 1024, 21
#: Components with less of the greatest variance are left out: to double precision they have none.
LEAST = 1e-10

WHOLE = pa.decimal128(38, 0)


def matrix_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: row numbers and entries as floats, of rows without null or non-finite entries."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    fine = (odd[start + size] == odd[start]) & column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == n))
        yield rows, flat[start[rows][:, None] + np.arange(n)]


def steps_of(entries: np.ndarray) -> np.ndarray:
    """Whole steps, without the shift: it moves the mean alone."""
    steps = np.floor(STEPS * entries)
    if steps.size and np.abs(steps).max() >= 2**62:
        raise OverflowError("an embedding's entry exceeds 64 bits")
    return steps.astype(np.int64)


def packed(steps: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 or 8 bytes an entry: equal rows, equal bytes."""
    most = np.maximum(steps.max(1, initial=0), ~steps.min(1, initial=0))
    out: list[bytes] = [b""] * len(steps)
    for kind, low, high in (("<i2", 0, 2**15), ("<i4", 2**15, 2**31), ("<i8", 2**31, 2**63)):
        rows = np.flatnonzero((most >= low) & (most < high))
        raw, width = steps[rows].astype(kind).tobytes(), steps.shape[1] * np.dtype(kind).itemsize
        for k, row in enumerate(rows.tolist()):
            out[row] = raw[k * width : (k + 1) * width]
    return out


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of one length that ``packed`` made."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dims), np.int64)
    kinds = np.array([len(r) for r in rows]) // dims
    for width in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == width)
        out[at] = np.frombuffer(b"".join([rows[k] for k in at.tolist()]), f"<i{width}").reshape(-1, dims)
    return out


def _distinct(batches):
    schema = pa.schema([("dims", pa.int32()), ("steps", pa.binary())])
    for batch in batches:
        for _, entries in matrix_of(batch.column(0)):
            rows = packed(steps_of(entries))
            yield pa.RecordBatch.from_arrays([pa.array([entries.shape[1]] * len(rows), pa.int32()), pa.array(rows, pa.binary())], schema=schema)


def _sums(dims: int):
    def scan(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                steps = unpacked(batch.column(0).slice(low, BLOCK), dims)
                exact = steps if np.abs(steps).max(initial=0) < 2**52 else steps.astype(object)
                n += len(steps)
                total = [a + int(b) for a, b in zip(total, exact.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(map(Decimal, total), WHOLE)], names=["dim", "n", "total"])

    return scan


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sum and what its rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A product and what its rounding lost, by halves of 26 bits."""

    def halves(x):
        t = x * 134217729.0
        high = t - (t - x)
        return high, x - high

    p = a * b
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


@dataclass(frozen=True)
class Centre:
    """How many vectors were fitted, and their sums of steps (whole numbers of any size)."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, steps: np.ndarray) -> np.ndarray:
        """n * steps - sums, exact: 64 bits wide where these suffice, else whole numbers of any size."""
        most = self.n * int(np.abs(steps).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return steps.astype(kind) * self.n - np.array(self.sums, kind)

    def parts(self, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred steps as high and low doubles."""
        whole, rest = np.divmod(scaled, self.n)
        whole, rest = whole.astype(np.float64), rest.astype(np.float64)
        part = rest / self.n
        product, lost = two_product(part, np.float64(self.n))
        high, low = two_sum(whole, part)
        return high, low + ((rest - product) - lost) / self.n


class OuterProducts:
    """The sum of outer products, as a high and a low matrix."""

    def __init__(self, dims: int):
        self.high, self.low = np.zeros((dims, dims)), np.zeros((dims, dims))

    def _put(self, exact: np.ndarray) -> None:
        self.high, lost = two_sum(self.high, exact)
        self.low += lost

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Adds a block of at most ``BLOCK`` vectors."""
        most = np.abs(high).max(0, initial=0)
        unit = np.exp2(np.frexp(most)[1].astype(np.float64) - BITS)
        slices, rest = [], high
        for _ in range(3):
            part = np.rint(rest / unit) * unit
            slices.append(part)
            rest, unit = rest - part, unit * 2.0**-BITS
        a, b, c = slices
        for x, y in ((a, a), (b, b)):
            self._put(x.T @ y)
        for x, y in ((a, b), (a, c)):
            product = x.T @ y
            self._put(product)
            self._put(product.T)
        small = b.T @ c
        mixed = high.T @ (low + rest)
        self.low += small + small.T + c.T @ c + mixed + mixed.T


def _products(dims: int, of):
    """High and low rows of a task's outer products; ``of`` gives high and low parts of a block of steps, ``dims`` wide."""
    schema = pa.schema([("dim", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])

    def scan(batches):
        total = OuterProducts(dims)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                total.add(*of(batch.column(0).slice(low, BLOCK)))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total.high), pa.list_(pa.float64())), pa.array(list(total.low), pa.list_(pa.float64()))], schema=schema)

    return scan, "dim int, high array<double>, low array<double>"


def _merged(group: pa.Table) -> pa.Table:
    """One pair of all tasks' pairs of a row."""
    high = low = 0.0
    for h, l in zip(group.column("high").to_pylist(), group.column("low").to_pylist(), strict=True):
        high, lost = two_sum(np.float64(high), np.array(h))
        low = low + lost + np.array(l)
    high, low = two_sum(high, low)
    return pa.table({"dim": group.column("dim")[:1], "high": [high.tolist()], "low": [low.tolist()]}, schema=group.schema)


def _covariance(fit: DataFrame, dims: int, n: int, of) -> np.ndarray:
    scan, ddl = _products(dims, of)
    rows = fit.mapInArrow(scan, ddl).groupBy("dim").applyInArrow(_merged, ddl).collect()  # as many rows as a vector has entries
    rows = sorted(rows, key=lambda r: r["dim"])
    return (np.array([r["high"] for r in rows]) / n) + (np.array([r["low"] for r in rows]) / n)


@dataclass(frozen=True)
class Whitening:
    """A fit: exact sums, unit ``axes`` in columns by falling ``variances`` (those of the axes), all variance, and how far off it is."""

    centre: Centre
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def of(self, high: np.ndarray) -> np.ndarray:
        return high @ self.axes / np.sqrt(self.variances)


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances and unit axes, the greatest first; an axis' greatest entry is positive."""
    values, vectors = np.linalg.eigh(covariance)  # tridiagonal divide and conquer
    take = [k for k in np.argsort(-values, kind="stable")[:most].tolist() if values[k] > LEAST * values[-1] and values[k] > 0]
    axes = vectors[:, take]
    return values[take], axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(len(take))])


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of a table's distinct vectors in whole steps; None where no vector is left.

    Null vectors and those with null or non-finite entries are left out, and so are vectors of another
    length than most distinct ones have (the longer at a tie). Copies are one vector: they are merged
    before and after the shuffle, whatever their number. Driver and tasks hold matrices as wide as a
    vector is long. Components without variance are left out.
    """
    fit = written(vectors.select(F.col(f"`{vector_col}`")).mapInArrow(_distinct, "dims int, steps binary").distinct(), "vectors")
    length = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None or not length["dims"]:
        return None
    dims = length["dims"]
    fit = fit.where(F.col("dims") == dims).select("steps")
    found = fit.mapInArrow(_sums(dims), "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("string").alias("total")).collect()
    centre = Centre(found[0]["n"], tuple(int(r["total"]) for r in sorted(found, key=lambda r: r["dim"])))

    def centred(column):
        return centre.parts(centre.scaled(unpacked(column, dims)))

    covariance = _covariance(fit, dims, centre.n, centred)
    variances, axes = principal(covariance, components)
    model = Whitening(centre, axes, variances, float(np.trace(covariance)), 0.0)
    if not len(variances):
        return model

    def projected(column):
        out = model.of(centred(column)[0])  # centred: the whole list's mean is 0
        return out, np.zeros_like(out)

    error = float(np.abs(_covariance(fit, len(variances), centre.n, projected) - np.eye(len(variances))).max())
    return Whitening(centre, axes, variances, model.trace, error)


def _squares(scaled: np.ndarray) -> pa.Array:
    if scaled.dtype == np.int64 and int(np.abs(scaled).max(initial=0)) ** 2 * max(1, scaled.shape[1]) < 2**63:
        return pa.array((scaled * scaled).sum(1)).cast(WHOLE)
    return pa.array([Decimal(sum(v * v for v in row)) for row in scaled.tolist()], WHOLE)


def whitened(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``deviation`` (squared length of n * steps - sums, exact) and ``whitened`` of every vector that can be.

    Rows whose vector is null, has null or non-finite entries or another length than the fitted ones are
    left out; repeated rows and null ids stay. Without a model (an empty table) there are no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, deviation decimal(38,0), whitened array<double>"
    dims = len(model.centre.sums) if model else 0

    def scan(batches):
        for batch in batches:
            for rows, entries in matrix_of(batch.column(1)):
                if not dims or entries.shape[1] != dims:
                    continue
                scaled = model.centre.scaled(steps_of(entries))
                out = model.of(model.centre.parts(scaled)[0])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _squares(scaled), lists], names=[id_col, "deviation", "whitened"])

    return vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")).mapInArrow(scan, ddl)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.variances)) if model and len(model.variances) else F.array().cast("array<double>")
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.centre.n if model else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
