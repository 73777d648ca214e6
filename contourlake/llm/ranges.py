"""Count-min sketches dealt by hash range: segments of a scan ask, ranges count and answer.

A task takes its keys in segments of bounded size. In each row of the sketch a key has a cell, and a
cell's high bits name the piece that it lies in. A segment sends each piece its distinct cells and how
often it holds them, as compressed deltas. The task that gets a piece merges what all segments sent and
answers each one with the totals of its own cells, in classes of powers of two. Answers lie in the
shared folder, a file or so for each segment; a later scan forms the same segments and reads its own.

So the sketch is as wide as the data ask for (some sixteen cells for each key, at any size), a task
holds one piece, a key that every row has costs a segment one cell, and nothing is collected or
broadcast. A segment is named by a digest of its keys. One without an answer, as when a table is read
in other splits than before, learns ``UNKNOWN``: its keys count as repeated, and nothing is lost.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import release, scratch_path

#: Multipliers of the sketch's rows: odd 64-bit numbers.
ROWS = np.random.default_rng(77).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Keys of one piece, as powers of two: as few as keep a task busy, as many as fit in it.
LOG_KEYS, MOST_LOG_KEYS = 20, 24
#: Keys, and parts of up to a megabyte of text, of one segment.
KEYS_EACH, PARTS_EACH = 1 << 20, 16
#: The class of keys without an answer; no count has a greater one.
UNKNOWN = 15

DDL = "seg string, row int, piece long, body binary"
SCHEMA = pa.schema([("seg", pa.string()), ("row", pa.int32()), ("piece", pa.int64()), ("body", pa.binary())])


@dataclass(frozen=True)
class Ranges:
    """A sketch of ``depth`` rows with ``2**log_pieces`` pieces of ``2**log_cells`` cells each."""

    log_pieces: int
    log_cells: int
    depth: int = 1

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (keys * ROWS[row]) >> np.uint64(64 - self.log_pieces - self.log_cells)


def ranges_for(n_keys: int, depth: int = 1, log_keys: int = LOG_KEYS) -> Ranges:
    """Ranges for so many keys. Pieces grow after 4096 of them; the widest have four cells for each key, others sixteen."""
    log_n = max(1, n_keys).bit_length()
    each = min(MOST_LOG_KEYS, max(log_keys, log_n - 12))
    log_pieces = max(4, log_n - each)
    return Ranges(log_pieces, min(26, max(10, log_n - log_pieces + 4)), depth)


def segments(parts: Iterator[tuple], most_keys: int = KEYS_EACH, most_parts: int = PARTS_EACH) -> Iterator[list[tuple]]:
    """(part, keys) pairs in lists that hold about ``most_keys`` keys or ``most_parts`` parts."""
    held, n = [], 0
    for part, keys in parts:
        held.append((part, keys))
        n += len(keys)
        if n >= most_keys or len(held) >= most_parts:
            yield held
            held, n = [], 0
    if held:
        yield held


def joined(segment: list[tuple]) -> np.ndarray:
    return np.concatenate([keys for _, keys in segment])


def name_of(keys: np.ndarray) -> str:
    return hashlib.blake2b(np.ascontiguousarray(keys).tobytes(), digest_size=16).hexdigest()


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on: high bytes are mostly alike."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(body: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(kind).itemsize, n).T).reshape(-1).view(kind)


def packed(cells: np.ndarray, counts: np.ndarray | None) -> bytes:
    body = np.uint32(len(cells)).tobytes() + planes(np.diff(cells, prepend=0).astype(np.uint32))
    if counts is not None:
        body += planes(np.minimum(counts, 65535).astype(np.uint16))
    return zlib.compress(body, 1)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    body = zlib.decompress(body)
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    cells = np.cumsum(from_planes(body[4 : 4 + 4 * n], np.uint32, n), dtype=np.int64)
    return cells, from_planes(body[4 + 4 * n :], np.uint16, n) if len(body) > 4 + 4 * n else None


def questions(keys: np.ndarray, ranges: Ranges, counted: bool = True, asked: bool = True) -> list[tuple]:
    """A segment's rows. Keys that aren't ``counted`` only ask; those that aren't ``asked`` only count."""
    rows, seg = [], name_of(keys) if asked else None
    mask = (1 << ranges.log_cells) - 1
    for row in range(ranges.depth if len(keys) else 0):
        at, n = np.unique(ranges.cells(keys, row).astype(np.int64), return_counts=True)
        cut = np.flatnonzero(np.diff(at >> ranges.log_cells)) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            rows.append((seg, row, int(at[low]) >> ranges.log_cells, packed(at[low:high] & mask, n[low:high] if counted else None)))
    return rows


def batch_of(rows: list[tuple], schema: pa.Schema = SCHEMA) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def counts_in(ranges: Ranges) -> Callable[[list[tuple[str | None, bytes]]], Iterator[tuple[str, bytes]]]:
    """What a piece answers: for each of a segment's cells the bits that its total has, 15 at most, two to a byte."""

    def of(bodies):
        total, asked = np.zeros(1 << ranges.log_cells, np.uint16), []
        for seg, body in bodies:
            at, n = unpacked(body)
            if n is not None:
                held = total[at]
                total[at] = held + np.minimum(n, 65535 - held)  # cells of one body are distinct
            if seg is not None:
                asked.append((seg, at))
        for seg, at in asked:
            bits = np.minimum(np.frexp(total[at].astype(np.float32))[1], UNKNOWN).astype(np.uint8)
            pairs = np.append(bits, np.zeros(len(bits) % 2, np.uint8)).reshape(-1, 2)
            yield seg, np.uint32(len(bits)).tobytes() + zlib.compress((pairs[:, 0] << 4 | pairs[:, 1]).tobytes(), 1)

    return of


def by_piece(of):
    """A scan over questions sorted by piece: what ``of`` makes of each piece's (segment, body) pairs. One piece is held at a time."""

    def answered(key, held):
        return batch_of([(seg, *key, body) for seg, body in of(held)])

    def scan(batches):
        key, held = None, []
        for batch in batches:
            for seg, row, piece, body in zip(*(batch.column(c).to_pylist() for c in SCHEMA.names), strict=True):
                if (row, piece) != key:
                    if held:
                        yield answered(key, held)
                    key, held = (row, piece), []
                held.append((seg, body))
        if held:
            yield answered(key, held)

    return scan


def answers(asked: DataFrame, of) -> str:
    """Deals questions to their pieces and writes the answers by segment; the folder they lie in."""
    path = scratch_path(asked.sparkSession, "answers")
    dealt = asked.select(*SCHEMA.names).repartition("row", "piece").sortWithinPartitions("row", "piece")
    given = dealt.mapInArrow(by_piece(of), DDL).repartition("seg", F.when(F.col("seg").isNull(), F.col("piece")))
    given.write.partitionBy("seg").parquet(path)
    release(asked.sparkSession, 0.3)
    return path


def unasked(spark: SparkSession, *roots: str) -> DataFrame:
    """What pieces gave for no segment: row, piece and body."""
    found = [spark.read.schema(DDL).parquet(root).where("seg IS NULL") for root in roots]
    return functools.reduce(DataFrame.unionByName, found).select("row", "piece", "body")


def answer_rows(root: str, seg: str) -> dict[tuple[int, int], bytes]:
    """A segment's answers by (row, piece), in order; none where it has none."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    fs, base = FileSystem.from_uri(root)
    found: dict[tuple[int, int], bytes] = {}
    for info in fs.get_file_info(FileSelector(f"{base}/seg={seg}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                read = pq.ParquetFile(file).read()
            rows, pieces, bodies = (read.column(c).to_pylist() for c in ("row", "piece", "body"))
            found |= {(r, p): b for r, p, b in zip(rows, pieces, bodies, strict=True)}
    return dict(sorted(found.items()))


@dataclass(frozen=True)
class Answers:
    """What was answered to the segments of a scan."""

    root: str
    ranges: Ranges

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """For each key of a segment the bits that its count has by the sketch: at least the true ones (1: seen once)."""
        found = answer_rows(self.root, name_of(keys)) if len(keys) else {}
        out = np.full(len(keys), UNKNOWN, np.uint8)
        for row in range(self.ranges.depth):
            at, back = np.unique(self.ranges.cells(keys, row), return_inverse=True)
            parts = []
            for (r, _), body in found.items():
                if r == row:
                    pairs = np.frombuffer(zlib.decompress(body[4:]), np.uint8)
                    parts.append(np.stack((pairs >> 4, pairs & 15), axis=1).reshape(-1)[: np.frombuffer(body, np.uint32, 1)[0]])
            if sum(map(len, parts)) != len(at):
                return np.full(len(keys), UNKNOWN, np.uint8)
            if len(at):
                np.minimum(out, np.concatenate(parts)[back], out=out)
        return out
