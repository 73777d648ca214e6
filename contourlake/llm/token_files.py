"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a row of blocks. A block holds whole documents in ascending order of their ids: a head, the
documents' ids and sizes, then for every four tokens one control byte (two bits each: bytes less one)
and after all of these the tokens' own bytes, low ones first. What is coded is a token's rank by
frequency, so that most tokens take one byte. Decoding looks up, for each control byte, which of the
following bytes go where, for a whole block at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import GAP, slices, text_buffer
from .packing import WordIds, tokenizer_file
from .store import scratch_path, table, written

#: How a block begins.
MAGIC = b"CLT1"
#: Tokens after which a block ends, with the document that it is in.
BLOCK = 1 << 18
#: Bytes of segments that a vocabulary remembers.
REMEMBERED_BYTES = 64 << 20
#: Segments handled at once, of a text of any length.
SEGMENTS = 1 << 20

#: Tasks that read files.
MOST_TASKS = 10_000

_BYTES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3  # of each control byte: the four tokens' bytes, less one
#: Bytes that follow a control byte.
FOLLOWING = (_BYTES + 1).sum(1)
#: Where each of a control byte's 16 output bytes lies among those that follow; those that aren't there are 0 and masked.
_FROM = (np.cumsum(_BYTES + 1, 1) - _BYTES - 1)[:, :, None] + np.arange(4)
THERE = (np.arange(4) <= _BYTES[:, :, None]).reshape(256, 16)
TAKEN = np.where(THERE, _FROM.reshape(256, 16), 0)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    four = np.zeros(-len(ranks) // 4 * -4, "<u4")
    four[: len(ranks)] = ranks
    more = (four > 0xFF).astype(np.uint8) + (four > 0xFFFF) + (four > 0xFFFFFF)
    control = (more.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return control.tobytes(), four.view(np.uint8).reshape(-1, 16)[THERE[control]].tobytes()


def decoded(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``coded`` made these bytes of."""
    code, raw = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    size = FOLLOWING[code]
    if size.sum() != len(raw) or -n // 4 * -1 != len(code):
        raise ValueError("control bytes and data don't fit together")
    at = (np.cumsum(size) - size)[:, None] + TAKEN[code]
    return np.ascontiguousarray(np.where(THERE[code], raw[at], 0).astype(np.uint8)).view("<u4").reshape(-1)[:n] if n else np.zeros(0, "<u4")


#: Kinds of bytes: 1 white space, 2 letters, 3 printable, of ASCII; others 0.
KIND = np.select([GAP, np.isin(np.arange(256) | 0x20, np.arange(0x61, 0x7B)) & (np.arange(256) < 0x80), (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)], [1, 2, 3], 0).astype(np.uint8)


def starts_of_segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where segments of texts begin: a tokenizer of this kind never joins text across such a place, nor looks beyond it.

    That is at each text; at white space after anything else; at what isn't a letter after a letter (all ASCII); and at
    anything after a single line end. Nothing begins after white space, or a control character that may
    count as such, outside ASCII's.
    """
    kind = KIND[data]
    now, last = kind[1:], kind[:-1]
    space = (now == 1) & (last != 1)
    at = np.flatnonzero(space | ((now == 3) & (last == 2))) + 1
    before = data[at - 1]
    fine = ~((before >= 0x1C) & (before <= 0x1F))
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        c, b, a = (data[np.maximum(at[wide] - k, 0)].astype(np.int64) for k in (1, 2, 3))
        two, three = b << 8 | c, a << 16 | b << 8 | c
        blank = (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three == 0xE1A08E) | (three == 0xE2819F) | (three == 0xE38080)
        blank |= (three >= 0xE28080) & (three <= 0xE2808A) | (three == 0xE280A8) | (three == 0xE280A9) | (three == 0xE280AF)
        fine[wide] = ~blank
    at = at[fine]
    line = at[data[at] == 0x0A]
    line = line[line + 1 < len(data)]
    line = line[KIND[data[line + 1]] >= 2] + 1
    first = np.zeros(len(data) + 1, bool)
    for places in (at, line, offsets[:-1][np.diff(offsets) > 0]):
        first[places] = True
    return np.flatnonzero(first)


class SegmentIds(WordIds):
    """Ids of segments of text, each encoded once and forgotten when too many, or too many bytes, are held."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__(path, most)
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def reset(self) -> None:
        super().reset()
        self.held = 0

    def __missing__(self, segment: bytes) -> int:
        self.held += len(segment)
        return super().__missing__(segment)

    def ids_of(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the segments that begin at all but the last of ``starts``: how many ids each has, and all ids."""
        if len(self) > self.most or self.held > REMEMBERED_BYTES:
            self.reset()
        found = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        known = found.dictionary.to_pylist()
        row = np.fromiter(map(self.__getitem__, known), np.int64, len(known))[found.indices.to_numpy()]
        if self.pending:
            self._encode()
        size = self.size[row]
        ends = np.cumsum(size)
        return size, self.ids[np.repeat(self.start[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the texts' segments begin, none within the name of a special token."""
        starts = starts_of_segments(raw, offsets)
        whole = raw.tobytes() if len(self.names) else b""
        for name in self.names:
            at = whole.find(name)
            while at >= 0:
                low, high = np.searchsorted(starts, (at + 1, at + len(name)))
                if at + len(name) <= offsets[np.searchsorted(offsets, at, "right")]:
                    starts = np.delete(starts, slice(low, high))
                at = whole.find(name, at + len(name))
        return starts


_HELD: dict[str, SegmentIds] = {}


def segment_ids(name: str) -> SegmentIds:
    if name not in _HELD:
        _HELD[name] = SegmentIds(tokenizer_file(name))
    return _HELD[name]


def text_ids(vocabulary: SegmentIds, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each text has, and the ids of all."""
    starts = vocabulary.starts(data, offsets)
    bounds = np.append(starts, len(data))
    found = [vocabulary.ids_of(data, bounds[k : k + SEGMENTS + 1]) for k in range(0, len(starts), SEGMENTS)]
    if not found:
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint32)
    sums = np.concatenate(([0], np.cumsum(np.concatenate([size for size, _ in found]))))
    return np.diff(sums[np.searchsorted(starts, offsets)]), np.concatenate([ids for _, ids in found])


def _tokens(tokenizer: str, end_id: int, kind: str):
    """Scratch rows: a document's id, and its ids with the end id in ``kind``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])

    def scan(batches):
        vocabulary = segment_ids(tokenizer)
        for batch in slices(batches, most=4 << 20):
            data, at = text_buffer(batch.column(1))
            size, ids = text_ids(vocabulary, data, at)
            ends = np.cumsum(size + 1)
            out = np.full(int(ends[-1]), end_id, kind)
            spot = np.ones(len(out), bool)
            spot[ends - 1] = False
            out[spot] = ids
            bounds = np.concatenate(([0], ends)) * out.itemsize
            column = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0), column], schema=schema)

    return scan


def flat_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of ids: how many each row has, and all."""
    data, at = text_buffer(column.cast(pa.large_binary()).view(pa.large_string()))
    ids = np.frombuffer(data.tobytes(), kind)
    return np.diff(at) // ids.itemsize, ids


def _frequencies(kind: str, most: int):
    """(id, how often) for a task's rows."""

    def scan(batches):
        total = np.zeros(most, np.int64)
        for batch in batches:
            total += np.bincount(flat_ids(batch.column(0), kind)[1], minlength=most)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return scan


def _filesystem(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


def block(docs: pa.Array, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = coded(ranks)
    head = np.array([len(docs), len(ranks), len(control), len(data)], "<i8").tobytes()
    absent = docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    return b"".join((MAGIC, head, docs.fill_null(0).to_numpy().astype("<i8").tobytes(), absent.tobytes(), sizes.astype("<i8").tobytes(), control, data))


def blocks(file) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(documents, sizes, ranks) of each block of an open file."""

    def exactly(n: int) -> bytes:
        body = file.read(n)
        if len(body) != n:
            raise ValueError("a token file ends within a block")
        return body

    while start := file.read(len(MAGIC)):
        if start != MAGIC:
            raise ValueError("not a block of token ids")
        n_docs, n, controls, data = np.frombuffer(exactly(32), "<i8").tolist()
        docs, absent = np.frombuffer(exactly(8 * n_docs), "<i8"), np.frombuffer(exactly(n_docs), np.uint8)
        sizes = np.frombuffer(exactly(8 * n_docs), "<i8")
        control = exactly(controls)
        yield pa.array(docs, mask=absent.astype(bool)), sizes, decoded(control, exactly(data), n)


FILES = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
FILES_DDL = "part int, file string, n_docs long, n_ids long, n_bytes long"


def _store(root: str, rank: np.ndarray, kind: str):
    """Writes a sorted partition's documents as one file. Its name is this attempt's own, and only a task that ends well tells it."""

    def scan(batches):
        from pyspark import TaskContext

        (fs, base), out, name = _filesystem(root), None, f"{uuid.uuid4().hex}.ids"
        held, n_held, total = [], 0, np.zeros(3, np.int64)

        def flush():
            body = block(pa.concat_arrays([d for d, _, _ in held]), np.concatenate([s for _, s, _ in held]), np.concatenate([r for _, _, r in held]))
            out.write(body)
            total[:] += (sum(len(d) for d, _, _ in held), n_held, len(body))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
            sizes, ids = flat_ids(batch.column(1), kind)
            ends, low = np.cumsum(sizes), 0
            while low < len(sizes):
                high = min(len(sizes), int(np.searchsorted(ends, (ends[low - 1] if low else 0) + max(1, BLOCK - n_held))) + 1)
                a, b = int(ends[low - 1]) if low else 0, int(ends[high - 1])
                held.append((batch.column(0).slice(low, high - low), sizes[low:high], rank[ids[a:b]]))
                n_held, low = n_held + b - a, high
                if n_held >= BLOCK:
                    flush()
                    n_held = 0
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((TaskContext.get().partitionId(), name, *total.tolist()), FILES, strict=True)], schema=FILES)

    return scan


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Writes every text's ids, with ``end_id`` after each, in ascending order of ``id_col``; one row for each file, in ``part``'s order.

    ``folder`` (shared, new) gets ``data`` with the files, and the tables ``ranks`` (rank, id, n) and ``files``. Texts are
    encoded as the library does by default: a special token's name in a text is that token. Texts are
    encoded once and cut at white space, so neither the number of documents nor a text's length bounds a
    task; one document's ids and a block are held at a time. Files are ranges of (id, hash of the ids, row),
    so a third of all rows with one id still go to several files. Null ids come first, a null text has
    the end id alone, repeated rows stay. What the driver holds is bounded by the vocabulary. An empty
    table makes no file.
    """
    spark = docs.sparkSession
    most = segment_ids(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True)
    most = max(most, end_id + 1)
    kind = "<u2" if most <= 1 << 16 else "<u4"
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tokens = written(narrow.mapInArrow(_tokens(tokenizer, end_id, kind), "doc_id long, ids binary"), "tokens", dictionary=False, codec="zstd")
    counted = tokens.select("ids").mapInArrow(_frequencies(kind, most), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = sorted(((r["id"], r["n"]) for r in counted), key=lambda r: (-r[1], r[0]))
    rank = np.zeros(most, "<u4")
    rank[[i for i, _ in ranked]] = np.arange(len(ranked))
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(ranked)], "rank long, id long, n long").write.parquet(f"{folder}/ranks")
    keyed = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    dealt.select("doc_id", "ids").mapInArrow(_store(f"{folder}/data", rank, kind), FILES_DDL).write.parquet(f"{folder}/files")
    return token_files(spark, folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, with ``base``: the ids in all files before. The window goes over one row for each file."""
    found = spark.read.schema(FILES_DDL).parquet(f"{folder}/files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _load(root: str, ids: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.large_binary())])

    def scan(batches):
        fs, base = _filesystem(root)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as file:
                    for docs, sizes, ranks in blocks(file):
                        ends = np.cumsum(sizes)
                        bounds = (np.concatenate(([0], ends)) * 4).astype(np.int64)
                        column = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(bounds), pa.py_buffer(ids[ranks])])
                        yield pa.RecordBatch.from_arrays([docs, pa.array(start + ends - sizes), column], schema=schema)
                        start += int(ends[-1]) if len(ends) else 0

    return scan


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder: doc_id, start (ids of all documents before it) and ids (little-endian, 32 bits each).

    One row for each row written. A file is read by one task, block by block.
    """
    ranked = spark.read.parquet(f"{folder}/ranks").collect()  # no longer than the vocabulary
    ids = np.zeros(len(ranked), "<u4")
    ids[[r["rank"] for r in ranked]] = [r["id"] for r in ranked]
    n_files = spark.read.parquet(f"{folder}/files").count()
    files = token_files(spark, folder).select("file", "base").repartition(max(1, min(n_files, MOST_TASKS)))  # by number, so that few rows aren't made one task
    return files.mapInArrow(_load(f"{folder}/data", ids), "doc_id long, start long, ids binary")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
