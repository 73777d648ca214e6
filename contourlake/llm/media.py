"""Media columns: content-addressed payloads in tar shards, found again by digest, offset and length.

A text's bytes, padded with zeros to whole rows of 64, are stored losslessly as a grey image of 8-bit
samples (PNG). Shards lie in the cluster's shared folder and are written and read through Arrow's file
systems; a shard's name is made by the task attempt that writes it, and rows name only shards whose
task ended well, so lost executors and repeated tasks leave no wrong row.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .kernels import slices, text_buffer
from .store import scratch_path, table, written

WIDTH = 64
HEADER = 33  # signature and IHDR chunk
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """A grey 8-bit image of 64 columns, without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Columns, rows and bits of a sample, from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; every chunk's checksum is verified."""
    width, height, bits = png_header(image)
    at, body = 8, b""
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        kind, part = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("not an image of this store")
    return lines[:, 1:].tobytes()


def _filesystem(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


PLACES = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PLACES_DDL = "digest string, shard string, offset long, length long"
IMAGES = pa.schema([("digest", pa.string()), ("image", pa.binary())])


class ShardWriter:
    """Appends members to tar files of about ``shard_bytes`` under ``root``, and tells where their bodies lie."""

    def __init__(self, root: str, shard_bytes: int):
        self.fs, self.base = _filesystem(root)
        self.fs.create_dir(self.base, recursive=True)
        self.most, self.out, self.name, self.at = shard_bytes, None, "", 0

    def add(self, digest: str, image: bytes) -> tuple[str, int]:
        if self.out is None or self.at > self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
        member = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        member.size = len(image)
        for part in (member.tobuf(tarfile.USTAR_FORMAT), image, b"\0" * (-len(image) % 512)):
            self.out.write(part)
            self.at += len(part)
        return self.name, self.at - len(image) - -len(image) % 512

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _digests(batch: pa.RecordBatch):
    data, at = text_buffer(batch.column(0))
    raw = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield hashlib.sha256(raw[a:b]).digest(), raw[a:b]


def _keyed(batches):
    """The texts of each part; and the keys: 64 bits of their digests."""
    for batch in slices(batches):
        found = list(_digests(batch))
        yield found, np.frombuffer(b"".join(d for d, _ in found), np.uint64)[::4].copy()


def _candidates(log_pieces: int):
    """What segments ask: to which of their digests they are the first. Whole keys are sent, a segment's least copy only."""

    def scan(batches):
        for segment in ranges.segments(_keyed(batches)):
            keys = ranges.joined(segment)
            seg, own = ranges.name_of(keys), np.unique(keys)
            piece = (own >> np.uint64(64 - log_pieces)).astype(np.int64)
            cut = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(own)]
            yield ranges.batch_of([(seg, 0, int(piece[low]), own[low:high].tobytes()) for low, high in zip(cut[:-1], cut[1:], strict=True)])

    return scan


def _elected(bodies):
    """Each key goes to one of the segments that have it, to the least in the order of their names."""
    bodies = sorted(bodies)
    keys = [np.frombuffer(body, np.uint64) for _, body in bodies]
    first = np.zeros(sum(map(len, keys)), bool)
    first[np.unique(np.concatenate(keys), return_index=True)[1]] = True
    for (seg, _), mine in zip(bodies, np.split(first, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        yield seg, np.uint32(len(mine)).tobytes() + np.packbits(mine).tobytes()


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return ranges.batch_of(rows, PLACES)


def _first_written(root: str, shard_bytes: int, told: str):
    """Stores the texts that the segment was elected to store. A segment without an answer stores none; nor does a second text of one key."""

    def scan(batches):
        shards = ShardWriter(root, shard_bytes)
        for segment in ranges.segments(_keyed(batches)):
            keys = ranges.joined(segment)
            at = np.unique(keys, return_index=True)[1]
            found = [np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=int.from_bytes(b[:4], "little")) for b in ranges.answer_rows(told, ranges.name_of(keys)).values()]
            mine = np.concatenate(found).astype(bool) if found else np.zeros(0, bool)
            store = set(at[mine].tolist()) if len(mine) == len(at) else set()
            rows, k = [], 0
            for found, _ in segment:
                for digest, text in found:
                    if k in store:
                        image = to_png(payload(text))
                        rows.append((digest.hex(), *shards.add(digest.hex(), image), len(image)))
                    k += 1
            yield _places(rows)
        shards.close()

    return scan


def _then_written(root: str, shard_bytes: int):
    """Stores each digest's text; a digest has one row."""

    def scan(batches):
        shards = ShardWriter(root, shard_bytes)
        for batch in batches:
            rows = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = to_png(payload(text.as_py().encode()))
                rows.append((digest, *shards.add(digest, image), len(image)))
            yield _places(rows)
        shards.close()

    return scan


def _read_at(root: str, columns: dict[str, pa.DataType], of, length):
    """A scan that opens each shard once in a row, reads ``length(row)`` bytes at each offset and adds what ``of`` makes of them."""
    schema = pa.schema([*PLACES, *columns.items()])

    def scan(batches):
        fs, base = _filesystem(root)
        name, file = None, None
        for batch in batches:
            found = []
            for shard, offset, size in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                found.append(of(file.read_at(length(size), offset)))
            values = list(zip(*found, strict=True)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACES.names), *(pa.array(v, t) for v, t in zip(values, columns.values(), strict=True))], schema=schema)

    return scan


def digest_of(text_col: str) -> Column:
    return F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)


def store_texts(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """(digest, shard, offset, length) of every distinct text's image, and the folder of the shards.

    ``digest`` is the text's SHA-256. Segments of the scan ask ranges of the digests to which texts they
    are the first, and store these as they read them: texts aren't shuffled, and a text that every task
    has costs each eight bytes. Digests without a place afterwards (where the table was read in other
    splits, or two texts share 64 bits) are stored by a shuffle of just their texts. A shard takes
    members until it exceeds ``shard_bytes``. Null texts count as empty. Repeated texts share a place.
    An empty table makes no shard.
    """
    root = scratch_path(docs.sparkSession, "media")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    log_pieces = max(4, docs.count().bit_length() - ranges.LOG_KEYS)
    told = ranges.answers(texts.mapInArrow(_candidates(log_pieces), ranges.DDL), _elected)
    first = written(texts.mapInArrow(_first_written(root, shard_bytes, told), PLACES_DDL), "media-first")
    digests = texts.select(digest_of("text").alias("digest"))
    missing = written(digests.distinct().join(first.select("digest"), "digest", "left_anti"), "media-missing")
    if not missing.limit(1).count():
        return first, root
    again = texts.select(digest_of("text").alias("digest"), "text").join(missing, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return first.unionByName(written(again.mapInArrow(_then_written(root, shard_bytes), PLACES_DDL), "media-again")), root


def with_header(places: DataFrame, root: str) -> DataFrame:
    """``places`` with ``width``, ``height`` and ``bits``, from a read of 33 bytes of each image."""
    columns = {"width": pa.int32(), "height": pa.int32(), "bits": pa.int32()}
    return places.mapInArrow(_read_at(root, columns, png_header, lambda n: HEADER), "digest string, shard string, offset long, length long, width int, height int, bits int")


def _features(image: bytes) -> tuple:
    samples = from_png(image)
    values = np.frombuffer(samples, np.uint8).astype(np.int64)
    width, height, bits = png_header(image)
    feature = f"{width}x{height}x{bits} mean={values.sum() / len(values):.4f} square={(values * values).sum() / len(values):.4f} zero={int((values == 0).sum())}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature


def read_back(places: DataFrame, root: str) -> DataFrame:
    """``places`` with what the whole stored images show."""
    columns = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    ddl = "digest string, shard string, offset long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return places.mapInArrow(_read_at(root, columns, _features, lambda n: n), ddl)


MEDIA = ("digest", "shard", "offset", "length", "width", "height", "bits")


def media_columns(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with ``digest``, ``shard``, ``offset``, ``length``, ``width``, ``height`` and ``bits`` in place of the text, and the shards' folder.

    Columns of ``docs`` with these names are replaced, in any case of letters; other columns and all rows stay, repeated ones too. Null and
    empty texts have an image of one row. An empty table gives no rows.
    """
    places, root = store_texts(docs, text_col)
    found = with_header(places, root)
    others = [c for c in docs.columns if c.lower() not in MEDIA and c.lower() != text_col.lower()]
    named = docs.select(*(F.col(f"`{c}`") for c in others), digest_of(text_col).alias("digest"))
    place = found.select(F.col("digest").alias("digest_of_place"), F.struct(*MEDIA[1:]).alias("place_of_digest"))
    joined = named.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "digest") if others else named
    joined = joined.join(place, F.col("digest") == F.col("digest_of_place"))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in others), "digest", *(F.col("place_of_digest").getField(c).alias(c) for c in MEDIA[1:])), root


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    places, root = store_texts(docs)
    named = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest_of("text").alias("digest"))
    found = read_back(places, root).drop("length").join(with_header(places, root).select("digest", "height"), "digest")
    return named.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", F.col("height").alias("n_rows"))
