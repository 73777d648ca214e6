"""Line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

A line is what lies between ``\\n``; it is compared without surrounding ASCII white space and with A-Z
lowered. Lines without a word are never touched.

Signatures use one-permutation hashing: a shingle's hash picks one of ``BANDS * ROWS`` bins and the bin
keeps its least value, so that the cost doesn't grow with the signature; an empty bin borrows from the
first filled one in a random order of its own. With 20 bands of 8 rows, lines of similarity 0.8 meet in
a band with probability 0.97 (0.9: more than 0.9999), while lines below 0.3, which nearly all pairs
are, meet once in a thousand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .components import by_unit, components, joined_within, linking
from .kernels import mix, slices, text_buffer
from .store import table, written

SHINGLE, BANDS, ROWS = 5, 20, 8
BINS = BANDS * ROWS
#: Lines whose signatures are made at once, which bounds memory when lines are short.
LINES_AT_ONCE = 4096
#: Bytes of lines that are compared at once, which bounds memory when lines are long.
BYTES_AT_ONCE = 1 << 20
EMPTY = np.uint32(0xFFFFFFFF)
#: Odd factors of a shingle's characters.
FACTORS = np.random.default_rng(5).integers(0, 2**31, SHINGLE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: For each attempt and bin, the bin to borrow from.
DONORS = np.random.default_rng(160).integers(0, BINS, (64, BINS))


def normal(line: bytes) -> bytes:
    return line.strip(b" \t\n\r\x0b\x0c").lower()


def line_id(line: bytes) -> bytes:
    return hashlib.md5(line).digest()


def text_tag(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(text).digest()[:3], "big")


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines in a row, and where each line's begin.

    A line of fewer than five characters is one shingle.
    """
    points = np.frombuffer((b"\0" * (SHINGLE - 1)).join([*lines, b""]).decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(x.decode()) for x in lines], np.int64)
    at = np.cumsum(length + SHINGLE - 1) - (length + SHINGLE - 1)
    h = np.zeros(max(0, len(points) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)]
    count = np.maximum(1, length - SHINGLE + 1)
    first = np.cumsum(count) - count
    pick = np.repeat(at - first, count) + np.arange(int(count.sum()))
    return mix(h[pick]), np.append(first, count.sum())


def signatures(lines: list[bytes]) -> np.ndarray:
    """One row of ``BINS`` least hashes for each line."""
    n, gap = len(lines), SHINGLE - 1
    points = np.frombuffer((b"\0" * gap).join([*lines, b""]).decode().encode("utf-32-le"), np.uint32)
    length = np.array([len(x.decode()) for x in lines], np.int64)
    h = np.zeros(len(points) - gap, np.uint32)
    for k, factor in enumerate(FACTORS):
        h += points[k : k + len(h)] * factor
    count = np.maximum(1, length - gap)
    whole = np.repeat(np.tile([True, False], n), np.stack([count, length + gap - count], axis=1).ravel())
    h = h[whole[: len(h)]]
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h ^= h >> np.uint32(15)
    cell = np.repeat(np.arange(n) * BINS, count) + ((h >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16))
    value = h * np.uint32(0x9E3779B1)
    value = (value ^ (value >> np.uint32(15))) >> np.uint32(1)
    least = np.full(n * BINS, EMPTY, np.uint32)
    np.minimum.at(least, cell, value)
    least = least.reshape(n, BINS)
    out = least.copy()
    line, column = np.nonzero(least == EMPTY)
    for donors in DONORS:
        found = least[line, donors[column]]
        ok = found != EMPTY
        out[line[ok], column[ok]] = found[ok]
        line, column = line[~ok], column[~ok]
        if not len(line):
            break
    if len(line):
        out[line, column] = least.min(axis=1)[line]
    return out


def band_keys(lines: list[bytes]) -> np.ndarray:
    """A 32-bit key for each line and band."""
    rows = signatures(lines).reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k] + np.uint64(1))
    return (out >> np.uint64(32)).astype(np.uint32)


def tokens(bands: list[bytes]) -> np.ndarray:
    """64-bit tokens of packed band keys, one for each line and band."""
    keys = np.frombuffer(b"".join(bands), np.uint32).reshape(-1, BANDS).astype(np.uint64)
    return mix(keys | (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))).reshape(-1)


def portions(sizes: np.ndarray, most: int):
    """(low, high) of neighbours that have about ``BYTES_AT_ONCE`` bytes, or a single one more, and number ``most`` at most."""
    at, low = np.append(0, np.cumsum(sizes)), 0
    while low < len(sizes):
        high = int(np.searchsorted(at, at[low] + BYTES_AT_ONCE, side="right")) - 1
        high = max(low + 1, min(high, low + most))
        yield low, high
        low = high


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each normal line."""
    out = []
    for low, high in portions(np.array([len(x) for x in lines], np.int64), LINES_AT_ONCE):
        h, bounds = shingle_hashes(lines[low:high])
        out += [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def similar_pairs(lines: list[bytes], a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether lines a[k] and b[k] are similar, for up to 4096 pairs of up to 4096 lines.

    52 bits of each shingle's hash and 12 of its line, or pair, are sorted at once: repeats are then neighbours.
    """
    h, bounds = shingle_hashes(lines)
    low = np.uint64(12)
    key = np.sort((h >> low) | (np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(bounds)) << np.uint64(52)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    size = np.bincount((key >> np.uint64(52)).astype(np.int64), minlength=len(lines))
    start = np.cumsum(size) - size
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    out = den * small >= num * large
    pair = np.flatnonzero(out)
    parts = []
    for side in (a[pair], b[pair]):
        n = size[side]
        at = np.repeat(start[side] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        parts.append((key[at] & np.uint64((1 << 52) - 1)) | (np.repeat(np.arange(len(pair), dtype=np.uint64), n) << np.uint64(52)))
    both = np.sort(np.concatenate(parts))
    twice = both[1:][both[1:] == both[:-1]] >> np.uint64(52)
    common = np.bincount(twice.astype(np.int64), minlength=len(pair))
    out[pair] = den * common >= num * (small[pair] + large[pair] - common)
    return out


def _split(batch: pa.RecordBatch):
    """(id, place, normal line) of every line with a word."""
    data, at = text_buffer(batch.column(1))
    raw = data.tobytes()
    for i, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        text = raw[a:b]
        tag = text_tag(text) << 32
        for k, x in enumerate(text.split(b"\n")):
            if x := normal(x):
                yield i, tag | k, x


LINES = pa.schema([("line", pa.binary()), ("doc", pa.int64()), ("place", pa.int64()), ("bands", pa.binary()), *ranges.SCHEMA])
LINES_DDL = f"line binary, doc long, place long, bands binary, {ranges.DDL}"
#: Line ids that a task remembers to band each line once; further copies are only banded again.
REMEMBERED = 1 << 20


def _found(batches):
    """The lines of each part of text; and the keys: their ids' hashes."""
    for batch in slices(batches):
        found = list(_split(batch))
        line = [line_id(x) for *_, x in found]
        yield (found, line), id_hashes(line)


def _lines(dealt: ranges.Ranges):
    """Every line's place; the first of equal lines in the task also with its band keys. Segments ask which lines are wanted."""

    def scan(batches):
        seen: set[bytes] = set()
        for segment in ranges.segments(_found(batches)):
            for (found, ids), _ in segment:
                for low in range(0, len(found), LINES_AT_ONCE):
                    doc, place, body = zip(*found[low : low + LINES_AT_ONCE], strict=True)
                    line = ids[low : low + LINES_AT_ONCE]
                    fresh = []
                    for k, x in enumerate(line):
                        if x not in seen:
                            fresh.append(k)
                            if len(seen) < REMEMBERED:
                                seen.add(x)
                    bands: list[bytes | None] = [None] * len(line)
                    if fresh:
                        for k, keys in zip(fresh, band_keys([body[k] for k in fresh]), strict=True):
                            bands[k] = keys.tobytes()
                    own = [pa.array(c, f.type) for c, f in zip((line, doc, place, bands), LINES, strict=False)]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(line), f.type) for f in ranges.SCHEMA)], schema=LINES)
            asked = ranges.batch_of(ranges.questions(ranges.joined(segment), dealt, counted=False))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(asked.num_rows, LINES.field(k).type) for k in range(4)), *asked.columns], schema=LINES)

    return scan


def _tokens(batches):
    """Line numbers; and the keys: the tokens of their bands."""
    for batch in batches:
        for low in range(0, batch.num_rows, LINES_AT_ONCE):
            part = batch.slice(low, LINES_AT_ONCE)
            yield part.column(0), tokens(part.column(1).to_pylist())


def _counted(dealt: ranges.Ranges):
    """Segments ask how many lines have each of their tokens."""

    def scan(batches):
        for segment in ranges.segments(_tokens(batches), most_parts=64):
            yield ranges.batch_of(ranges.questions(ranges.joined(segment), dealt))

    return scan


def _wanted(dealt: ranges.Ranges):
    """Members, which count but don't ask."""

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                yield ranges.batch_of(ranges.questions(id_hashes(batch.column(0).to_pylist()), dealt, asked=False))

    return scan


def _postings(told: ranges.Answers):
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def scan(batches):
        for segment in ranges.segments(_tokens(batches), most_parts=64):
            again, used = told.classes(ranges.joined(segment)) > 1, 0
            for ids, keys in segment:
                pick = np.flatnonzero(again[used : used + len(keys)])
                used += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[pick].view(np.int64)), ids.take(pa.array(pick // BANDS)), pa.array(np.ones(len(pick), np.int64))], schema=schema)

    return scan, "token long, id long, n long"


def id_hashes(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.uint64)[::2].copy()


def _bodies(told: ranges.Answers):
    """Lines that may be wanted, once in a task as far as it remembers."""
    schema = pa.schema([("line", pa.binary()), ("body", pa.binary())])

    def scan(batches):
        seen: set[bytes] = set()
        for segment in ranges.segments(_found(batches)):
            wanted, used = told.classes(ranges.joined(segment)) > 0, 0
            for (found, line), keys in segment:
                out = []
                for k in np.flatnonzero(wanted[used : used + len(keys)]).tolist():
                    if line[k] not in seen:
                        out.append((line[k], found[k][2]))
                        if len(seen) < REMEMBERED:
                            seen.add(line[k])
                used += len(keys)
                yield ranges.batch_of(out, schema)

    return scan


def _alike(num: int, den: int):
    def scan(batches):
        for batch in batches:
            x, y, keep = batch.column("x"), batch.column("y"), []
            sizes = sum(pa.compute.binary_length(side).to_numpy(zero_copy_only=False).astype(np.int64) for side in (x, y))
            for low, high in portions(sizes, LINES_AT_ONCE // 2):
                number: dict[bytes, int] = {}
                a, b = (np.array([number.setdefault(t, len(number)) for t in side.slice(low, high - low).to_pylist()], np.int64) for side in (x, y))
                keep.append(similar_pairs(list(number), a, b, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return scan


def _alike_blocks(num: int, den: int):
    """What connects the linked members of each unit, given with their lines."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]):
        ids, groups, block, bodies = zip(*rows, strict=True)
        for i, j in joined_within(shingle_sets(list(bodies)), np.array(groups), np.array(block), num, den):
            yield min(ids[i], ids[j]), max(ids[i], ids[j])

    return by_unit(links, ("id", "group", "block", "body"), schema)


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 8, den: int = 10, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``doc`` and ``place`` of every line with a word, in rows whose id isn't null, and of the lines that go.

    Of each component of similar lines (den * common shingles >= num * all) the line with the least
    (id, text, line number) is kept. ``place`` is a tag of the text, times 2**32, plus the line number.
    Exact copies are one line from the start: each is banded once by a task and once in all. Bands that
    surely one line has are left out, and only the lines that share a band with another are read again
    to be compared; of both, segments are told by ranges of the hash. Rows that share an id and a text
    lose the same lines; an empty table gives no rows.
    """
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = ranges.ranges_for(size // 64)
    found = written(narrow.mapInArrow(_lines(dealt), LINES_DDL), "lines", dictionary=False)
    lines = found.where("line IS NOT NULL").select("line", "doc", "place")
    banded = written(found.where("bands IS NOT NULL").select("line", "bands").distinct().withColumn("id", F.monotonically_increasing_id()), "bands", dictionary=False)
    by_band = ranges.ranges_for(BANDS * banded.count())
    bands = banded.select("id", "bands")
    told = ranges.answers(bands.mapInArrow(_counted(by_band), ranges.DDL), ranges.counts_in(by_band))
    scan, schema = _postings(ranges.Answers(told, by_band))
    postings = written(bands.mapInArrow(scan, schema), "postings")
    shared = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    postings = written(postings.join(shared, "token"), "shared-bands")
    wanted = written(banded.select("line", "id").join(postings.select("id").distinct(), "id", "left_semi"), "wanted-lines")
    asked = found.where("body IS NOT NULL").select(*ranges.SCHEMA.names)
    told = ranges.answers(asked.unionByName(wanted.select("line").mapInArrow(_wanted(dealt), ranges.DDL)), ranges.counts_in(dealt))
    bodies = narrow.mapInArrow(_bodies(ranges.Answers(told, dealt)), "line binary, body binary").distinct()
    bodies = written(bodies.join(wanted, "line").select("id", "body"), "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        first = bodies.select(F.col("id").alias("a"), F.col("body").alias("x"))
        second = bodies.select(F.col("id").alias("b"), F.col("body").alias("y"))
        return written(pairs.join(first, "a").join(second, "b").mapInArrow(_alike(num, den), "a long, b long"), "similar-lines")

    def verified_blocks(units: DataFrame) -> DataFrame:
        dealt = units.join(bodies, "id").repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
        return written(dealt.mapInArrow(_alike_blocks(num, den), "a long, b long").distinct(), "similar-blocks")

    links = linking(postings, verified, "true", verified_blocks, rounds)
    leaders = lines.groupBy("line").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("copies"))
    if links is None:
        chosen = leaders.where("copies > 1").select("line", F.col("first").alias("keep"))
    else:
        groups = components(links).join(wanted, "id").select("line", "component")
        named = written(leaders.join(groups, "line", "left").where("copies > 1 OR component IS NOT NULL").select("line", "first", "component"), "line-groups")
        keepers = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("keep"))
        chosen = named.join(keepers, "component", "left").select("line", F.coalesce("keep", "first").alias("keep"))
    return lines, lines.join(chosen, "line").where((F.col("doc") != F.col("keep.doc")) | (F.col("place") != F.col("keep.place"))).select("doc", "place")


def _without(text_col: str, keep_emptied: bool):
    def scan(batches):
        for batch in slices(batches, text_col):
            data, at = text_buffer(batch.column(text_col))
            raw = data.tobytes()
            out, stays = [], []
            for k, places in enumerate(batch.column("_places")):
                text = raw[at[k] : at[k + 1]]
                had = places.is_valid and not keep_emptied
                if places.is_valid:
                    found = places.values.to_numpy()
                    gone = set((found[found >> 32 == text_tag(text)] & 0xFFFFFFFF).tolist())
                    text = b"\n".join(x for j, x in enumerate(text.split(b"\n")) if j not in gone)
                out.append(text.decode())
                stays.append(not had or bool(normal(text)))
            text = pa.compute.if_else(batch.column(text_col).is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))
            names = [n for n in batch.schema.names if n not in ("_id", "_places")]
            yield pa.RecordBatch.from_arrays([text if n == text_col else batch.column(n) for n in names], names=names).filter(pa.array(stays, pa.bool_()))

    return scan


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_emptied: bool = True, **options) -> DataFrame:
    """``docs`` with only the kept line of each component; other lines, and lines without a word, stay.

    Columns, null texts and rows stay, but for rows left without a word if not ``keep_emptied``. Columns named ``_id`` or
    ``_places`` aren't allowed.
    """
    if clash := {"_id", "_places"} & set(docs.columns):
        raise ValueError(f"columns not allowed: {sorted(clash)}")
    gone = line_decisions(docs, id_col, text_col, **options)[1].groupBy(F.col("doc").alias("_id")).agg(F.collect_list("place").alias("_places"))
    joined = docs.join(gone, docs[id_col].cast("long") == gone["_id"], "left")
    return joined.mapInArrow(_without(text_col, keep_emptied), docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with an id: its lines with a word, how many go, and which (numbers from 0, in order)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines, gone = line_decisions(docs)
    counted = lines.select("doc", "place").distinct().groupBy("doc").agg(F.count("*").alias("n"))
    number = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    listed = gone.groupBy(F.col("doc").alias("gone_doc")).agg(F.array_sort(F.collect_set(number)).alias("gone"))
    joined = docs.select("doc_id").join(counted, F.col("doc_id") == F.col("doc"), "left").join(listed, F.col("doc_id") == F.col("gone_doc"), "left")
    numbers = F.coalesce("gone", F.array().cast("array<long>"))
    return joined.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"), F.size(numbers).cast("long").alias("n_removed"), numbers.alias("removed_lines"))
