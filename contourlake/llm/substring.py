"""Substring dedup: a count-min prefilter, then exact grouping of the windows it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .kernels import Words, grams, inside, mix, slices, sliding_min, text_buffer, words
from .store import table, written

#: Rows of the sketch, and bytes of text for each anchor (a half window of two words' bytes or so, at least).
DEPTH, BYTES_EACH = 2, 64


def _spans(w: Words, window: int):
    """Valid window starts, and for each the hash of its anchor.

    The anchor of a window is the least hash of the half-length word runs in it. Equal windows have
    equal anchors, so a window's anchor occurs at least as often as the window; a text has some
    dozen times fewer anchors than windows, and the sketch counts anchors.
    """
    half = window // 2
    h = w.hashes(0)
    ok = inside(w.bounds, window, len(h))
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, sliding_min(grams(h, half), window - half + 1)[at]


def _digest(text: bytes) -> bytes:
    return hashlib.md5(b" ".join(text.split())).digest()


def _tag(digest: bytes) -> int:
    return int.from_bytes(digest[:3], "big")


def _texts(data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _anchored(batches, window: int):
    """Parts of text, each with its words, window starts, their anchors, and which of these are new in a row; and the keys: the new ones."""
    for batch in slices(batches):
        w = words(*text_buffer(batch.column(1)))
        start, anchor = _spans(w, window)
        fresh = np.ones(len(start), bool)
        if len(start):
            owner = np.searchsorted(w.bounds, start, side="right")
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        yield (batch, w, start, anchor, fresh), anchor[fresh]


def _first_scan(window: int, dealt: ranges.Ranges):
    def scan(batches):
        for segment in ranges.segments(_anchored(batches, window)):
            yield ranges.batch_of(ranges.questions(ranges.joined(segment), dealt))

    return scan


def _second_scan(window: int, told: ranges.Answers):
    """Runs: consecutive windows with one anchor that may repeat, and a second hash of each of them."""
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary())])

    def found(batch, w, start, anchor):
        h = grams(w.hashes(1), window, 1)[start]
        first = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]))))
        size = np.diff(np.append(first, len(start)))
        inner = np.arange(len(start)) - np.repeat(first, size)
        run = np.add.reduceat(mix(h ^ (inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), first)
        owner = np.searchsorted(w.bounds, start[first], side="right") - 1
        tags = np.zeros(batch.num_rows, np.int64)
        data, at = text_buffer(batch.column(1))
        raw = data.tobytes()
        for i in np.unique(owner).tolist():
            tags[i] = _tag(_digest(raw[at[i] : at[i + 1]]))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[owner]
        hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(start)).astype(np.int32) * 8), pa.py_buffer(h)])
        return pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(run.view(np.int64)), pa.array(ids), pa.array((tags[owner] << 32) | (start[first] - w.bounds[owner])), pa.array(size, pa.int32()), hashes], schema=schema)

    def scan(batches):
        for segment in ranges.segments(_anchored(batches, window)):
            often = told.classes(ranges.joined(segment)) > 1
            used = 0
            for (batch, w, start, anchor, fresh), keys in segment:
                again = often[used : used + len(keys)][np.cumsum(fresh) - 1]
                used += len(keys)
                if again.any():
                    yield found(batch, w, start[again], anchor[again])

    return scan, "anchor long, run long, id long, at long, n int, hashes binary"


def _exploded(batches):
    """The distinct windows of each run, with their places in it."""
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("least", pa.int64()), ("h", pa.int64()), ("ks", pa.list_(pa.int32()))])
    for batch in batches:
        hashes = batch.column("hashes")
        size = np.array([len(x.as_buffer()) // 8 for x in hashes], np.int64)
        row = np.repeat(np.arange(len(size)), size)
        h = np.frombuffer(b"".join(hashes.to_pylist()), np.int64)
        order = np.lexsort((h, row))  # stable: places stay in order
        inner = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size))[order]
        row, h = row[order], h[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))[: len(row)])
        ks = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(inner, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[first])) for c in ("anchor", "run", "least")), pa.array(h[first]), ks], schema=schema)


def covered(n: int, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Which of n words are covered by runs of ``sizes`` consecutive windows that begin at ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + sizes - 1 + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``id`` and ``spans``, runs (at, n) of n consecutive repeated windows, for the rows that have some.

    A window of a document repeats if its words also begin somewhere in a document with a smaller id.
    1. A scan sketches the anchors of all windows (count-min, merged by range of the hash).
    2. A second scan lets the windows pass whose anchor was, by the sketch's overestimate, seen twice:
       none that repeats is lost. They travel as runs, which have one anchor.
    3. Equal runs are grouped exactly. All occurrences but those in the least id repeat as a whole.
       Where unlike runs have one anchor, the windows of each run's least occurrence are grouped
       exactly. Windows count as equal by 128 bits of hashes.
    Minima are taken before shuffles, and joins have a side with unique keys, so that Spark may split
    the other: a passage in a third of all documents burdens no single task.

    Null ids: such rows repeat nothing and are no source. Null or empty text: no words. Rows that
    share an id are no source for each other; ``at`` is the first word's number plus 2**32 times a
    tag of the text, so that different texts under one id don't mix. An empty table gives no rows.
    """
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = ranges.ranges_for(size // BYTES_EACH, DEPTH)
    told = ranges.answers(narrow.mapInArrow(_first_scan(window, dealt), ranges.DDL), ranges.counts_in(dealt))
    scan, schema = _second_scan(window, ranges.Answers(told, dealt))
    found = written(narrow.mapInArrow(scan, schema), "substring-runs")
    key = ["anchor", "run"]
    runs = written(found.groupBy(key).agg(F.min("id").alias("least")), "substring-distinct")
    unlike = runs.groupBy("anchor").agg(F.count("*").alias("unlike")).where("unlike > 1").select("anchor")
    asked = runs.join(unlike, "anchor")
    firsts = found.select(*key, F.col("id").alias("least"), "hashes").join(asked, [*key, "least"]).dropDuplicates(key)
    windows = written(firsts.mapInArrow(_exploded, "anchor long, run long, least long, h long, ks array<int>"), "substring-windows")
    earlier = windows.groupBy("anchor", "h").agg(F.min("least").alias("earlier"))
    parts = windows.join(earlier, ["anchor", "h"]).where("earlier < least").groupBy(key).agg(F.flatten(F.collect_list("ks")).alias("ks"))
    # Of the least occurrence the parts that repeat elsewhere (``ks``), of others the whole run.
    placed = found.select(*key, "id", "at", "n").join(runs.join(parts, key, "left"), key).where("id > least OR ks IS NOT NULL")
    spans = F.expr("IF(id > least, array(named_struct('at', at, 'n', n)), transform(ks, k -> named_struct('at', at + k, 'n', 1)))")
    return placed.select("id", spans.alias("spans")).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _kept(data: np.ndarray, at: np.ndarray, batch: pa.RecordBatch, window: int):
    """For each text of a batch: its words, and which of them go."""
    w = words(data, at)
    raw = data.tobytes()
    spans = batch.column("spans")
    for i, (low, high) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        gone = None
        if spans[i].is_valid:
            place, size = (spans[i].values.field(k).to_numpy() for k in (0, 1))
            own = place >> 32 == _tag(_digest(raw[at[i] : at[i + 1]]))
            gone = covered(high - low, place[own] & 0xFFFFFFFF, size[own], window) if own.any() else None
        yield w.start[low:high], w.end[low:high], gone, raw


def _digested(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def scan(batches):
        for batch in slices(batches):
            data, at = text_buffer(batch.column("text"))
            n, removed, digest = [], [], []
            for k, (start, end, gone, raw) in enumerate(_kept(data, at, batch, window)):
                n.append(len(start))
                removed.append(0 if gone is None else int(gone.sum()))
                if gone is None:
                    kept = b" ".join(raw[at[k] : at[k + 1]].split())
                else:
                    kept = b" ".join(raw[a:b] for a, b in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], schema=schema)

    return scan, "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _cut(window: int, text_col: str, keep_emptied: bool):
    def scan(batches):
        for batch in slices(batches, text_col):
            data, at = text_buffer(batch.column(text_col))
            out, stays = [], []
            for k, (start, end, gone, raw) in enumerate(_kept(data, at, batch, window)):
                stays.append(keep_emptied or gone is None or not gone.all())
                whole = raw[at[k] : at[k + 1]]
                if gone is not None and gone.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    parts, low = [], int(at[k])
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        parts.append(raw[low : int(start[a])])
                        low = int(end[b - 1])
                    whole = b"".join(parts) + raw[low : at[k + 1]]
                out.append(whole.decode())
            text = pa.array(out, pa.string())
            valid = batch.column(text_col).is_valid()
            text = pa.compute.if_else(valid, text, pa.scalar(None, pa.string()))
            names = [n for n in batch.schema.names if n not in ("_id", "spans")]
            yield pa.RecordBatch.from_arrays([text if n == text_col else batch.column(n) for n in names], names=names).filter(pa.array(stays, pa.bool_()))

    return scan


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, keep_emptied: bool = True) -> DataFrame:
    """``docs`` without the words that repeated windows cover; the other text, white space included, stays as it is.

    Columns, null texts and rows stay, but for rows left without a word if not ``keep_emptied``. Columns named ``_id`` or ``spans`` aren't allowed.
    """
    if clash := {"_id", "spans"} & set(docs.columns):
        raise ValueError(f"columns not allowed: {sorted(clash)}")
    found = repeated_words(docs, id_col, text_col, window).withColumnRenamed("id", "_id")
    joined = docs.join(found, docs[id_col].cast("long") == found["_id"], "left")
    return joined.mapInArrow(_cut(window, text_col, keep_emptied), docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_words(docs)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(found.withColumnRenamed("id", "key"), F.col("doc_id") == F.col("key"), "left")
    scan, schema = _digested(50)
    return joined.select(F.col("doc_id").alias("id"), "text", "spans").mapInArrow(scan, schema)


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE first < doc_id)),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(words, ' ')
         ELSE (SELECT string_agg(words[i], ' ' ORDER BY i) FROM unnest(range(1, len(words) + 1)) AS t(i) WHERE NOT list_contains(ps, i)) END, '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""
