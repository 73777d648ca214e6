"""Quality rules: counted features, and n-gram perplexity under a modified Kneser-Ney model by language.

Units are words with A-Z lowered; words of over 32 bytes, as scripts without spaces have, are cut
between characters into pieces of some six bytes. The model gives a unit's chance after the one before
it. As Kneser and Ney count lower orders, a pair counts as often as different units stand before it,
and a unit as often as different units do: a text copied a thousand times counts like one.

The model grows with the corpus and lies in ranges of the hash, as arrays sorted by a 64-bit key (32
bits of the context, then 32 of the unit) with their counts. Segments of the scan send each range their
distinct pairs, with 16 bits of what stands before; the range merges them, keeps its part of the model
and answers the segments with counts, from which they score their texts. Nothing of the model is
collected or broadcast but four counts of counts for each language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .kernels import GAP, LOWER, Words, grams, mix, slices, text_buffer, words
from .store import table, written

MARK = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Bytes of words that begin a character.
WORD_CHAR = ~GAP & ((np.arange(256) & 0xC0) != 0x80)
#: Shorter texts have fewer than 50 words.
LEAST_CHARS = 99
#: Longer words are cut, into pieces of so many bytes.
LONG, PIECE = 32, 6
#: The contexts are counted in so many passes, which divides what is shuffled at once.
PASSES = 4
#: Units of one segment.
UNITS_EACH = 3 << 18
BEFORE = 16
#: Lesser counts are answered exactly.
EXACT = 1024
LOW_WORD = np.uint64(0xFFFFFFFF)


def units(data: np.ndarray, at: np.ndarray) -> Words:
    """The units of texts in a row."""
    w = words(LOWER[data], at)
    size = w.end - w.start
    long = size > LONG
    if not long.any():
        return w
    n = size[long]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(w.start[long], n) + inner
    starts = (data[place] & 0xC0) != 0x80  # where characters begin
    place, part = place[starts], inner[starts] // PIECE
    first = np.ones(len(place), bool)
    first[1:] = (part[1:] != part[:-1]) | (place[1:] - place[:-1] > 4)
    start = np.sort(np.concatenate((w.start[~long], place[first])))
    # A piece ends where the next begins, or with its word.
    end = np.minimum(np.append(start[1:], len(data)), w.end[np.searchsorted(w.start, start, side="right") - 1])
    return Words(w.data, start, end, np.searchsorted(start, at))


def salt_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


@dataclass
class Tongues:
    """Languages with a model of their own, by number; all others have number 0."""

    names: list[str]

    def __post_init__(self):
        self.number = {x: k + 1 for k, x in enumerate(self.names)}
        self.salts = np.array([salt_of(""), *(salt_of("=" + x) for x in self.names)], np.uint64)

    def of(self, langs: list[str]) -> np.ndarray:
        return np.array([self.number.get(x, 0) for x in langs], np.int64)


@dataclass
class Sequence:
    """Units of texts in a row: their hashes, of the one before each and of the one before that, and each unit's language."""

    bounds: np.ndarray
    unit: np.ndarray
    before: np.ndarray
    earlier: np.ndarray
    tongue: np.ndarray


def sequence(data: np.ndarray, at: np.ndarray, tongue: np.ndarray, salts: np.ndarray) -> Sequence:
    """A text is preceded by its language's mark, twice."""
    w = units(data, at)
    n = w.counts()
    each = np.repeat(tongue.astype(np.int32), n)
    unit = mix(w.hashes() ^ salts[each])
    first = w.bounds[:-1][n > 0]
    before = np.roll(unit, 1)
    before[first] = salts[each[first]]
    earlier = np.roll(before, 1)
    earlier[first] = salts[each[first]]
    return Sequence(w.bounds, unit, before, earlier, each)


def pair_keys(before: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return (before & ~LOW_WORD) | (unit >> np.uint64(32))


def _parts(batches, tongues: Tongues):
    """Parts of text with their sequences; and the keys: their units."""
    for batch in slices(batches):
        data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
        found = sequence(data, at, tongues.of(batch.column(batch.schema.get_field_index("lang")).to_pylist()), tongues.salts)
        yield (batch, found), found.unit


@dataclass
class Segment:
    """Parts with where their texts' units begin, the name, and all units in a row."""

    parts: list[tuple[pa.RecordBatch, np.ndarray]]
    name: str
    whole: Sequence

    def tongues(self):
        """For each language its number, its units' places, their hashes, keys of pairs and what stands before; one language is held at a time."""
        for t in np.flatnonzero(np.bincount(self.whole.tongue)).tolist():
            place = np.flatnonzero(self.whole.tongue == t)
            unit = self.whole.unit[place]
            yield t, place, unit, pair_keys(self.whole.before[place], unit), self.whole.earlier[place]


def _segments(batches, tongues: Tongues):
    for held in ranges.segments(_parts(batches, tongues), UNITS_EACH):
        columns = []
        for c in ("unit", "before", "earlier", "tongue"):
            columns.append(np.concatenate([getattr(x, c) for (_, x), _ in held]))
            if c != "unit":
                for (_, x), _ in held:
                    setattr(x, c, None)
        parts, whole = [(batch, x.bounds) for (batch, x), _ in held], Sequence(np.zeros(0, np.int64), *columns)
        held.clear()  # its own units go too
        yield Segment(parts, ranges.name_of(whole.unit), whole)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting takes less time than the hash table of ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns in a row, each with its length, after the length of all."""
    body = b"".join(np.uint32(len(c)).tobytes() + ranges.planes(c) for c in columns)
    return np.uint64(len(body)).tobytes() + pa.compress(body, "zstd", asbytes=True)


def _unpacked(body: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 0, []
    body = pa.decompress(memoryview(body)[8:], int(np.frombuffer(body, np.uint64, 1)[0]), "zstd", asbytes=True)
    for kind in kinds:
        n = int(np.frombuffer(body, np.uint32, 1, at)[0])
        size = n * np.dtype(kind).itemsize
        out.append(ranges.from_planes(body[at + 4 : at + 4 + size], kind, n))
        at += 4 + size
    return out


def _cuts(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(piece, low, high) of sorted keys, by their bits above ``shift``."""
    piece = (keys >> np.uint64(shift)).astype(np.int64)
    edge = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(keys)]
    return [(int(piece[low]), low, high) for low, high in zip(edge[:-1], edge[1:], strict=True) if high > low]


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _ask_pairs(tongues: Tongues, log_pieces: int, turn: int):
    """A segment's distinct pairs, with what stands before each, to the pieces whose turn it is."""

    def scan(batches):
        for segment in _segments(batches, tongues):
            rows, seg = [], segment.name
            for t, _, _, key, earlier in segment.tongues():
                mine = (key >> np.uint64(64 - log_pieces)) % np.uint64(PASSES) == turn
                keys, back = np.unique(key[mine], return_inverse=True)
                earlier = earlier[mine]
                triple = _distinct((back.astype(np.uint64) << np.uint64(BEFORE)) | (earlier & np.uint64((1 << BEFORE) - 1)))
                owner, mark = (triple >> np.uint64(BEFORE)).astype(np.int64), triple.astype(np.uint16)
                n = np.bincount(owner, minlength=len(keys))
                first = np.append(0, np.cumsum(n))
                for piece, low, high in _cuts(keys, 64 - log_pieces):
                    rows.append((seg, t, piece, _packed(_gaps(keys[low:high]), np.minimum(n[low:high] - 1, 65535).astype(np.uint16), mark[first[low] : first[high]])))
            yield ranges.batch_of(rows)

    return scan


def code(x: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: those below ``EXACT`` as they are, so that most high bytes are 0; of others the logarithms to a two-thousandth."""
    out = x.astype(np.uint16)
    large = x >= EXACT
    out[large] = EXACT + np.rint(2048 * np.log(x[large])) - np.rint(2048 * np.log(EXACT))
    return out


def decoded(x: np.ndarray) -> np.ndarray:
    out = x.astype(float)
    large = x > EXACT
    out[large] = np.rint(np.exp((out[large] - EXACT + np.rint(2048 * np.log(EXACT))) / 2048))
    return out


def _by_context(keys: np.ndarray) -> np.ndarray:
    """Where each context's pairs begin in sorted keys."""
    context = keys >> np.uint64(32)
    return np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(keys)])


def modelled(bodies):
    """One piece of the model: answers to the segments, and, for none of them, what the units need of it.

    Of k different marks of 16 bits, as many units stood before as make k likeliest (linear counting).
    """
    found = [_unpacked(body, np.uint64, np.uint16, np.uint16) for _, body in bodies]
    own = [np.cumsum(gaps) for gaps, _, _ in found]
    keys, back = np.unique(np.concatenate(own), return_inverse=True)
    each = np.concatenate([n.astype(np.int64) + 1 for _, n, _ in found])
    triple = _distinct((np.repeat(back, each).astype(np.uint64) << np.uint64(BEFORE)) | np.concatenate([m for _, _, m in found]))
    k = np.bincount((triple >> np.uint64(BEFORE)).astype(np.int64), minlength=len(keys))
    count = np.maximum(1, np.rint(-65536 * np.log1p(-np.minimum(k, 65535) / 65536))).astype(np.int64)
    first = _by_context(keys)
    stats = np.stack([np.add.reduceat(x, first) for x in (count, count == 1, count == 2, count >= 3)]).astype(np.int64)
    context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    codes, stats = code(count), code(stats)
    used = 0
    for (seg, _), mine in zip(bodies, own, strict=True):
        at = back[used : used + len(mine)]
        used += len(mine)
        yield seg, _packed(codes[at], *stats[:, context[at[_by_context(mine)]]])
    unit, contexts = np.unique(keys & LOW_WORD, return_counts=True)
    yield None, _packed(_gaps(unit).astype(np.uint32), contexts.astype(np.uint32), np.array(_counts_of_counts(count), np.int64))


def _model_part(body: bytes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of a piece of the model the units, how many contexts each has, and the counts of counts."""
    gaps, contexts, stats = _unpacked(body, np.uint32, np.uint32, np.int64)
    return np.cumsum(gaps, dtype=np.uint64), contexts, stats.tolist()


def _counts_of_counts(n: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3 and 4, how many there are, and their sum."""
    return [*np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist(), len(n), int(n.sum())]


STATS = ("n1", "n2", "n3", "n4", "kinds", "total")
STATS_DDL = "row int, " + ", ".join(f"{c} long" for c in STATS)


def _pair_stats(batches):
    schema = pa.schema([("row", pa.int32()), *((c, pa.int64()) for c in STATS)])
    for batch in batches:
        yield ranges.batch_of([(t, *_model_part(b)[2]) for t, b in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True)], schema)


def _unit_rows(seg, t: int, unit: np.ndarray, counts, log_pieces: int) -> list[tuple]:
    mask = np.uint64((1 << (32 - log_pieces)) - 1)
    return [(seg, t, piece, ranges.packed((unit[low:high] & mask).astype(np.int64), None if counts is None else counts[low:high])) for piece, low, high in _cuts(unit, 32 - log_pieces)]


def _count_units(log_pieces: int):
    """How many contexts of a piece of the model each unit has."""

    def scan(batches):
        for batch in batches:
            for t, body in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True):
                yield ranges.batch_of(_unit_rows(None, t, *_model_part(body)[:2], log_pieces))

    return scan


def _ask_units(tongues: Tongues, log_pieces: int):
    def scan(batches):
        for segment in _segments(batches, tongues):
            yield ranges.batch_of([row for t, _, unit, _, _ in segment.tongues() for row in _unit_rows(segment.name, t, _distinct(unit >> np.uint64(32)), None, log_pieces)])

    return scan


def _unit_totals(bodies):
    """Totals of one piece's units: answers to the segments, and, for none of them, counts of counts."""
    parts = [(seg, *ranges.unpacked(body)) for seg, body in bodies]
    counted = [(at, n) for _, at, n in parts if n is not None]
    unit, back = np.unique(np.concatenate([at for at, _ in counted] or [np.zeros(0, np.int64)]), return_inverse=True)
    total = np.bincount(back, np.concatenate([n for _, n in counted] or [np.zeros(0)]), len(unit)).astype(np.int64)
    for seg, at, n in parts:
        if n is None:
            place = np.minimum(np.searchsorted(unit, at), max(0, len(unit) - 1))
            yield seg, _packed(code(np.where(unit[place] == at, total[place], 0) if len(unit) else np.zeros(len(at))))
    yield None, np.array(_counts_of_counts(total), np.int64).tobytes()


def _unit_stats(batches):
    schema = pa.schema([("row", pa.int32()), *((c, pa.int64()) for c in STATS)])
    for batch in batches:
        yield ranges.batch_of([(t, *np.frombuffer(b, np.int64).tolist()) for t, b in zip(batch.column("row").to_pylist(), batch.column("body").to_pylist(), strict=True)], schema)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4.

    Where those don't determine one (none of a kind seen), the discount is a half.
    """
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y, n = n1 / (n1 + 2 * n2), (0, n1, n2, n3, n4)
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
    return np.array([0, *(min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d, strict=True))])


def _taken(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3).astype(np.int64)]


def chances(count: np.ndarray, context: np.ndarray, stats: np.ndarray, unit_count: np.ndarray, pair: tuple, unit: tuple, held_out: bool = False) -> np.ndarray:
    """Interpolated chances of pairs seen: of their counts, their contexts' totals and numbers of counts 1, 2, 3 or more, and their units' counts.

    ``pair`` and ``unit``: ``STATS`` of the language. Units back off to equal chances for all kinds.
    ``held_out``: as if each pair had been counted once less, so that what one text alone has is unseen.
    """
    d, e = discounts(*pair[:4]), discounts(*unit[:4])
    kinds, total = max(1, unit[4]), max(1, unit[5])
    left = e[1] * unit[0] + e[2] * unit[1] + e[3] * (unit[4] - unit[0] - unit[1])
    sums, ones, twos, more = stats[:, context]
    if held_out:
        ones, twos, more = ones - (count == 1) + (count == 2), twos - (count == 2) + (count == 3), more - (count == 3)
        unit_count = np.maximum(unit_count - (count == 1), 0)
        count, sums = np.maximum(count - 1, 0), np.maximum(sums - 1, 0)
    alone = (unit_count - _taken(unit_count, e) + left / kinds) / total
    rest = d[1] * np.maximum(ones, 0) + d[2] * np.maximum(twos, 0) + d[3] * np.maximum(more, 0)
    return np.where(sums > 0, (count - _taken(count, d) + rest * alone) / np.maximum(sums, 1), alone)


def _answered(told: list[str], counted: str, seg: str) -> dict[int, tuple]:
    """For each language the answers on pairs (counts, and four numbers for each context) and on units."""
    found: dict[int, tuple[list, list]] = {}
    for (t, piece), body in sorted((key, body) for root in told for key, body in ranges.answer_rows(root, seg).items()):
        found.setdefault(t, ([], []))[0].append(_unpacked(body, *[np.uint16] * 5))
    for (t, _), body in ranges.answer_rows(counted, seg).items():
        found.setdefault(t, ([], []))[1].append(decoded(_unpacked(body, np.uint16)[0]))
    return {t: (*(decoded(np.concatenate(x)) for x in zip(*pairs, strict=True)), np.concatenate(alone)) for t, (pairs, alone) in found.items() if pairs and alone}


def base_features(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, at = text_buffer(batch.column(batch.schema.get_field_index("text")))
    w = words(data, at)
    n = w.counts()

    def by_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[at])

    repeated = np.zeros(len(n), np.int64)
    g = grams(w.hashes(), 3)
    duplicate = np.zeros(len(n), np.int64)
    raw = data.tobytes()
    for i, (low, high) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if high - low >= 4:
            own = np.sort(g[low : high - 2])
            twice = own[1:][own[1:] == own[:-1]]
            if len(twice):
                again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, g[low : high - 2]), len(twice) - 1)] == g[low : high - 2])
                covered = np.zeros(high - low, bool)
                for k in range(3):
                    covered[again + k] = True
                repeated[i] = covered.sum()
        lines = [x for x in raw[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        duplicate[i] = len(lines) - len(set(lines))
    return {"n_words": n, "word_chars": by_text(WORD_CHAR[data]), "n_symbols": by_text(MARK[data]), "n_dup_lines": duplicate, "n_repeat_words": repeated}


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: Log perplexity held out, and with the text's own counts.
MEASURES = ("log_perplexity", "own_log_perplexity")


def _score(tongues: Tongues, told: list[str], counted: str, pair_stats: dict, unit_stats: dict):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), *((f, pa.int64()) for f in FEATURES), *((c, pa.float64()) for c in MEASURES), ("answered", pa.bool_())])

    def costs(segment: Segment) -> np.ndarray:
        """What every unit of a segment costs, held out and with its own counts; infinite where the segment has no answer."""
        out, known = np.full((2, len(segment.whole.unit)), np.inf), _answered(told, counted, segment.name)
        for t, place, unit, key, _ in segment.tongues():
            keys, back = np.unique(key, return_inverse=True)
            count, *stats, alone = known.get(t, [()] * 6)
            kinds, first = _distinct(unit >> np.uint64(32)), _by_context(keys)
            if (len(count), len(stats[0]), len(alone)) == (len(keys), len(first), len(kinds)):
                context = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
                alone = alone[np.searchsorted(kinds, keys & LOW_WORD)]
                for row, held_out in zip(out, (True, False), strict=True):
                    row[place] = -np.log(np.maximum(chances(count, context, np.stack(stats), alone, pair_stats[t], unit_stats[t], held_out), 1e-30))[back]
        return out

    def scan(batches):
        for segment in _segments(batches, tongues):
            cost, used = costs(segment), 0
            segment.whole = None
            for batch, bounds in segment.parts:
                n = np.diff(bounds)
                sums = np.append(np.zeros((2, 1)), np.cumsum(cost[:, used : used + int(bounds[-1])], axis=1), axis=1)
                used += int(bounds[-1])
                ok = np.isfinite(sums[0, bounds[1:]]) | (n == 0)
                with np.errstate(invalid="ignore"):
                    mean = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]) / np.maximum(n, 1)
                features = base_features(batch)
                values = [pa.array(x, pa.float64(), mask=~ok | (n == 0)) for x in mean]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), batch.column("lang"), *(pa.array(features[f], pa.int64()) for f in FEATURES), *values, pa.array(ok)], schema=schema)

    return scan, "id long, text_hash long, lang string, " + ", ".join(f"{f} long" for f in FEATURES) + "".join(f", {c} double" for c in MEASURES) + ", answered boolean"


def _stats(rows: DataFrame) -> dict[int, tuple]:
    return {r["row"]: tuple(r[c] for c in STATS) for r in rows.groupBy("row").agg(*(F.sum(c).alias(c) for c in STATS)).collect()}


def _scores(narrow: DataFrame, tongues: Tongues, log_pieces: int) -> DataFrame:
    spark, unit_pieces = narrow.sparkSession, max(4, log_pieces - 4)
    told = [ranges.answers(narrow.mapInArrow(_ask_pairs(tongues, log_pieces, turn), ranges.DDL), modelled) for turn in range(PASSES)]
    model = ranges.unasked(spark, *told)
    asked = model.mapInArrow(_count_units(unit_pieces), ranges.DDL).unionByName(narrow.mapInArrow(_ask_units(tongues, unit_pieces), ranges.DDL))
    counted = ranges.answers(asked, _unit_totals)
    pairs, alone = _stats(model.mapInArrow(_pair_stats, STATS_DDL)), _stats(ranges.unasked(spark, counted).mapInArrow(_unit_stats, STATS_DDL))
    scan, schema = _score(tongues, told, counted, pairs, alone)
    return written(narrow.mapInArrow(scan, schema), "scores")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 4.0, above: float = 4.0, least_docs: int = 20) -> DataFrame:
    """``id``, ``text_hash``, the counted features, ``log_perplexity`` and ``own_log_perplexity`` (natural
    logarithms, for each unit), ``base_failed``, ``kept`` and both bands of every row.

    ``base_failed``: fewer than 50 words, or more than half of the words in three-word windows that
    occur twice. Of the others, those are rejected that lie outside the language's band in either
    measure. One is held out: a pair that only one text has counts as unseen, so strings that no other
    text has lie above its band. The other takes counts as they are: padding with a few strings lies
    below its band, lists without sentences above. A band reaches ``below`` times the distance of the
    quartiles below the lower and ``above`` times it above the upper one, over all texts of the
    language that pass the base rules. Languages with fewer than ``least_docs`` of them have one band
    together, and those with fewer than ``least_docs`` texts that could have 50 words one model, since
    a model of few texts fits any of them.

    Null texts are empty (no words: base_failed, both measures null); a null language is the empty
    string; null and repeated ids are judged like others; a text of any length is one row of one
    segment. Languages are listed on the driver. An empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.count(F.when(F.length("text") >= LEAST_CHARS, 1)).alias("long")
    found = narrow.groupBy("lang").agg(long, F.sum(F.octet_length("text")).alias("size")).collect()
    tongues = Tongues(sorted(r["lang"] for r in found if r["long"] >= least_docs))
    log_pieces = max(5, (sum(r["size"] for r in found) // 6).bit_length() - ranges.LOG_KEYS)
    scored = _scores(narrow, tongues, log_pieces)
    if scored.where("NOT answered").limit(1).count():  # the table was read in other splits: once more, from a copy
        scored = _scores(written(narrow, "quality-texts"), tongues, log_pieces)
    scored = scored.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    kept = F.expr("NOT base_failed")
    scored = scored.drop("answered")
    for measure in MEASURES:
        low, high = f"{measure}_low", f"{measure}_high"
        bins = scored.where("NOT base_failed").groupBy("lang", F.floor(F.col(measure) * BINS).alias("bin")).agg(F.count("*").alias("n"))
        bands = spark.createDataFrame(_bands(bins.collect(), below, above, least_docs), f"lang string, {low} double, {high} double")
        scored = scored.join(F.broadcast(bands), "lang", "left")
        kept &= F.col(measure).between(F.col(low), F.col(high))
    return scored.withColumn("kept", F.coalesce(kept, F.lit(False)))


#: Bins of the histogram in one nat.
BINS = 2000


def _bands(rows: list, below: float, above: float, least_docs: int) -> list[tuple[str, float, float]]:
    """From histograms of the log perplexity: some ten thousand bins for each language."""
    by_lang: dict[str, Counter] = {}
    for r in rows:
        by_lang.setdefault(r["lang"], Counter())[r["bin"]] = r["n"]
    few = [lang for lang, bins in by_lang.items() if bins.total() < least_docs]
    pooled = sum((by_lang[lang] for lang in few), Counter())
    out = []
    for langs, bins in [(few, pooled), *(([lang], bins) for lang, bins in by_lang.items() if lang not in few)]:
        if langs:
            at = np.array(sorted(bins))
            total = np.cumsum([bins[b] for b in at.tolist()])
            low, high = (at[np.searchsorted(total, q * total[-1])] / BINS for q in (0.25, 0.75))
            width = max(high - low, 0.01)
            out += [(lang, float(low - below * width), float(high + above * width)) for lang in langs]
    return out


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, unchanged. A column named ``_hash`` isn't allowed."""
    if "_hash" in docs.columns:
        raise ValueError("column not allowed: _hash")
    good = judged(docs, id_col, text_col, lang_col, **options).where("kept").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash2")).distinct()
    named = docs.withColumn("_hash", F.xxhash64(text_col))
    return named.join(good, named[id_col].cast("long").eqNullSafe(good["_id"]) & (named["_hash"] == good["_hash2"]), "left_semi").drop("_hash")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(F.col("id").alias("doc_id"), *FEATURES, "base_failed", "kept", *(F.round(c, 6).alias(c) for c in MEASURES))
