"""Unigram segmentation over a SentencePiece vocabulary: streaming encoding, decoding, and counting alone.

The best segmentation has the greatest sum of piece scores. Rules of ties and of unknown characters
are the library's unigram model's: for one end, of equal sums the longest last piece wins; a character
without a piece of its own may be unknown at ten less than the least score, and becomes its UTF-8
bytes' pieces where the vocabulary has these. Sums are doubles, where the library adds floats: with
scores that are whole numbers the sums here are exact at any length, and equal the library's up to
2**24. Text is prefixed with one space, and spaces become U+2581; nothing else is normalised.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import slices, text_buffer
from .store import table

BAR = "▁"
UNKNOWN_BELOW = 10.0


def model_file(name: str) -> str:
    """A path as it is; else the name of an installed public vocabulary, found on the machine that asks."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces and scores of a model file, and which characters occur in pieces of one character only."""

    def __init__(self, name: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file(name))
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): (float(model.get_score(i)), i) for i in plain}
        self.unknown_id = model.unk_id()
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown_score = min(s for s, _ in self.score.values()) - UNKNOWN_BELOW
        self.longest = max(map(len, self.score))
        self.surface = [b""] * len(ids)
        for piece, (_, i) in self.score.items():
            self.surface[i] = piece.replace(BAR, " ").encode()
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        self.surface[self.unknown_id] = " ⁇ ".encode()
        joined = {c for p in self.score if len(p) > 1 for c in p}
        #: No piece runs on from another character into a space, so every path passes there.
        self.cut_at_spaces = not any(c != BAR and d == BAR for p in self.score for c, d in zip(p, p[1:], strict=False))
        self.newline_alone = "\n" not in joined

    def segments(self, text: str) -> list[str]:
        """Parts of the prefixed text that every segmentation respects; they join to it."""
        if not text:
            return []
        text = text.replace(BAR, " ")
        if not self.cut_at_spaces:
            return [BAR + text.replace(" ", BAR)]
        out, bars = [], ""
        for word in text.split(" "):
            bars += BAR
            if not word:
                continue
            if "\n" in word and self.newline_alone:
                first, *rest = word.split("\n")
                out.append(bars + first)
                for part in rest:
                    out.append("\n")
                    if part:
                        out.append(part)
            else:
                out.append(bars + word)
            bars = ""
        if bars:
            out.append(bars)
        return out

    def unknown_ids(self, character: str, before: bool) -> list[int]:
        """Ids of an unknown character; ``before``: so was the one before it, with which it is one piece."""
        if self.byte_ids:
            return [self.byte_ids[b] for b in character.encode()]
        return [] if before else [self.unknown_id]


class StreamingViterbi:
    """Best segmentation with a bounded window of states.

    A state is a boundary with the best sum and the boundary before it. Only boundaries that pieces can
    still start from or end at are live; as soon as all live ones descend from one boundary, the ids up
    to it are committed and what is older is forgotten. (In a long run of one character, paths of each
    phase may stay apart to its end; only then does the window grow with the run.)
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.root: dict = {}
        for piece, found in vocabulary.score.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.most_held = 0  # the largest window so far, for tests

    def encode(self, text: str) -> list[int]:
        root, unknown = self.root, self.vocabulary.unknown_score
        ids: list[int] = []
        base, size, reach = 0, len(text), 0
        sums: list[float] = [0.0]
        back: list[tuple[int, int]] = [(-1, -1)]
        self._after_unknown, check = False, 4 * self.vocabulary.longest
        for at in range(size):
            here = sums[at - base]
            node, end, single = root, at, False
            while end < size:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                found = node.get("")
                if found is not None:
                    if end > reach:
                        reach = end
                    while len(sums) <= end - base:
                        sums.append(-np.inf)
                        back.append((-1, -1))
                    if here + found[0] > sums[end - base]:
                        sums[end - base], back[end - base] = here + found[0], (at, found[1])
                    single = single or end == at + 1
            if not single:
                if at + 1 > reach:
                    reach = at + 1
                if len(sums) <= at + 1 - base:
                    sums.append(-np.inf)
                    back.append((-1, -1))
                if here + unknown > sums[at + 1 - base]:
                    sums[at + 1 - base], back[at + 1 - base] = here + unknown, (at, -1)
            common = at + 1 if reach == at + 1 else self._common(back, base, at + 1, reach) if len(sums) > check else base
            if len(sums) > self.most_held:
                self.most_held = len(sums)
            if common > base:
                ids += self._path(text, back, base, common)
                sums, back = sums[common - base :], back[common - base :]
                base, check = common, 4 * self.vocabulary.longest
            elif len(sums) > check:
                check = len(sums) + self.vocabulary.longest
        return ids

    @staticmethod
    def _common(back, base: int, low: int, high: int) -> int:
        """The last boundary that all live ones, from ``low`` to ``high``, descend from."""
        live = {k for k in range(low, high + 1) if back[k - base][0] >= 0}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(max(base, back[last - base][0]))
        return live.pop()

    def _path(self, text, back, base: int, end: int) -> list[int]:
        steps = []
        while end > base:
            start, piece = back[end - base]
            steps.append((start, piece))
            end = start
        out: list[int] = []
        for start, piece in reversed(steps):
            if piece >= 0:
                out.append(piece)
            else:
                out += self.vocabulary.unknown_ids(text[start], self._after_unknown)
            self._after_unknown = piece < 0
        return out


class CountingViterbi:
    """The number of pieces of the best segmentation: an Aho-Corasick automaton lists matches, no path is kept."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in vocabulary.score.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.alone = {p for p in vocabulary.score if len(p) == 1}

    def count(self, text: str) -> int:
        """States are kept for the last ``longest`` boundaries: best sum, pieces so far, and whether the last is unknown."""
        ring = self.vocabulary.longest + 1
        sums, pieces, lost = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end, character in enumerate(text):
            best, best_n, best_lost = -np.inf, 0, False
            while match is not None and match[0] == end:  # longest first: of equal sums the first stays
                length, score = match[1]
                start = (end + 1 - length) % ring
                if sums[start] + score > best:
                    best, best_n, best_lost = sums[start] + score, pieces[start] + 1, False
                match = next(matches, None)
            if character not in self.alone:
                start = end % ring
                if sums[start] + self.vocabulary.unknown_score > best:
                    best, best_lost = sums[start] + self.vocabulary.unknown_score, True
                    best_n = pieces[start] + (len(character.encode()) if self.vocabulary.byte_ids else not lost[start])
            at = (end + 1) % ring
            sums[at], pieces[at], lost[at] = best, best_n, best_lost
        return pieces[len(text) % ring]


class Remembered(dict):
    """Results by segment, computed when asked for; the older half of what is held goes when ``most`` is reached."""

    def __init__(self, compute, most: int = 400_000):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, segment: str):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(segment)
        if found is None:
            found = self.compute(segment)
        self[segment] = found
        return found


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    """The text of ids: pieces' characters and bytes, without the space put before it."""
    out = b"".join(map(vocabulary.surface.__getitem__, ids))
    return out[1:] if out.startswith(b" ") else out


_HELD: dict = {}


def _tools(kind: str, name: str):
    if (kind, name) not in _HELD:
        vocabulary = _HELD.setdefault(("vocabulary", name), Vocabulary(name))
        if kind == "encode":
            viterbi = StreamingViterbi(vocabulary)
            _HELD[kind, name] = vocabulary, Remembered(lambda s: np.array(viterbi.encode(s), "<u4").tobytes())
        else:
            _HELD[kind, name] = vocabulary, Remembered(CountingViterbi(vocabulary).count)
    return _HELD[kind, name]


def _encoded(model: str, id_col: str, text_col: str):
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.binary())])

    def scan(batches):
        vocabulary, known = _tools("encode", model)
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).fill_null("").to_pylist()
            ids = [b"".join(map(known.__getitem__, vocabulary.segments(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ids, pa.binary())], schema=schema)

    return scan


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``id_col`` (long) and ``ids``: little-endian 32-bit numbers in one binary. Null and empty texts have none."""
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return narrow.mapInArrow(_encoded(model, id_col, text_col), f"`{id_col}` long, ids binary")


def decode_ids(rows: DataFrame, id_col: str = "doc_id", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``id_col`` and ``text`` of rows with binary ``ids``; null ids give the empty text. Undecodable bytes become U+FFFD."""
    schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def scan(batches):
        vocabulary, _ = _tools("encode", model)
        for batch in batches:
            texts = [decode(vocabulary, np.frombuffer(x or b"", "<u4").tolist()).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias(id_col), "ids").mapInArrow(scan, f"`{id_col}` long, text string")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``id_col`` (long) and ``n_tokens``, as many as ``encode_texts`` gives ids. Null and empty texts have none."""
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64())])

    def scan(batches):
        vocabulary, known = _tools("count", model)
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).fill_null("").to_pylist()
            counts = [sum(map(known.__getitem__, vocabulary.segments(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(counts, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(scan, f"`{id_col}` long, n_tokens long")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, counted and digested, and whether decoding them gives the text back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])
    encoder = _encoded("piece_bpe_32k.model", "doc_id", "text")

    def scan(batches):
        vocabulary, _ = _tools("encode", "piece_bpe_32k.model")
        for batch in slices(batches):
            data, at = text_buffer(batch.column(1))
            raw = data.tobytes()
            found = next(encoder(iter([batch]))).column(1).to_pylist() if batch.num_rows else []
            back = [decode(vocabulary, np.frombuffer(x, "<u4").tolist()) for x in found]
            same = [x == raw[a:b] for x, a, b in zip(back, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array(same, pa.bool_())], schema=schema)

    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
