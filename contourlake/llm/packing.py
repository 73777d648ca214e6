"""Packing token sequences by best-fit decreasing, with a segment tree over remaining capacity."""

from __future__ import annotations

import json
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import slices, text_buffer
from .store import table, written

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: A special token that parts words encoded together, and how many go together.
BETWEEN, TOGETHER = "<|endoftext|>", 64
#: What a vocabulary's file says where ``PLAIN`` words are left as they are, but for a cut before their marks.
LEAVES_PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Small Latin letters, then ASCII marks. What ends such a part has the suffix ``LAST`` in the vocabulary.
PLAIN, LAST = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]*)([!-/:-@\[-`{-~]*)"), "</w>"


def tokenizer_file(name: str) -> str:
    """A path as it is; else the name of an installed public vocabulary, found on the machine that asks."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Word to a row of ``ids``; words are encoded once, many at a time, and forgotten when too many are held.

    The tokenizers used here drop ASCII white space and never join text across it, so a text's ids
    are those of its words. ASCII capitals are lowered beforehand (the normaliser does so anyway),
    but not in texts that could hold a special token's name.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.mark = np.array([self.between or 0], np.uint32)
        self.plain = self._plain(path)
        if self.plain is not None:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[k for x, k in vocabulary.items() if x.endswith(LAST)]] = True
        self.reset()

    @staticmethod
    def _plain(path: str):
        """The tokenizer without what does nothing to plain words; None where the file's own steps are others."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        if any(said.get(k) != v for k, v in LEAVES_PLAIN.items()) or said["model"].get("end_of_word_suffix") != LAST:
            return None
        plain = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def reset(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.start, self.size, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.known = self.used = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.pending.append(word)
        return at

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the words' ids, and all ids in a row. Words are encoded many to a text, a special token between them."""
        texts = [BETWEEN.join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)] if self.between is not None else words
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.between is None:
            return np.array([len(x) for x in found], np.int64), np.concatenate(found)
        flat = np.concatenate([x for ids in found for x in (ids, self.mark)])
        cut = flat == self.between
        return np.diff(np.flatnonzero(cut), prepend=-1) - 1, flat[~cut]

    def _plain_rows(self, texts: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Like ``_rows``, of words with their parts a space apart and how many parts each has; None where ends don't tell them."""
        found = self.plain.encode_batch_fast([" ".join(texts[k : k + TOGETHER]) for k in range(0, len(texts), TOGETHER)], add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(self.last[flat])
        if len(ends) != int(parts.sum()) or ends[-1] != len(flat) - 1:
            return None
        return np.diff(ends[np.cumsum(parts) - 1], prepend=-1), flat

    def _encode(self) -> None:
        kinds: tuple[list, list, list] = ([], [], [])  # plain words, others, and what could hold a special token's name
        texts: tuple[list, list] = ([], [])
        parts = []
        for k, raw in enumerate(self.pending):
            if b"<|" in raw:
                kinds[2].append(k)
                continue
            w = raw.decode()
            letters, marks = match.groups() if self.plain is not None and (match := PLAIN.fullmatch(w)) else ("", "")
            kind = not (letters or marks)
            kinds[kind].append(k)
            texts[kind].append(f"{letters} {marks}" if letters and marks else w)
            if not kind:
                parts.append(2 if letters and marks else 1)
        found = []
        if texts[0]:
            found.append((kinds[0], self._plain_rows(texts[0], np.array(parts)) or self._rows([self.pending[k].decode() for k in kinds[0]])))
        if texts[1]:
            found.append((kinds[1], self._rows(texts[1])))
        for k in kinds[2]:
            special = np.array(self.tokenizer.encode(self.pending[k].decode(), add_special_tokens=False).ids, np.uint32)
            found.append(([k], (np.array([len(special)]), special)))
        # Words keep their order in ``size`` and ``starts``, their ids come in that of the kinds.
        size, starts, used = np.zeros(len(self.pending), np.int64), np.zeros(len(self.pending), np.int64), 0
        for at, (n, flat) in found:
            size[at], starts[at] = n, used + np.cumsum(n) - n
            used += len(flat)
        ids = np.concatenate([flat for _, (_, flat) in found])
        n, m = self.known + len(size), self.used + len(ids)
        while n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[self.known : n] = size
        self.start[self.known : n] = self.used + starts
        self.ids[self.used : m] = ids
        self.known, self.used, self.pending = n, m, []

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > self.most:
            self.reset()
        rows = []
        for text in texts:
            found = (text if b"<|" in text else text.lower()).split()
            rows.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.pending:
            self._encode()
        out = []
        for row in rows:
            size = self.size[row]
            ends = np.cumsum(size)
            out.append(self.ids[np.repeat(self.start[row] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
        return out


#: Words that a worker keeps: some 200 bytes each.
MOST_HELD = 1_000_000
_HELD: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    if name not in _HELD:
        _HELD[name] = WordIds(tokenizer_file(name), MOST_HELD)
    return _HELD[name]


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def scan(batches):
        vocabulary = word_ids(tokenizer)
        for batch in slices(batches):
            data, at = text_buffer(batch.column(1))
            raw = data.tobytes()
            found = vocabulary.encode([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for low in range(0, len(ids), capacity):
                    part = ids[low : low + capacity]
                    for column, value in zip(out, (doc, low, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=PIECES)

    return scan


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c tells whether one with c left is open."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.at: dict[int, list[int]] = {}

    def _mark(self, leaf: int, value: int) -> None:
        node = self.width + leaf
        self.any[node] = value
        node >>= 1
        while node:
            value = self.any[2 * node] | self.any[2 * node + 1]
            if self.any[node] == value:
                return
            self.any[node] = value
            node >>= 1

    def put(self, left: int, window: int) -> None:
        held = self.at.setdefault(left, [])
        held.append(window)
        if len(held) == 1:
            self._mark(left, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Remaining capacity and number of the open window that ``need`` fills best; it is taken out."""
        node = self.width + need
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node + (not self.any[2 * node])
        left = node - self.width
        window = self.at[left].pop()
        if not self.at[left]:
            self._mark(left, 0)
        return left, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) for lengths that come in falling order, each from 1 to ``capacity``."""
    windows, opened, out = OpenWindows(capacity), 0, []
    for n in lengths:
        left, window = windows.tightest(n) or (capacity, opened)
        opened += window == opened
        out.append((window, capacity - left))
        if left > n:
            windows.put(left - n, window)
    return out


def _place(capacity: int):
    def placed(group: pa.Table) -> pa.Table:
        number = group.column("_group")[0].as_py()
        rows = group.drop_columns(["_group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        found = best_fit_decreasing(rows.column("length").to_pylist(), capacity)
        window, offset = np.array(found, np.int64).T
        return pa.Table.from_arrays([*rows.columns, pa.array((number << 32) + window), pa.array(offset)], schema=PLACED)

    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 2, per_group: int = 40_000) -> DataFrame:
    """Pieces of the tokenised documents and where they lie: one row for each piece.

    A document's ids (null text: none) and ``end_id`` are cut into full windows and a rest. Pieces, of
    which only lengths and checksums travel, are dealt by a hash of their row's number into groups of about
    ``per_group``, equal rows too; in each, best-fit decreasing fills windows of ``capacity``. A group leaves a window
    or so partly empty, the others are full to a few tokens. Texts may be of any length: what one task
    holds is bounded by ``per_group`` pieces. Rows that share an id, and null ids, are packed like
    others. An empty table gives no rows. ``sequence_id`` is the group's number and the window's in it.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = written(narrow.mapInArrow(_pieces(tokenizer, capacity, end_id), DDL), "pieces")
    groups = max(1, math.ceil(pieces.count() / per_group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(_place(capacity), f"{DDL}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
