import random
import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from contourlake.llm.packing import WordIds, best_fit_decreasing, op7_packing, pack

from .fixtures import documents, frame, prose, stored

FILE = path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(FILE)
    texts = [t or "" for _, t, *_ in documents()] + ["a\x0bb\x0cc\td\re\x1cf\x85g h i", "It's WE'RE 'S İstanbul K Å À éx", "<|endoftext|>x <|EndOfText|> <|STARTOFTEXT|>", "日本語 テキスト 12345 3.14,, -- ...!?", "ΑΣ ΣΑΣ. ǅ ß ẞ"]
    got = WordIds(FILE, most=50).encode([t.encode() for t in texts])
    again = WordIds(FILE)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids
        assert again.encode([t.encode()])[0].tolist() == ids.tolist()


def test_best_fit_against_a_plain_search():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 100):
        lengths = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
        left, want = [], []
        for n in lengths:
            open_ = [(r, w) for w, r in enumerate(left) if r >= n]
            if open_:
                r = min(open_)[0]
            else:
                r = capacity
            want.append(r)
            if open_:
                left[min(open_)[1]] -= n
            else:
                left.append(capacity - n)
        got = best_fit_decreasing(lengths, capacity)
        assert [capacity - o for _, o in got] == want
        assert len({w for w, _ in got}) == len(left)


def check(rows, docs, capacity=4096):
    plain = Tokenizer.from_file(FILE)
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in docs]
    want = sorted(((i, zlib.crc32(np.array(x, "<u4").tobytes())) for (i, *_), x in zip(docs, ids, strict=True)), key=str)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    firsts = defaultdict(list)
    for (i, *_), x in zip(docs, ids, strict=True):
        for low in range(0, len(x), capacity):
            firsts[i, low, len(x[low : low + capacity]), len(x)].append(zlib.crc32(np.array(x[low : low + capacity], "<u4").tobytes()))
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["doc_tokens"]].append(r["ids_crc32"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in firsts.items()}
    return by_sequence


def test_whole_table(spark, tmp_path):
    docs = [*documents(), *((1000 + i, prose(random.Random(i).randint(1, 900), i), None, None, 0) for i in range(150))]
    rows = op7_packing(spark, stored(spark, tmp_path, docs)).collect()
    by_sequence = check(rows, docs)
    assert sum(4096 - sum(n for _, n in s) for s in by_sequence.values()) < 2 * 4096


def test_empty_table(spark, tmp_path):
    assert op7_packing(spark, stored(spark, tmp_path, [])).count() == 0


def test_equal_rows_share_no_group(spark):
    out = pack(frame(spark, [(1, "a few words", None, None, 0)] * 300), per_group=20)
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") / 2**32).cast("long")).count().collect()]
    assert sum(sizes) == 300 and max(sizes) < 60


def test_new_plain_words_skip_the_steps_that_leave_them_alone():
    """Nearly all new words go to the tokenizer without its normaliser, marks apart from letters; ids are the library's."""
    known = WordIds(FILE)
    slow, rows = [], known._rows
    known._rows = lambda words: slow.extend(words) or rows(words)
    text = " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}é{'uvwxyz'[k % 6]}" + ("", ".", ",$$$", "'")[k % 4] for k in range(500))
    odd = "it's 't's ''s élan's ÷a ÿ÷ß.ÿ µm ªº a1b2!! _a_ w</w> </w> ﬁ.. İ. e\u0301. <\u0338 \x00a\x00. É, ... ' 's"
    rng = random.Random(3)
    noise = ["".join(rng.choice("abzéßÿ÷×'<>/w|.,$1_\u0338\u0301 \u00a0\u2003stmdlİ") for _ in range(60)) for _ in range(300)]
    whole = Tokenizer.from_file(FILE)
    assert known.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert not slow
    assert [i.tolist() for i in known.encode([x.encode() for x in (odd, *noise)])] == [whole.encode(x, add_special_tokens=False).ids for x in (odd, *noise)]
