import random
from functools import cache

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from sentencepiece import sentencepiece_model_pb2 as pb

from contourlake.llm.pieces import BAR, CountingViterbi, Remembered, StreamingViterbi, Vocabulary, count_tokens, decode, decode_ids, encode_texts, op4_sentencepiece, op9_token_counts

from .fixtures import documents, frame, prose, stored

MODEL = "piece_bpe_32k.model"
ODD = ["a  b   c ", " x", "\n\n a\n b \n", "naïve 日本語 \U0001f600‍ x", "ab" + BAR + "cd", "0123456789 3.14", "\t\x00\x7f", "<0x41> <s> </s> <unk>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


@cache
def tools():
    v = Vocabulary(MODEL)
    return v, StreamingViterbi(v), CountingViterbi(v)


@cache
def library():
    """The same pieces and scores under the library's unigram model."""
    proto = pb.ModelProto()
    with open(path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def texts():
    return [t for _, t, *_ in documents() if t and len(t) < 3000] + ODD + [prose(80, i) for i in range(20)]


def test_ids_and_counts_are_the_library_s():
    v, stream, count = tools()
    for t in texts():
        want = library().encode(t)
        whole = BAR + t.replace(" ", BAR)
        assert stream.encode(whole) == want
        assert [i for s in v.segments(t) for i in stream.encode(s)] == want
        assert "".join(v.segments(t)) == whole
        assert count.count(whole) == len(want) == sum(map(count.count, v.segments(t)))
        assert decode(v, want).decode() == t.replace(BAR, " ")


class Toy(Vocabulary):
    """A made-up vocabulary with ties, with or without bytes' pieces."""

    def __init__(self, seed, bytes_too):
        rng = random.Random(seed)
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(14)} | {"c"}
        self.score = {p: (float(-rng.randint(0, 4)), i + 300) for i, p in enumerate(sorted(pieces))}
        self.unknown_id, self.byte_ids = 0, {b: b + 1 for b in range(256)} if bytes_too else {}
        self.unknown_score, self.longest = min(s for s, _ in self.score.values()) - 10, max(map(len, pieces))
        self.cut_at_spaces = self.newline_alone = False


def brute(v, text):
    """Best ids by plain dynamic programming over starts in rising order, as the library does it."""
    best = [(0.0, [])] + [None] * len(text)
    for at in range(len(text)):
        single = False
        for end in range(at + 1, len(text) + 1):
            if (p := text[at:end]) in v.score:
                s, i = v.score[p]
                single |= end == at + 1
                if best[end] is None or best[at][0] + s > best[end][0]:
                    best[end] = best[at][0] + s, [*best[at][1], i]
        if not single and (best[at + 1] is None or best[at][0] + v.unknown_score > best[at + 1][0]):
            best[at + 1] = best[at][0] + v.unknown_score, [*best[at][1], (text[at],)]
    out, before = [], False
    for i in best[-1][1]:
        out += v.unknown_ids(i[0], before) if isinstance(i, tuple) else [i]
        before = isinstance(i, tuple)
    return out


@pytest.mark.parametrize("bytes_too", [True, False])
def test_streams_equal_brute_force_within_a_bounded_window(bytes_too):
    rng = random.Random(9)
    for seed in range(60):
        v = Toy(seed, bytes_too)
        stream, count = StreamingViterbi(v), CountingViterbi(v)
        for n in (0, 1, 5, 40, 400):
            t = "".join(rng.choice("aaabbbcdé") if seed % 2 else rng.choice("ab") for _ in range(n))
            want = brute(v, t)
            assert stream.encode(t) == want
            assert count.count(t) == len(want)
    v, stream, _ = tools()
    stream.most_held = 0
    stream.encode("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20000)))  # no space anywhere
    assert stream.most_held <= 8 * v.longest


def test_forgetting_changes_nothing():
    v, stream, _ = tools()
    few = Remembered(stream.encode, most=3)
    words = prose(300, 1, 10).split(" ")
    assert [few[w] for w in words] == [stream.encode(w) for w in words]


def test_tables(spark, tmp_path):
    docs = [*documents(), *((900 + i, t, None, None, 0) for i, t in enumerate(ODD))]
    folder = stored(spark, tmp_path, docs)
    got = {(r["doc_id"], r["n_ids"], r["lossless"]) for r in op4_sentencepiece(spark, folder).collect()}
    v, stream, _ = tools()
    assert got == {(i, sum(len(stream.encode(s)) for s in v.segments(t or "")), BAR not in (t or "")) for i, t, *_ in docs}
    assert {(r["doc_id"], r["n_tokens"]) for r in op9_token_counts(spark, folder).collect()} == {(i, n) for i, n, _ in got}


def test_round_trip_through_tables(spark):
    docs = frame(spark)
    ids = encode_texts(docs)
    assert sorted(map(tuple, decode_ids(ids).collect()), key=str) == sorted(((i, t or "") for i, t, *_ in documents()), key=str)
    assert count_tokens(docs).count() == len(documents())
    one = ids.where("doc_id = 1").first()
    assert np.frombuffer(one["ids"], "<u4").tolist() == library().encode(documents()[0][1])


def test_empty_tables(spark, tmp_path):
    folder = stored(spark, tmp_path, [])
    assert op4_sentencepiece(spark, folder).count() == op9_token_counts(spark, folder).count() == 0
