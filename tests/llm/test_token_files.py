"""Coding round trips, segments against the library on whole texts, and files against what was written."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from contourlake.llm import token_files as T
from contourlake.llm.kernels import text_buffer
from contourlake.llm.packing import tokenizer_file
from contourlake.llm.store import scratch_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import fixtures


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_ranks_of_every_width_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 4097):
        ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype("<u4")
        control, data = T.coded(ranks)
        assert len(control) == -(-n // 4) and (T.decoded(control, data, n) == ranks).all()
    edges = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], "<u4")
    control, data = T.coded(edges)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 and (T.decoded(control, data, 8) == edges).all()
    with pytest.raises(ValueError):
        T.decoded(control, data[:-1], 8)


def test_segments_give_the_ids_of_whole_texts(library):
    rng = random.Random(2)
    letters = " \t\n\r\x0b\x0c\x1c\x1f 　 \u0085᠎﻿ab1é,.'<|s日"
    texts = ["", "<|endoftext|> a <|endoftext|>  b<|endoftext", "x<|endoftext|>y", "   lead", "trail   ", "a\n\nb", "a\n b", "don't we'll", "日本語 テキスト  a"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    vocabulary = T.segment_ids("byte_bpe_50k.json")
    size, ids = T.text_ids(vocabulary, *text_buffer(pa.array(texts)))
    assert np.split(ids, np.cumsum(size)[:-1])[0].size == 0
    for text, found in zip(texts, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == found.tolist(), text


def test_a_vocabulary_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED_BYTES", 40)
    vocabulary = T.SegmentIds(tokenizer_file("byte_bpe_50k.json"))
    once = [T.text_ids(vocabulary, *text_buffer(pa.array([fixtures.prose(30, k)]))) for k in (1, 2, 1)]
    assert vocabulary.held < 400 and (once[0][1] == once[2][1]).all()


def expected(rows, library):
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    return ids


def test_query_equals_the_library(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 500)
    rows = [r for r in fixtures.documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = T.op11_token_files(spark, fixtures.stored(spark, tmp_path, rows)).orderBy("doc_id").collect()
    start = 0
    for row, (doc, text, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_and_null_ids_long_texts_and_other_columns(spark, library):
    long = fixtures.prose(200_000, 3)
    rows = [(7, fixtures.prose(5, k % 3), 1) for k in range(300)] + [(None, "x", 1), (None, None, 2), (8, long, 3), (1, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(5)
    folder = scratch_path(spark, "test-tokens")
    files = T.write_token_files(docs, folder)
    found = T.read_token_files(spark, folder).orderBy("start").collect()
    assert files.agg(F.sum("n_docs")).first()[0] == len(rows) == len(found)
    assert [r["doc_id"] for r in found] == [None, None, 1] + [7] * 300 + [8]
    at = 0
    for r in found:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    whole = np.frombuffer(found[-1]["ids"], "<u4").tolist()
    assert whole == [*library.encode(long, add_special_tokens=False).ids, 2]
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True) and sum(r["n"] for r in ranks) == at


def test_equal_ids_go_to_several_files(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "concat('text ', id % 2) AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one partition
    try:
        files = T.write_token_files(docs, scratch_path(spark, "test-tokens"))
        assert files.count() > 2 and files.agg(F.max("n_docs")).first()[0] < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_empty_table_has_no_files(spark, tmp_path):
    assert T.op11_token_files(spark, fixtures.stored(spark, tmp_path, [])).count() == 0


def test_a_damaged_file_is_an_error():
    import io

    good = T.block(pa.array([1, None], pa.int64()), np.array([2, 1]), np.array([5, 300, 2], "<u4"))
    ((docs, sizes, ranks),) = T.blocks(io.BytesIO(good))
    assert docs.to_pylist() == [1, None] and sizes.tolist() == [2, 1] and ranks.tolist() == [5, 300, 2]
    for bad in (good[:-1], b"XXXX" + good[4:]):
        with pytest.raises(ValueError):
            list(T.blocks(io.BytesIO(bad)))
