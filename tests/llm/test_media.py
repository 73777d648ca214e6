import hashlib
import io
import tarfile
import zlib
from collections import Counter

import pytest
from pyarrow.fs import FileSelector, FileSystem

from contourlake.llm.media import from_png, media_columns, op6_media_columns, payload, png_header, store_texts, to_png

from contourlake.llm import media

from .fixtures import documents, forgetful, frame, stored


def test_round_trip_and_damage():
    for text in (b"", b"x", b"y" * 64, b"z" * 65, bytes(range(256)) * 40):
        image = to_png(payload(text))
        assert from_png(image) == payload(text) and png_header(image[:33]) == (64, len(payload(text)) // 64, 8)
        assert len(payload(text)) % 64 == 0 and len(payload(text)) > 0
    with pytest.raises(ValueError):
        from_png(image[:60] + bytes([image[60] ^ 1]) + image[61:])


def test_contract(spark, tmp_path):
    docs = documents()
    got = op6_media_columns(spark, stored(spark, tmp_path, docs)).collect()
    want = []
    for i, text, *_ in docs:
        raw = (text or "").encode()
        p = payload(raw)
        image = to_png(p)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest()))
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    places = {(r["shard"], r["offset"]) for r in got}
    assert len(places) == len({t or "" for _, t, *_ in docs})


def test_shards_are_tar_files_with_each_payload_once(spark):
    docs = documents()
    places, root = store_texts(frame(spark), shard_bytes=4000)
    fs, base = FileSystem.from_uri(root)
    names = []
    for info in fs.get_file_info(FileSelector(base)):
        with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(info.path).read())) as tar:
            for m in tar:
                names.append((m.name[3:-4], info.base_name, m.offset_data, m.size))
                assert hashlib.sha256(from_png(tar.extractfile(m).read()).rstrip(b"\0")).hexdigest() == m.name[3:-4] or m.size < 120
    assert sorted(names) == sorted(map(tuple, places.collect()))
    assert len(names) == len({t or "" for _, t, *_ in docs})


def test_header_columns(spark):
    out, _ = media_columns(frame(spark))
    rows = out.collect()
    assert len(rows) == len(documents()) and all(r["width"] == 64 and r["bits"] == 8 for r in rows)
    assert {(r["doc_id"], r["height"]) for r in rows} == {(i, len(payload((t or "").encode())) // 64) for i, t, *_ in documents()}


def test_clashing_columns_are_replaced(spark):
    names = ["digest", "shard", "offset", "LENGTH", "width", "height", "bits", "row", "place_of_digest"]
    docs = frame(spark).selectExpr("doc_id", "text", *(f"'old' AS `{n}`" for n in names))
    out, _ = media_columns(docs)
    assert out.columns == ["doc_id", "row", "place_of_digest", *media.MEDIA]
    rows = out.collect()
    assert {(r["doc_id"], r["height"], r["row"]) for r in rows} == {(i, len(payload((t or "").encode())) // 64, "old") for i, t, *_ in documents()}
    only, _ = media_columns(docs.select("text"))
    assert only.count() == len(documents()) and only.columns == list(media.MEDIA)


def test_segments_without_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media.ranges, "answers", forgetful(media.ranges.answers, 2))
    places, root = store_texts(frame(spark))
    assert sorted(r["digest"] for r in places.collect()) == sorted({hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in documents()})


def test_a_very_long_text(spark):
    text = "long " * 400_000
    places, root = store_texts(frame(spark, [(1, text, None, None, 0), (2, text, None, None, 0)]))
    assert media.read_back(places, root).first()["payload_sha256"] == hashlib.sha256(payload(text.encode())).hexdigest() and places.count() == 1


def test_empty_table(spark, tmp_path):
    assert op6_media_columns(spark, stored(spark, tmp_path, [])).count() == 0
