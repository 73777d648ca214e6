import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contourlake.llm.sharding import op10_sharding, rendezvous, shard

from .fixtures import documents, frame, prose, stored


def draw(key, s):
    return (int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13


def best(key, weights):
    return max(range(len(weights)), key=lambda s: (weights[s] / -math.log(draw(key, s)), -s))


def rows():
    return [*documents(), *((5000 + i, prose(3 + i % 5, i), None, None, 0) for i in range(400))]


def test_contract(spark, tmp_path):
    got = op10_sharding(spark, stored(spark, tmp_path, rows())).collect()
    want = []
    for i, text, *_ in rows():
        raw = (text or "").encode()
        want.append((i, len(raw) + 16, zlib.crc32(raw), "key", best(i, [1.0] * 40), best(i, [1.0] * 41)))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == Counter(want)
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"]))
    for found in slots.values():
        found.sort()
        assert [s for s, *_ in found] == list(range(len(found))) and [x[1:] for x in found if x[1]] == sorted(x[1:] for x in found if x[1])


def test_weights_share_and_changes_move_little(spark):
    keys = spark.range(8000).select("id", rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), rendezvous(F.col("id"), [1.0, 2.0, 1.0, 1.0]).alias("b"))
    found = keys.collect()
    share = Counter(r["a"] for r in found)
    assert abs(share[1] / 8000 - 0.5) < 0.03 and abs(share[0] / 8000 - 0.25) < 0.03
    assert {r["b"] for r in found if r["a"] != r["b"]} == {3}
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [1.0, 0.0])


def test_one_key_for_all_and_empty(spark, tmp_path):
    same = frame(spark, [(7, "x", None, None, 0)] * 50).withColumn("slot", F.lit("other"))
    out = shard(same, "doc_id", [1.0] * 5).collect()
    assert sorted(r["slot"] for r in out) == list(range(50)) and len({r["shard"] for r in out}) == 1
    assert op10_sharding(spark, stored(spark, tmp_path, [])).count() == 0


def test_clashing_columns(spark):
    docs = frame(spark).selectExpr("doc_id", *(f"'old' AS `{n}`" for n in ("SHARD", "slot", "_base", "part", "number", "row", "order", "base")))
    out = shard(docs, "doc_id", [1.0] * 5)
    assert out.columns == ["doc_id", "_base", "part", "number", "row", "order", "base", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == docs.count() and {r["base"] for r in rows} == {"old"}
    for k in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
