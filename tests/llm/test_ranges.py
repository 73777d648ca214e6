from collections import Counter

import numpy as np

from contourlake.llm import ranges


def told(segments, dealt, members=()):
    """What the pieces answer to segments of keys, without Spark."""
    asked = {}
    rows = [r for keys in segments for r in ranges.questions(keys, dealt, counted=not len(members))]
    rows += [r for keys in members for r in ranges.questions(keys, dealt, asked=False)]
    for seg, row, piece, body in rows:
        asked.setdefault((row, piece), []).append((seg, body))
    return {(seg, *key): body for key, bodies in asked.items() for seg, body in ranges.counts_in(dealt)(bodies)}


def classes(monkeypatch, found, dealt, keys):
    monkeypatch.setattr(ranges, "answer_rows", lambda root, seg: dict(sorted((k[1:], b) for k, b in found.items() if k[0] == seg)))
    return ranges.Answers("", dealt).classes(keys)


def test_share_that_passes_does_not_grow_with_the_data(monkeypatch):
    """Of keys seen once, as many pass at 1, 10 and 100 times the data; of repeated ones all do. Pieces of 2**10 keys stand for larger ones."""
    rng, shares = np.random.default_rng(3), []
    for n in (10_000, 100_000, 1_000_000):
        dealt = ranges.ranges_for(n, 1, log_keys=10)
        keys = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        keys[: n // 10] = keys[n // 10 : n // 5]
        parts = np.array_split(keys, 8)
        found = told(parts, dealt)
        got = np.concatenate([classes(monkeypatch, found, dealt, p) for p in parts])
        assert (got[: n // 5] > 1).all() and (got > 0).all()
        shares.append((got[n // 5 :] > 1).mean())
    assert max(shares) < 0.07 and max(shares) < 1.5 * min(shares) + 0.01, shares


def test_classes_bound_counts_from_above(monkeypatch):
    rng = np.random.default_rng(5)
    keys = rng.zipf(1.3, 40_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    count = Counter(keys.tolist())
    for depth in (1, 2):
        dealt = ranges.ranges_for(len(keys), depth)
        parts = np.array_split(keys, 5)
        found = told(parts, dealt)
        for part in parts:
            got = classes(monkeypatch, found, dealt, part)
            least = np.array([min(15, count[k].bit_length()) for k in part.tolist()])
            assert (got >= least).all() and (got == least).mean() > 0.9


def test_members(monkeypatch):
    keys = np.random.default_rng(6).integers(0, 2**63, 20_000, dtype=np.uint64)
    dealt = ranges.ranges_for(len(keys))
    found = told([keys], dealt, [keys[:100], keys[50:500]])
    got = classes(monkeypatch, found, dealt, keys) > 0
    assert got[:500].all() and got[500:].mean() < 0.1


def test_missing_answers_are_unknown(monkeypatch):
    keys = np.arange(100, dtype=np.uint64)
    dealt = ranges.ranges_for(100)
    assert (classes(monkeypatch, {}, dealt, keys) == ranges.UNKNOWN).all()
    assert len(classes(monkeypatch, {}, dealt, keys[:0])) == 0


def test_answers_in_files(spark):
    """Segments of a table's scan, through Spark and the shared folder."""
    dealt = ranges.ranges_for(30_000)

    def keys_of(batches):
        for batch in batches:
            yield batch, batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def ask(batches):
        for segment in ranges.segments(keys_of(batches)):
            yield ranges.batch_of(ranges.questions(ranges.joined(segment), dealt))

    table = spark.range(30_000).selectExpr("IF(id < 3000, id % 1000, id) AS id").coalesce(3)
    root = ranges.answers(table.mapInArrow(ask, ranges.DDL), ranges.counts_in(dealt))

    def read(batches):
        import pyarrow as pa

        for segment in ranges.segments(keys_of(batches)):
            got = ranges.Answers(root, dealt).classes(ranges.joined(segment))
            ids = np.concatenate([b.column(0).to_numpy() for b, _ in segment])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got.astype(np.int64))], names=["id", "bits"])

    got = {(r["id"], r["bits"]) for r in table.mapInArrow(read, "id long, bits long").collect()}
    assert all(bits == 2 for i, bits in got if i < 1000) and sum(bits == 1 for i, bits in got if i >= 3000) > 25_000


def test_pieces_grow_and_stay_bounded():
    for log_n in range(0, 60):
        dealt = ranges.ranges_for(1 << log_n, 2)
        assert dealt.log_cells <= 26 and dealt.log_pieces + dealt.log_cells <= 64
        assert (1 << dealt.log_pieces + dealt.log_cells) >= 4 << log_n
