import random
from collections import defaultdict

import numpy as np

from contourlake.llm import components, lines
from contourlake.llm.lines import drop_similar_lines, line_decisions, normal, op8_line_dedup, shingle_sets, similar_pairs

from .fixtures import documents, edited, frame, prose, stored


def shingles(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def brute(rows, num=8, den=10):
    """(id, place) of the lines that go: least (id, line) of each component stays."""
    places = defaultdict(set)
    for i, text, *_ in rows:
        for k, x in enumerate((text or "").encode().split(b"\n")):
            if i is not None and (x := normal(x)):
                places[x.decode()].add((i, k))
    lines = sorted(places)
    sets, parent = [shingles(x) for x in lines], list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for a, x in enumerate(lines):
        groups[find(a)] |= places[x]
    return {p for g in groups.values() for p in g if p != min(g)}


def many():
    """Near copies well above the threshold, so that banding finds all of them, besides unlike lines."""
    rng, rows = random.Random(3), documents()
    lines = [prose(40, 50 + i) for i in range(30)]
    for i in range(60):
        some = [edited(rng.choice(lines), i * 7 + j, 1) if j % 2 else rng.choice(lines) for j in range(4)]
        rows.append((500 + i, "\n".join([*some, "", "  A Footer Line %d of the site  " % (i % 3), prose(20, 900 + i)]), None, None, 0))
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = many()
    got = op8_line_dedup(spark, stored(spark, tmp_path, rows)).collect()
    assert {(r["doc_id"], k) for r in got for k in r["removed_lines"]} == brute(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["n_removed"] == len(r["removed_lines"]) for r in got)
    for i, text, *_ in rows:
        if i is not None:
            assert by_id[i]["n_lines"] == sum(bool(normal(x)) for x in (text or "").encode().split(b"\n"))
    assert len(got) == len(rows)


def test_large_buckets_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 2)
    monkeypatch.setattr(components, "BLOCK", 3)
    base = prose(60, 400)
    rows = [(i, edited(base, i, 1 + i % 6), None, None, 0) for i in range(60)]
    for rounds in (1, 3):
        got = line_decisions(frame(spark, rows), rounds=rounds)[1].collect()
        want = {i for i, _ in brute(rows)}
        assert {r["doc"] for r in got} <= want and len(got) >= 0.9 * len(want)


def test_texts_lose_only_those_lines(spark):
    rows = many()
    gone = brute(rows)
    want = sorted(((i, t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t, *_ in rows), key=str)
    out = drop_similar_lines(frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    assert out.columns == frame(spark).columns


def test_similarity():
    lines = ["abcdefgh", "abcdefgx", "ab", "abc", "é" * 9, "éa", "", "a", "abcdefghijklmnopq", "abcdefghijklmnopr", "x" * 300]
    raw = [x.encode() for x in lines]
    assert list(map(len, shingle_sets(raw))) == [len(shingles(x)) for x in lines]
    a, b = (x.ravel() for x in np.indices((len(lines), len(lines))))
    for num in range(11):
        want = [10 * len(x & y) >= num * len(x | y) for x, y in ((shingles(lines[i]), shingles(lines[j])) for i, j in zip(a, b, strict=True))]
        assert similar_pairs(raw, a, b, num, 10).tolist() == want


def test_empty_table(spark, tmp_path):
    assert op8_line_dedup(spark, stored(spark, tmp_path, [])).count() == 0


def test_long_lines_are_compared_in_portions(monkeypatch):
    monkeypatch.setattr(lines, "BYTES_AT_ONCE", 100)
    sizes = np.array([5, 300, 40, 50, 20, 1, 1, 1, 0, 90])
    cut = list(lines.portions(sizes, 3))
    assert [k for low, high in cut for k in range(low, high)] == list(range(len(sizes)))
    assert all(high - low <= 3 and (high - low == 1 or sizes[low:high].sum() <= 100) for low, high in cut)
    assert list(lines.portions(sizes[:0], 3)) == []
    texts = [b"a line of text %d" % k * (k % 7 + 1) for k in range(50)]
    h, bounds = lines.shingle_hashes(texts)
    assert all((a == np.unique(h[low:high])).all() for a, low, high in zip(lines.shingle_sets(texts), bounds[:-1], bounds[1:], strict=True))
