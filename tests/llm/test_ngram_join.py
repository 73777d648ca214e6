import random

import numpy as np
from pyspark.sql import functions as F

from contourlake.llm import components as module
from contourlake.llm import ngram_join
from contourlake.llm.components import components
from contourlake.llm.ngram_join import jaccard_groups, op2_ngram_jaccard_join

from .fixtures import WORD, documents, edited, forgetful, frame, prose, stored

ranges_answers = ngram_join.ranges.answers
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=3, num=90, den=100):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)), key=str)


def many():
    """A hundred near copies, some linked only through others, besides unlike texts with shared passages."""
    rng, base, common = random.Random(4), prose(150, 20), prose(40, 21)
    near = [(100 + i, edited(base, i, rng.randint(1, 6)), None, None, 0) for i in range(100)]
    chain, text = [], prose(200, 22)
    for i in range(12):
        chain.append((300 + i, text, None, None, 0))
        text = edited(text, 500 + i, 1)
    mixed = [(400 + i, common + " " + prose(60 + i, 30 + i), None, None, 0) for i in range(40)]
    return [*documents(), *near, *chain, *mixed]


def test_equals_brute_force(spark, tmp_path):
    got = [tuple(r) for r in op2_ngram_jaccard_join(spark, stored(spark, tmp_path, many())).collect()]
    assert sorted(got, key=str) == brute(many())


def test_other_parameters(spark, monkeypatch):
    """And with more asked ids than are broadcast."""
    monkeypatch.setattr(ngram_join, "MOST_TOLD", 0)
    got = [tuple(r) for r in jaccard_groups(frame(spark, many()), words_each=5, num=8, den=10, rounds=1).collect()]
    assert sorted(got, key=str) == brute(many(), 5, 8, 10)


def test_segments_without_answers(spark, monkeypatch):
    """Where no segment finds its answer, and where only every other one does."""
    for step in (1, 2):
        monkeypatch.setattr(ngram_join.ranges, "answers", forgetful(ranges_answers, step))
        got = [tuple(r) for r in jaccard_groups(frame(spark, many())).collect()]
        assert sorted(got, key=str) == brute(many())


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "FEW", 2)
    monkeypatch.setattr(module, "BLOCK", 3)
    got = [tuple(r) for r in jaccard_groups(frame(spark, many())).collect()]
    assert sorted(got, key=str) == brute(many())


def test_blocks_ask_for_few_sets(spark, monkeypatch):
    """Near copies share most of their tokens: a pair is judged in one of their units, and sets that no unit asks for don't travel."""
    rows, plans = {}, {}

    def counted(df, label, *args, **options):
        out = ngram_join_written(df, label, *args, **options)
        rows[label], plans[label] = out.count(), df._jdf.queryExecution().optimizedPlan().toString()
        return out

    ngram_join_written = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", counted)
    monkeypatch.setattr(module, "FEW", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = [(i, edited(prose(150, 20), i, 2), None, None, 0) for i in range(100)]
        got = [tuple(r) for r in jaccard_groups(frame(spark, near), rounds=1).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got, key=str) == brute(near)
    assert rows["block-candidates"] <= 5 * len(near)
    assert all("LeftSemi" in plans[label] and "broadcast" in plans[label] for label in ("block-candidates", "similar-blocks"))


def test_empty_table(spark, tmp_path):
    assert op2_ngram_jaccard_join(spark, stored(spark, tmp_path, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000), (None, 4)]
    random.Random(1).shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).select("id", "component").collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(51)}}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_bounds_within_blocks_lose_no_pair():
    """Every pair that links may link by the sketches, with repeated 32-bit tokens too; most unlike pairs may not."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    base[1] = base[0] ^ np.uint64(1)
    base[21] = base[20] ^ np.uint64(1)
    sets = [np.unique(np.concatenate((np.delete(base, rng.choice(len(base), k % 40, replace=False)), rng.integers(0, 2**64, k % 15, dtype=np.uint64)))) for k in range(60)]
    sets += [np.unique(np.concatenate((base[:120], rng.integers(0, 2**64, 300, dtype=np.uint64)))) for _ in range(20)]
    second = [(s[: ngram_join.region(len(s), 90, 100)] >> np.uint64(32)).astype(np.uint32) for s in sets]
    third = [ngram_join.third_prefix(s, 90, 100) for s in sets]
    may = ngram_join.may_link_within(second, third, np.array([len(s) for s in sets]), 90, 100)
    linked = np.array([[100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t)) for t in sets] for s in sets])
    assert not (linked & ~may).any()
    assert linked[:60, :60].sum() > 60
    assert not may[60:, :60].any()
