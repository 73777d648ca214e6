import hashlib

import corpus_pipeline
from contourlake.llm.quality import judged

from . import test_lines, test_ngram_join, test_packing, test_substring
from .fixtures import WORD, frame, prose, stored


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def corpus():
    shared = prose(60, 77)
    extra = [(2000 + i, prose(60, 700 + i) + " " + shared + " " + prose(50, 800 + i), "en", "a", 0) for i in range(8)]
    words = prose(220, 78).split(" ")
    wrapped = [(3000 + w, "\n".join(" ".join(words[k : k + w]) for k in range(0, 220, w)), "fr", "b", 0) for w in (9, 23, 41)]
    return [*wrapped, *test_ngram_join.many(), *test_lines.many()[len(test_lines.documents()) :], *extra]


def test_each_stage_equals_brute_force_on_its_input(spark, tmp_path):
    folder = stored(spark, tmp_path, corpus())
    docs = frame(spark, corpus())
    kept = {(r["id"], r["text_hash"]) for r in judged(docs).where("kept").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, folder).cache()
    assert {(r[0], r[1]) for r in docs.selectExpr("doc_id", "xxhash64(text)", "text").collect() if (r[0], r[1]) in kept} == {(r[0], r[1]) for r in first.selectExpr("doc_id", "xxhash64(text)").collect()}

    before = rows_of(first)
    second = rows_of(corpus_pipeline.line_dedup(spark, first, folder))
    gone = test_lines.brute(before)
    want = {}
    for i, text, *_ in before:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if WORD.search(left) or i is None:
            want[i, left] = len(left)
    assert {(i, t): n for i, t, _, _, n in second} == want

    third = rows_of(corpus_pipeline.near_duplicates(spark, frame(spark, second), folder))
    groups = {(i, c) for i, _, c in test_ngram_join.brute(second, 5, 8, 10)}
    assert sorted(third, key=str) == sorted((r for r in second if r[0] is None or (r[0], r[0]) in groups), key=str)
    assert len(third) < len(second)

    fourth = rows_of(corpus_pipeline.substring_dedup(spark, frame(spark, third), folder))
    digests = {(i, d) for i, n, removed, d in test_substring.brute(third) if removed < n or not n}
    assert {(i, hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest()) for i, t, *_ in fourth} == digests
    assert sum(map(len, (t for _, t, *_ in fourth))) < sum(map(len, (t for _, t, *_ in third)))

    test_packing.check(corpus_pipeline.packing(spark, frame(spark, fourth), folder).collect(), fourth)


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    folder = stored(spark, tmp_path, corpus())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "none", [])).count() == 0
