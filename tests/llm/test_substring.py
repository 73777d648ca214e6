import hashlib

from contourlake.llm.substring import op1_substring_dedup, remove_repeats

from .fixtures import WORD, documents, frame, stored


def brute(rows, k=50):
    first = {}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        for s in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        gone = set()
        for s in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark, tmp_path):
    got = [tuple(r) for r in op1_substring_dedup(spark, stored(spark, tmp_path)).collect()]
    assert sorted(got, key=str) == brute(documents())
    assert any(r[2] for r in got)


def test_empty_table(spark, tmp_path):
    assert op1_substring_dedup(spark, stored(spark, tmp_path, [])).count() == 0


def test_texts_keep_their_other_bytes(spark):
    docs = frame(spark)
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    kept = {(r["doc_id"], r["text"]) for r in out.collect()}
    same = {r[0]: r[3] for r in brute(documents())}
    for i, text in kept:
        if i is not None and text is not None:
            assert hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest() == same[i]
    assert (22, "") not in kept and (22, None) not in kept
    assert (16, "") in kept and (19, None) in kept


def test_different_texts_under_one_id(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(80))
    rows = [(1, a, None, None, 0), (5, a, None, None, 0), (5, b, None, None, 0)]
    got = {r["text"] for r in remove_repeats(frame(spark, rows)).where("doc_id = 5").collect()}
    assert got == {"", b}
