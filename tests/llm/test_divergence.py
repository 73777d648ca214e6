"""Divergence against whole numbers in plain Python, with and without answers of the sketch."""

import re
from collections import Counter, defaultdict

from contourlake.llm import divergence as D
from contourlake.llm import ranges

from . import fixtures

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, most=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, per, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(lower))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        per[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        v = len(kept)
        size = {s: sum(per[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (per[lang, s][t] + 1) // (size[s] + v) for t in kept} for s in sources}
        total = Counter()
        for s in sources:
            total.update({t: per[lang, s][t] for t in kept})
        q = {t: 1 + 10**9 * (total[t] + 1) // (sum(size.values()) + v) for t in kept}
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if per[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda f: (-f[0], f[1].encode()))[: None if part == "pair" else most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def awkward():
    rows = [(r[1], r[2], r[3]) for r in fixtures.documents()]
    rows += [("rare words once", "en", "src9"), ("Straße STRASSE Ünï　日本語 ünÏ x1y", "en", "src0")] * 2
    rows += [("", "xx", "only"), (None, "xx", "other"), ("123 -- 456", "xx", None), ("hot word " * 4000, "en", "src0")]
    return rows + [("alpha beta gamma", "en", "src1")] * 500


def test_all_parts_equal_plain_arithmetic(spark):
    rows = awkward()
    assert got(D.divergence(table(spark, rows).repartition(3))) == brute(rows)


def test_few_ranks_other_floors_and_clashing_columns(spark):
    rows = awkward()
    clash = table(spark, rows).selectExpr("*", "1 AS term", "2 AS n", "'a' AS docs", "3 AS item", "0 AS p0")
    assert got(D.divergence(clash, least=2, terms_each=3)) == brute(rows, 2, 3)


def test_lost_answers_lose_nothing(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(ranges, "answers", fixtures.forgetful(ranges.answers, 1))
    assert got(D.divergence(table(spark, rows).repartition(3))) == brute(rows)


def test_rare_terms_go_before_the_shuffle(spark):
    rows = [(f"common words {fixtures.prose(300, k, 10**9)}", "en", f"s{k % 3}") for k in range(60)]
    terms = {r["term"] for r in D.term_counts(table(spark, rows)).collect()}
    every = {t for r in rows for t in TERM.findall(r[0])}
    frequent = {t for t in every if sum(t in TERM.findall(r[0]) for r in rows) >= 3}
    assert frequent <= terms and len(terms - frequent) < 0.1 * len(every - frequent) + 1


def test_an_empty_table(spark, tmp_path):
    assert D.op12_source_divergence(spark, fixtures.stored(spark, tmp_path, [])).count() == 0
