import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from contourlake.llm import quality
from contourlake.llm.kernels import mix, text_buffer
from contourlake.llm.quality import discounts, judged, keep_good, op3_quality_rules, units

from .fixtures import WORD, documents, forgetful, frame, prose, stored


def features(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def unit_list(text):
    """Words with A-Z lowered; long ones in pieces that begin at the first character of every six bytes."""
    out = []
    for w in WORD.findall(text.translate({k: k + 32 for k in range(65, 91)})):
        if len(w.encode()) <= 32:
            out.append(w)
            continue
        at, last = 0, -1
        for c in w:
            if at // 6 != last:
                out.append("")
                last = at // 6
            out[-1] += c
            at += len(c.encode())
    return out


def test_units():
    texts = ["Short words only", "x" * 33 + " Y", "日本語の文章は空白を持たない日本語の文章は空白を持たない end", "", "é" * 40 + "\n" + "ab" * 16]
    data, at = text_buffer(pa.array(texts))
    w = units(data, at)
    raw = w.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(w.start[low:high], w.end[low:high], strict=True)] for low, high in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert got == [unit_list(t) for t in texts]


def plain_log_perplexity(texts):
    """The model over dictionaries, straight from its definition."""
    sequences = [["<1>", "<2>", *unit_list(t or "")] for t in texts]
    triples = {(*s[i - 1 : i + 1], s[i + 1]) if i > 1 else ("<2>", "<2>", s[2]) for s in sequences for i in range(1, len(s) - 1)}
    pairs = Counter((v, w) for _, v, w in triples)
    alone = Counter(w for _, w in pairs)

    def n_of(counts):
        return [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]

    d, e = discounts(*n_of(pairs)), discounts(*n_of(alone))
    total, left = defaultdict(int), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        left[v] += d[min(c, 3)]
    rest = sum(e[min(c, 3)] for c in alone.values())

    def p(v, w):
        q = (alone[w] - e[min(alone[w], 3)] + rest / len(alone)) / sum(alone.values())
        return (pairs[v, w] - d[min(pairs[v, w], 3)] + left[v] * q) / total[v]

    def held_out(v, w):
        """With the pair counted once less."""
        c, n = pairs[v, w], alone[w]
        pairs[v, w], alone[w] = c - 1, n - (c == 1)
        rest_of_v = left[v] - d[min(c, 3)] + d[min(c - 1, 3)]
        q = (alone[w] - e[min(alone[w], 3)] + rest / len(kinds)) / all_pairs
        out = (c - 1 - d[min(c - 1, 3)] + rest_of_v * q) / (total[v] - 1) if total[v] > 1 else q
        pairs[v, w], alone[w] = c, n
        return out

    kinds, all_pairs = set(alone), sum(alone.values())
    return [[[sum(x) / len(x) if x else None for x in [[-math.log(f(s[i - 1], s[i])) for i in range(2, len(s))]]][0] for f in (held_out, p)] for s in sequences]


def test_scores_are_modified_kneser_ney(spark):
    texts = [prose(60, i, 12) for i in range(30)] + ["Été 12, oui! ñ 日本 \U0001f600", "", None, "x" * 100, prose(60, 1, 12)]
    want = plain_log_perplexity(texts)
    got = {r["id"]: [r[c] for c in quality.MEASURES] for r in judged(frame(spark, [(i, t, "en", None, 0) for i, t in enumerate(texts)])).collect()}
    for i, both in enumerate(want):
        for x, y in zip(got[i], both, strict=True):
            assert x is None if y is None else abs(x - y) < 2e-3, (i, x, y)


def test_copies_count_once(spark):
    rows = [(i, prose(120, i), "en", None, 0) for i in range(60)]
    copies = [(100 + i, prose(120, 3), "en", None, 0) for i in range(300)]
    alone, many = ({r["id"]: r for r in judged(frame(spark, x)).collect()} for x in (rows, rows + copies))
    assert all(abs(alone[i]["log_perplexity"] - many[i]["log_perplexity"]) < 1e-9 for i in range(60)) and many[200]["kept"]


def test_segments_without_answers(spark, monkeypatch):
    rows = [(i, prose(90, i), ["en", "fr"][i % 2], None, 0) for i in range(60)]
    want = sorted(map(tuple, judged(frame(spark, rows)).collect()))
    asked, lose = [], forgetful(quality.ranges.answers, 2)

    def first_lost(questions, of):
        asked.append(1)
        return (lose if len(asked) == 1 else answers)(questions, of)

    answers = quality.ranges.answers
    monkeypatch.setattr(quality.ranges, "answers", first_lost)
    assert sorted(map(tuple, judged(frame(spark, rows)).collect())) == want and len(asked) == 2 * (quality.PASSES + 1)


def test_the_model_grows_with_the_corpus(spark):
    """Pairs kept, for one and four times the texts."""
    sizes = []
    for n in (20, 80):
        data, at = text_buffer(pa.array([prose(200, i, 10**6) for i in range(n)]))
        found = quality.sequence(data, at, np.zeros(n, np.int64), np.array([1], np.uint64))
        sizes.append(len(np.unique(quality.pair_keys(found.before, found.unit))))
    assert sizes[1] > 3.5 * sizes[0]


def test_features_equal_brute_force(spark, tmp_path):
    rows = documents()
    got = op3_quality_rules(spark, stored(spark, tmp_path, rows)).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *features(t)) for i, t, *_ in rows)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_bands_reject_what_is_unlike_its_language(spark):
    rows = [(i, prose(120, i, 4), "en" if i % 2 else "fr", None, 0) for i in range(120)]
    noise = np.random.default_rng(3).integers(33, 127, (200, 6))
    odd = [(500, " ".join("".join(map(chr, x)) for x in noise), "en", None, 0), (501, None, "de", None, 0), (502, prose(80, 7, 4), None, None, 0)]
    out = {r["doc_id"] for r in keep_good(frame(spark, rows + odd)).collect()}
    assert out >= {*range(120)} - {0} and 500 not in out and 501 not in out
    found = {r["id"]: r for r in judged(frame(spark, rows + odd)).collect()}
    assert not found[500]["base_failed"] and not found[500]["kept"] and found[501]["log_perplexity"] is None


def tongue(n, seed, function_words=True, mark=""):
    """Half common short words, half words of syllables."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        common = function_words and rng.random() < 0.5
        out.append(rng.choice(["the", "of", "and", "to", "in", "is"]) if common else "".join(rng.choice(["er", "on", "an", "re", "ti", "nd", "ea", "ou", "st", "en", "at", "ha"]) for _ in range(rng.randint(*((1, 2) if function_words else (2, 4))))))
    return " ".join(w + mark for w in out)


def test_both_sides_of_the_band_reject(spark):
    clean = [(i, tongue(200, i), "en", None, 0) for i in range(150)]
    menus = [(500 + i, tongue(200, 500 + i, False).replace(" ", " | "), "en", None, 0) for i in range(6)]
    signs = [(600 + i, tongue(200, 600 + i, True, "$$$$"), "en", None, 0) for i in range(6)]
    found = {r["id"]: r for r in judged(frame(spark, clean + menus + signs)).collect()}
    assert not any(r["base_failed"] for r in found.values()) and sum(found[i]["kept"] for i in range(150)) >= 148
    assert all(not found[i]["kept"] for i, *_ in menus + signs), [(i, *(round(found[i][f"{c}{x}"], 2) for c in quality.MEASURES for x in ("", "_low", "_high"))) for i in (500, 600)]
    below = [i for i, r in found.items() if any(r[c] < r[f"{c}_low"] for c in quality.MEASURES)]
    above = [i for i, r in found.items() if any(r[c] > r[f"{c}_high"] for c in quality.MEASURES)]
    assert below and above


def test_unspaced_languages_have_a_band(spark):
    """Runs of 110 characters without a space are cut into pieces."""
    clean = [(i, " ".join(tongue(80, 60 * i + k, False).replace(" ", "")[:110] for k in range(60)), "zh", None, 0) for i in range(60)]
    found = judged(frame(spark, clean)).collect()
    assert not any(r["base_failed"] for r in found) and sum(r["kept"] for r in found) >= 58


def test_small_languages_are_judged_together(spark):
    clean = [(10 * k + i, tongue(200, 10 * k + i), f"x{k}", None, 0) for k in range(12) for i in range(6)]
    noise = np.random.default_rng(3).integers(33, 127, (200, 6))
    odd = [(500, " ".join("".join(map(chr, x)) for x in noise), "x3", None, 0), (501, tongue(200, 501, True, "$$$$"), "x4", None, 0)]
    found = {r["id"]: r for r in judged(frame(spark, clean + odd)).collect()}
    assert not any(r["base_failed"] for r in found.values()) and not found[500]["kept"] and not found[501]["kept"]
    assert sum(found[i]["kept"] for i, *_ in clean) >= 70


def test_empty_table(spark, tmp_path):
    assert op3_quality_rules(spark, stored(spark, tmp_path, [])).count() == 0


def test_answers_are_small_and_say_the_same():
    """Counts below 1,024 are exact and mostly leave the high byte 0; of a piece of the model only its units are kept, not its pairs."""
    counts = np.array([0, 1, 2, 5, 255, 256, 1023, 1024, 1025, 5000, 10**6, 10**10])
    got = quality.decoded(quality.code(counts))
    assert (got[counts <= 1024] == counts[counts <= 1024]).all()
    assert (got == np.where(counts > 0, np.rint(np.exp(np.rint(2048 * np.log(np.maximum(counts, 1))) / 2048)), 0)).all()
    assert (quality.code(np.arange(256)) < 256).all()
    rng = np.random.default_rng(5)
    words = mix(np.arange(1, 301, dtype=np.uint64))
    key = np.unique(quality.pair_keys(rng.choice(words, 20_000), rng.choice(words, 20_000)))
    body = quality._packed(quality._gaps(key), np.zeros(len(key), np.uint16), rng.integers(0, 2**16, len(key)).astype(np.uint16))
    kept = dict(quality.modelled([("a", body)]))
    assert len(kept[None]) < len(key) / 4
    unit, contexts, stats = quality._model_part(kept[None])
    assert dict(zip(unit.tolist(), contexts.tolist(), strict=True)) == Counter((key & quality.LOW_WORD).tolist())
    assert stats == [len(key), 0, 0, 0, len(key), len(key)]
    codes = quality._unpacked(kept["a"], *[np.uint16] * 5)[0]
    assert len(codes) == len(key)
    assert (quality.decoded(codes) == 1).all()
