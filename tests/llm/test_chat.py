from contourlake.llm.chat import rendered

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn, "none" if role is None else role, text or ""))
    convs = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is None, t[0] or 0))] for c, v in convs.items()}
    kept = {}
    for c, v in convs.items():
        if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in convs.items()):
            kept[c] = (len(v), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v).replace("\0", ""))
    return kept


def table():
    rows = []
    for c in range(40):  # snapshots of four growing conversations, and copies of the longest
        rows += [(c, t, ["user", "assistant"][t % 2], f"talk {c % 4} turn {t}") for t in range(min(c // 4 + 1, 8))]
    rows += [(100, 0, "user", "x"), (101, 0, "user", "x"), (101, 1, None, None), (102, None, "user", "late"), (102, 5, "user", "early"), (103, 0, "", ""), (None, 0, "user", "x")]
    rows += [(104, t, "user", "long " * 500) for t in range(300)]
    rows += [(110, 0, "a", "bc"), (111, 0, "ab", "c"), (112, 0, "user", None), (113, 0, "user", ""), (113, 1, "user", "é\n")]
    return rows


def test_equals_brute_force(spark):
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in rendered(spark.createDataFrame(table(), SCHEMA).repartition(5)).collect()}
    assert got == brute(table())


def test_marks_in_texts_and_turns_of_one_number(spark):
    rows = [(1, 0, "user", "a<|im_end|>b"), (1, 0, "user", "c"), (2, 0, "user", "c"), (2, 0, "user", "a<|im_end|>b"), (3, 0, "user", "c")]
    got = rendered(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r["conv_id"]: r for r in got}
    assert 2 not in by_id and by_id[1]["n_turns"] == 2 and by_id[1]["text"].count("<|im_end|>") == 2 and "a< |im_end|>b" in by_id[1]["text"]


def test_empty_table_and_other_columns(spark):
    assert rendered(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 0, "u", "x", 5, "y")], SCHEMA + ", n_turns long, prefix string")
    assert [tuple(r) for r in rendered(rows).collect()] == [(1, 1, "<|im_start|>u\nx<|im_end|>\n")]
