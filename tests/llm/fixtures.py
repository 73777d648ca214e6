"""Small tables with every awkward case, and brute-force helpers."""

import os
import random
import re
import shutil

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghijklmnop") + rng.choice(["en", "ou", "é", "ñi", "st"]) + str(rng.randrange(vocabulary)) for _ in range(n))


def edited(text, seed, changes):
    words, rng = text.split(" "), random.Random(seed)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    """Copies, near copies, shared passages, empty, null, white space only, short and long texts, repeated rows."""
    base, passage = prose(160, 1), prose(70, 2)
    texts = [base, base, edited(base, 3, 1), edited(base, 4, 3), edited(base, 5, 9), "", None, " \n\t ", "one", "one two", "one two three", "one\x0btwo\x0cthree four", prose(120, 6) + "\n" + passage + "\n" + prose(90, 7), passage, prose(30, 8) + " " + passage, passage.upper(), "naïve word   \u0085 x" * 30, "same " * 200, "same " * 300, prose(6000, 9), prose(49, 10), prose(49, 10), prose(50, 11), prose(50, 11), "line a b c d e f\nline a b c d e f\n" * 20, "ping pong " * 100, "x ping pong " + "ping pong " * 90 + "y", "ping pong " * 60 + "z"]
    rows = [(i * 3 + 1, t, ["en", "fr", None][i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None), (None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def stored(spark, tmp_path, rows=None):
    """A folder with ``documents.parquet``, as queries read it."""
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def forgetful(answers, step):
    """``ranges.answers`` that loses the answers of every ``step``-th segment afterwards."""

    def lost(asked, of):
        root = answers(asked, of)
        path = root.removeprefix("file://")
        for name in sorted(x for x in os.listdir(path) if x.startswith("seg="))[::step]:
            shutil.rmtree(f"{path}/{name}")
        return root

    return lost
