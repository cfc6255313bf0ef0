"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, name string, rid long, class string, comp long, base string, added string, score double, predicted int, path string, part long, length long"


def rows(seed: int = 1, n: int = 40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    texts = [None, "", " \n\t", "one", "one two three four", "ONE two Three four", "a\n b", "x" * 5000, prose(6000), "é́ 漢字 \U0001f600 ▁ a  b\n\n c ."]
    base = prose(120)
    words = base.split(" ")
    texts += [base, base, base + " " + prose(3), " ".join(words[:50] + ["new"] + words[50:]), prose(120)]
    texts += ["token = A1b2C3d4E5f6G7h8 " + prose(8), "key AKIA" + "Q" * 16, "h " + "0f" * 20, "password: short", "<|endoftext|>"]
    texts += [prose(r.randrange(1, 60)) for _ in range(n)]
    out = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (3, "one"), (3, "other"), (None, "one"), (None, None), (None, None), (-5, base), (10, base)]
    return out


def frame(spark, data=None, empty=False):
    data = rows() if data is None else data
    full = [(i, t, "en", "s", len(t or ""), 7, "k", "n", 1, "c", 2, "b", "a", 0.5, 1, "p", 3, 4) for i, t in data]
    df = spark.createDataFrame(full, SCHEMA)
    return (df.filter("false") if empty else df).repartition(3)
