"""DataFrame operators against the single-word engine and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.casing import Case, init_col, kind_col, lower_col, upper_col
from lexloom.functions.similar import ANY_MISMATCH, LONGER_WORSE, ngram_score, ngram_score_col, osa_col, osa_distance
from lexloom.operators import frames, texts
from lexloom.plans import mini
from lexloom.plans.dictionary import Dictionary
from lexloom.plans.relational import Plan, check


def some_words(n=400, seed=1):
    r = random.Random(seed)
    e = mini.dictionary().engine
    base = [f for w in e.listed() for f in e.expand(w)]
    out = {"", ".", "1,5", "one.", "ONE...", "Paris", "PARIS", "paris", "one-ate", "x" * 400, "Eau", "éaU"}
    while len(out) < n:
        w = list(r.choice(base))
        k = r.randrange(6)
        i = r.randrange(len(w))
        if k == 0:
            w[i] = r.choice("abcé")
        elif k == 1:
            del w[i]
        elif k == 2:
            w.insert(i, r.choice("etan"))
        w = "".join(w)
        out.add(r.choice([w, w.upper(), w.capitalize(), w + ".", f"{w}-{r.choice(base)}"]))
    return sorted(out)


def test_joins_say_what_the_engine_says(spark):
    d = mini.dictionary()
    assert d.has_simple_rules
    words = some_words()
    df = spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "w string")
    got = {r.word: (r.correct, r.root) for r in check(df, d).collect()}
    want = {w: d.engine.check(w) for w in words}
    assert set(got) == set(words)
    assert {w: got[w][0] for w in words} == {w: want[w].correct for w in words}


def test_hidden_capitals_by_joins(spark):
    d = Dictionary.parse("SET UTF-8\nSFX S Y 1\nSFX S 0 s .\nPFX U Y 1\nPFX U 0 un .\n", "4\nOpenOffice/SU\nUNO/S\nMcDonald\nnasa\n")
    assert d.has_simple_rules
    base = ["OpenOffice", "UNO", "McDonald", "nasa", "OpenOffices", "unOpenOffice", "UNOs"]
    words = sorted({f(w) for w in base for f in (str, str.upper, str.lower, str.capitalize, lambda x: x + ".", lambda x: x[0].upper() + x[1:])})
    got = {r.word: (r.correct, r.root) for r in check(spark.createDataFrame([(w,) for w in words], "w string"), d).collect()}
    want = {w: (lambda r: (r.correct, r.root))(d.engine.check(w)) for w in words}
    assert {w: got[w][0] for w in words} == {w: want[w][0] for w in words}


def test_analyses_by_joins(spark):
    d = mini.dictionary()
    words = [w for w in some_words(200, 2) if w and "." not in w and "-" not in w and len(w) < 50]
    got = {}
    for r in Plan(spark, d).analyses(spark.createDataFrame([(w,) for w in words], "w string")).collect():
        got.setdefault(r.word, set()).add(r.analysis)
    case = d.engine.case
    for w in words:
        if case.kind(w) in (0, 1, 2):
            want = {a for a in d.engine.analyze(w) if not a.startswith("re") and not a.startswith("un")}
            assert got.get(w, set()) == want, w


def test_expand_by_joins(spark):
    d = mini.dictionary()
    got = {(r.stem, r.form) for r in Plan(spark, d).expand().collect()}
    assert got == {(w, f) for w in d.engine.listed() for f in d.engine.expand(w)}


def test_answers_and_nulls(spark):
    d = Dictionary.parse("SET UTF-8\nCOMPOUNDFLAG C\nSFX S Y 1\nSFX S 0 s .\n", "2\nfoo/CS\nbar/C\n")
    df = spark.createDataFrame([(1, "foobar"), (2, "foos"), (3, "fo"), (4, None), (5, "foos")], "id long, w string")
    got = {r.id: r for r in frames.with_answers(df, "w", d, "check").collect()}
    assert len(got) == 5 and got[1].compound and got[2].root == "foo" and got[3].correct is False and got[4].correct is None
    assert frames.ask(df.filter("false").select("w"), d, "suggest").count() == 0
    assert {r.w: r.forms for r in frames.ask(df.select("w").filter("id = 1"), d, "expand").collect()} == {"foobar": []}


def test_several_dictionaries(spark):
    a, b = (Dictionary.parse("SET UTF-8\n", f"1\n{w}\n") for w in ("one", "two"))
    df = spark.createDataFrame([("one",), ("two",), ("six",), (None,)], "w string")
    assert {r.w: (r.correct, r.dictionary) for r in frames.check_any(df, [a, b]).collect()} == {"one": (True, 0), "two": (True, 1), "six": (False, None)}


def test_case_columns(spark):
    words = ["word", "Word", "WORD", "wOrd", "WoRd", "", "été", "ÉTÉ", "ß", "123", "İx", "I"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    names = ["none", "init", "all", "mixed", "mixed_init"]
    for lang in ("", "tr"):
        c = Case(lang)
        for r in df.select("w", kind_col(F.col("w"), c.turkic).alias("k"), lower_col(F.col("w"), c.turkic).alias("l"), upper_col(F.col("w"), c.turkic).alias("u"), init_col(F.col("w"), c.turkic).alias("i")).collect():
            assert (r.k, r.l, r.u, r.i) == (names[c.kind(r.w)], c.lower(r.w), c.upper(r.w), c.init(r.w))


def test_similarity_columns(spark):
    r = random.Random(5)
    rows = [("".join(r.choice("abc") for _ in range(r.randrange(0, 6))), "".join(r.choice("abc") for _ in range(r.randrange(0, 6)))) for _ in range(150)] + [("ca", "abc"), ("ab", "ba")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", osa_col(F.col("a"), F.col("b")).alias("d"), ngram_score_col(3, F.col("a"), F.col("b"), LONGER_WORSE).alias("x"), ngram_score_col(2, F.col("a"), F.col("b"), ANY_MISMATCH).alias("y")).collect()
    for q in got:
        assert (q.d, q.x, q.y) == (osa_distance(q.a, q.b), ngram_score(3, q.a, q.b, LONGER_WORSE), ngram_score(2, q.a, q.b, ANY_MISMATCH)), q


def test_overlay(spark):
    lines = spark.createDataFrame([("# names",), ("sawyer",), ("*one",), ("",)], "value string")
    lists = frames.word_list(lines, True)
    words = spark.createDataFrame([(w,) for w in ["sawyer", "Sawyer", "SAWYER", "sAwyer", "one", "One", "zz", "ate"]], "w string")
    verdict = check(words, mini.dictionary()).select(F.col("word").alias("w"), "correct")
    got = {r.w: r.correct for r in frames.overlay(words, lists, verdict).collect()}
    assert got == {"sawyer": True, "Sawyer": True, "SAWYER": True, "sAwyer": False, "one": False, "One": True, "zz": False, "ate": True}
    near = frames.close_words(spark.createDataFrame([("sawyre",), ("sawer",), ("x",)], "w string"), lists).collect()
    assert {(r.w, r.suggestion, r.distance) for r in near} == {("sawyre", "sawyer", 1), ("sawer", "sawyer", 1)}
    words = {r.word for r in frames.list_from_lexicon(spark.createDataFrame([("2",), ("cat/S",), ("a\\/b/X po:x",)], "value string")).collect()}
    assert words == {"cat", "a/b"}


@pytest.mark.parametrize("partitions", [1, 5])
def test_texts(spark, partitions):
    docs = spark.createDataFrame([(1, "Ane one.\nonne moved"), (2, "the"), (3, None), (4, "")], "id long, text string").repartition(partitions)
    d = mini.dictionary()
    wrong = texts.misspellings(docs, d, "id", "text", suggest=True)
    got = sorted((r.id, r.word, r.offset, r.line, r.column) for r in wrong.collect())
    assert got == [(1, "Ane", 0, 1, 0), (1, "onne", 9, 2, 0)]
    assert [(r.word, r.place) for r in texts.wrong_words(wrong, "id").orderBy("place").collect()] == [("Ane", 1), ("onne", 2)]
    assert {(r.id, r.line) for r in texts.bad_lines(docs, wrong, "id", "text").collect()} == {(1, 1), (1, 2)}
    fixed = {r.id: r for r in texts.correct(docs, d, "id", "text").collect()}
    assert fixed[2].text == "the" and fixed[3].text is None and fixed[1].changes == 2
    assert all(d.engine.spell(w) for line in fixed[1].text.split("\n") for w in line.rstrip(".").split(" "))
    checked = frames.ask(spark.createDataFrame([("one",), ("moved",)], "word string"), d, "check")
    assert {r.answer[:1] for r in texts.pipe_lines(wrong, checked, "id").collect()} <= set("*+-&#")


def test_break_by_joins(spark):
    d = mini.dictionary()
    words = spark.createDataFrame([("one-ate",), ("one-xx",), ("one-ate-move",), ("xx",)], "word string")
    assert {r.word for r in Plan(spark, d).broken(words, ["-"]).collect()} == {"one-ate", "one-ate-move"}


def test_answers_and_corrections_keep_words_not_tokens(spark, monkeypatch):
    """What is kept between steps grows with the distinct words; it was a row a token, more than the documents themselves."""
    docs = spark.createDataFrame([(k, "Ane one.\nonne moved http://onne/ é onne " * 20) for k in range(5)], "id long, text string")
    d, sizes, kept = mini.dictionary(), [], texts.kept
    want = {(r.word, r.column, tuple(r.suggestions)) for r in texts.misspellings(docs, d, "id", "text", suggest=True).groupBy("word").agg(F.min("column").alias("column"), F.first("suggestions").alias("suggestions")).collect()}
    monkeypatch.setattr(texts, "kept", lambda df: (sizes.append(df.count()), kept(df))[1])
    assert {(r.word, r.column, tuple(r.suggestions)) for r in texts.distinct_misspellings(docs, d, "id", "text").collect()} == want and want
    fixed = texts.correct(docs, d, "id", "text").collect()
    assert {r.changes for r in fixed} == {60} and all("onne" not in r.text.replace("http://onne/", "") for r in fixed)
    assert max(sizes) <= 5
