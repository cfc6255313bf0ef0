from lexloom.functions.tokens import format_of, replace_tokens, tokenize, words_col


def words(text, fmt="text", chars="", urls=False):
    return [t.word for t in tokenize(text, fmt, chars, urls)]


def test_places():
    t = tokenize("The été,\nsome texxt", "text")
    assert [(x.word, x.offset, x.line, x.column) for x in t] == [("The", 0, 1, 0), ("été", 4, 1, 4), ("some", 11, 2, 0), ("texxt", 16, 2, 5)]


def test_urls_and_paths_are_skipped():
    text = "see http://ab.cd/ef or me@mail.com or /usr/bin now: C:\\x"
    assert words(text) == ["see", "or", "or", "now"]
    assert "http" in words(text, urls=True)


def test_apostrophes():
    assert words("it's dog’s 'q'") == ["it", "s", "dog", "s", "q"]
    assert words("it's dog’s", chars="'") == ["it's", "dog’s"]


def test_markup():
    assert words('<p>one<!-- two --> <script>x()</script><img alt="three" src="four"> &amp; caf&eacute; voil&agrave;</p>', "html") == ["one", "three", "caf", "voil&agrave;"]
    assert words("<a b='c'>one</a>", "xml") == ["one"]
    assert words("<text:p>hel<text:span a='1'>lo</text:span> x</text:p>", "odf") == ["hello", "x"]
    assert words(".SH NAME foo\n.B bar\nsome \\fBbold\\fR", "man") == ["NAME", "foo", "bar", "some", "bold"]
    assert words("one\ttwo\nthree", "first") == ["one"]


def test_latex():
    t = tokenize(r"\section{Intro} Some $x+y$ text \emph{here} % no" + "\n" + r"\label{no} \begin{verbatim} no" + "\n" + r"\end{verbatim} yes", "latex")
    assert [(x.line, x.column, x.word) for x in t] == [(1, 9, "Intro"), (1, 16, "Some"), (1, 27, "text"), (1, 38, "here"), (3, 15, "yes")]


def test_replacing():
    text = "teh é teh"
    t = tokenize(text)
    assert replace_tokens(text, [(t[0], "the"), (t[2], "<the>")]) == "the é <the>"
    assert replace_tokens(text, [(t[0], "a'b&")], markup=True) == "a&apos;b&amp; é teh"
    assert format_of("x.tex") == "latex" and format_of("ls.1") == "man" and format_of("a") == "text"


def test_columns_agree_with_the_tokenizer(spark):
    texts = ["The été,\nsome texxt a1b", "", "a’b 'c' d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(words_col(df.t, "'")).collect()] == [words(t, chars="'", urls=True) for t in texts]


def test_words_and_places_are_those_of_tokens():
    import random

    import numpy as np

    from lexloom.functions.tokens import found_words, places, tokenize

    r = random.Random(1)
    for _ in range(800):
        x = "".join(r.choice("abÉé́ \n\r/@:\\.&;'’-_1\U0001f600") if r.random() < 0.9 else r.choice(["http://a.b", "&eacute;", "a@b"]) for _ in range(r.randrange(50)))
        found = found_words(x)
        at = places(x, np.array([i for i, _ in found], np.int64))
        assert [(w, *map(int, p)) for (_, w), *p in zip(found, *at)] == [(t.word, t.offset, t.line, t.column) for t in tokenize(x)]
