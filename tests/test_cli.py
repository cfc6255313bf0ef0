from lexloom.__main__ import run
from lexloom.operators import texts
from lexloom.plans import mini

TEXT = "One onne.\nmoved\nonne ate"


def test_modes():
    d = mini.dictionary()
    assert run(d, "-l", TEXT, "text") == ["onne", "onne"] and run(d, "-G", TEXT, "text") == ["One", "moved", "ate"]
    assert run(d, "-L", TEXT, "text") == ["One onne.", "onne ate"] and run(d, "-w", TEXT, "text") == ["onne ate"]
    assert run(d, "-U", TEXT, "text")[1] == "moved" and "onne" not in " ".join(run(d, "-U", TEXT, "text"))
    assert run(d, "-u2", TEXT, "text")[0].startswith("1s/onne/") and run(d, "-u3", TEXT, "text", name="f")[1].startswith("f:3: onne -> ")
    answers = run(d, "", TEXT, "text")
    assert answers[0] == "*" and answers[1].startswith("& onne ") and answers[2] == "+ move"
    assert run(d, "-s", "moved", "text") == ["moved move"] and "st:move" in run(d, "-m", "moved", "text")[0]
    assert set(run(d, "-S", "move", "text")) >= {"moves", "moved"} and run(d, "--trace", "moved", "text")[-1] == "  result correct root=move"


def test_lines(spark, tmp_path):
    d = mini.dictionary()
    docs = spark.createDataFrame([(1, TEXT)], "id long, text string")
    wrong = texts.misspellings(docs, d, "id", "text")
    assert [r.line for r in texts.first_word_lines(docs, wrong, "id", "text").collect()] == [3]
    assert sorted(r.line for r in texts.first_word_lines(docs, wrong, "id", "text", good=True).collect()) == [1, 2]
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "<!--"), (1, 3, "--> one"), (2, 1, None)], "id long, n int, t string")
    got = {r.id: r.text for r in texts.from_lines(lines, "id", "n", "t").collect()}
    assert got == {1: "<!--\nb\n--> one", 2: ""}
    texts.save_personal(spark.createDataFrame([("x",), (None,)], "w string"), str(tmp_path / "p"))
    texts.save_personal(spark.createDataFrame([("y",)], "w string"), str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ["x", "y"]
    changed = texts.change_morphology(spark.createDataFrame([(1, "moved one ate")], "id long, text string"), d, "id", "text", "used", "using")
    assert changed.first().text == "moving one ate"
