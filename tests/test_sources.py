import io
import random
import zipfile

import pytest

from lexloom.functions import sql
from lexloom.operators.explain import explain, query
from lexloom.plans import mini
from lexloom.plans.dictionary import Dictionary, available, find, load
from lexloom.sources import hzip
from lexloom.sources.documents import read_documents


def test_hzip_round_trip():
    aff, dic = (x.encode() for x in mini.files())
    r = random.Random(1)
    other = b"\n".join(bytes(r.choice([9, 32, 31, 30, 45, 46, 47, 65, 66, 200]) for _ in range(r.randrange(1, 60))) for _ in range(200)) + b"\n"
    for text in (aff, dic, other, b"a\n"):
        assert hzip.decode(hzip.encode(text)) == text
    with pytest.raises(hzip.FormatError):
        hzip.decode(b"hz2abc")
    with pytest.raises(hzip.FormatError):
        hzip.decode(hzip.encode(dic)[:-20])
    with pytest.raises(hzip.FormatError):
        hzip.decode(b"hz1" + hzip.encode(dic)[3:])


def test_finding_and_loading(tmp_path, spark):
    aff, dic = mini.files()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.aff").write_text(aff)
    (tmp_path / "a" / "x.dic").write_text(dic)
    (tmp_path / "a" / "hyph_x.dic").write_text("")
    paths = [str(tmp_path), str(tmp_path / "a")]
    assert available(paths) == ["x"] and find("y", paths) is None
    d = load("x", paths)
    assert d.engine.spell("removed") and Dictionary.load(spark, str(tmp_path / "a/x.aff"), str(tmp_path / "a/x.dic")).version == d.version
    (tmp_path / "a" / "z.aff.hz").write_bytes(hzip.encode(aff.encode()))
    (tmp_path / "a" / "z.dic.hz").write_bytes(hzip.encode(dic.encode()))
    assert Dictionary.open(str(tmp_path / "a/z.aff"), str(tmp_path / "a/z.dic")).words() == d.words()
    with pytest.raises(FileNotFoundError):
        load("nothing", paths)


def test_documents(tmp_path, spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", "<text:p>one</text:p>")
    (tmp_path / "a.odt").write_bytes(z.getvalue())
    (tmp_path / "b.txt").write_bytes(b"t\xffxt")
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.text) for r in read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.odt": ("odf", "<text:p>one</text:p>"), "b.txt": ("text", "t�xt")}


def test_sql_functions(spark):
    names = sql.register(spark, mini.dictionary(), "mini_")
    assert "mini_tokenize" in names
    r = spark.sql("SELECT mini_spell('moved') AS a, mini_spell('movd') AS b, mini_root('moved') AS c, mini_stem('moved') AS d, mini_suggest('oen') AS e, mini_spell(CAST(NULL AS STRING)) AS f").first()
    assert (r.a, r.b, r.c, r.d, r.f) == (True, False, "move", ["move"], None) and "one" in r.e
    assert [x.word for x in spark.sql("SELECT * FROM mini_tokenize('<p>one two</p>', 'html')").collect()] == ["one", "two"]


def test_explain_and_queries():
    e = mini.dictionary().engine
    lines = [x for _, x in explain(e, "Removed")]
    assert lines[0] == 'word "Removed"' and lines[-1] == "result correct root=move" and any('entry "move"' in x for x in lines)
    assert explain(e, "zzz")[-1][1] == "result incorrect"
    assert query(e, "<query type='stem'><word>moved</word></query>") == ["move"]
    assert query(e, "<query type='generate'><word>ate</word><word>moved</word></query>") == ["ated"]
    assert query(e, "<query type='analyze'><word>zzz</word></query>") == [] and query(e, "<query>") == []
    assert query(e, "<query type='analyze'><word>moved</word></query>")[0].startswith("<code><a>")
    with pytest.raises(ValueError):
        query(e, "<query type='add'><word>a</word></query>")


def test_streams(spark, tmp_path):
    from lexloom.streaming.checking import check_stream, wrong_per_window

    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "one onee"), (2, "moved"), (3, None)], "doc_id long, text string")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    check_stream(stream, mini.dictionary(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.doc_id, r.word) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "onee")]
    events = df.selectExpr("timestamp'2026-01-01 00:10:00' AS ts", "text")
    known = spark.createDataFrame([("one",), ("moved",)], "form string")
    r = wrong_per_window(events, known, "ts", "text").first()
    assert (r.n_words, r.n_unknown) == (3, 1)
