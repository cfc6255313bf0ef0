"""Every query runs on the smallest tables and agrees with its SQL twin."""

import os

import pytest

from lexloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    assert len(got) > 0
    if sql:
        want = duck.sql(sql).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
        assert a.values.tolist() == b.values.tolist()


@pytest.mark.parametrize("name", ["suggestions", "corrected_texts", "answer_lines", "close_list_words", "stems_by_engine", "generated_forms"])
def test_costly_queries_read_all_documents(spark, tmp_path, name):
    spark.createDataFrame([(0, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(k, t, "en", "s", len(t)) for k, t in enumerate(["one sawyr", "moev onse", "moved lnie"])]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    if name == "corrected_texts":
        assert {r.doc_id: r.changes for r in got} == {0: 0, 1: 2, 2: 1}  # sawyr has no suggestions
    elif name == "answer_lines":
        wrong = {r.answer.split(" ")[1] for r in got if r.answer[0] in "&#"}
        assert wrong == {"sawyr", "moev", "onse", "lnie"}
    else:
        want = {"suggestions": {"sawyr", "moev", "onse", "lnie"}, "close_list_words": {"sawyr"}}
        assert {r.word for r in got} == want.get(name, {"one", "sawyr", "moev", "onse", "moved", "lnie"})
