"""The registered queries over whole tables: against SQL where there is some, else against brute force."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lexloom.llm import queries as Q

from .test_exact_and_near import brute
from .test_others import added, base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def run(spark, name):
    return Q.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql_twins(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (sorted((tuple(r) for r in rows), key=repr) for rows in (got.select(cols).collect(), want.select(*cols).fetchall()))
    assert a == b


def test_warc(spark):
    pages = duckdb.sql(f"SELECT page_id, coalesce(html, '') FROM '{SF}/pages.parquet' ORDER BY 1").fetchall()
    first, want = {}, {}
    for i, t in pages:
        first.setdefault(t, i)
        d = t.encode()
        want[i] = (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first[t] == i else "revisit", None if first[t] == i else first[t])
    got = run(spark, "op1_warc")
    assert len(got) == len(want) and {r.page_id: tuple(r)[1:] for r in got} == want


def test_near(spark, docs):
    got = run(spark, "op3_ngram_jaccard")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(brute(list(docs.items()))[0]) and len(got) == len(docs)


def test_audio(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op4_audio")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        b = t.encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44)


def test_token_queries(spark, docs):
    t6, t7 = (Tokenizer.from_file(P.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {i: np.array(t6.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in docs.items()}
    got = run(spark, "op6_best_fit_packing")
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.offset + r.length <= 1024
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    at, want = 0, []
    for i in sorted(docs):
        x = np.array(t7.encode(docs[i], add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in run(spark, "op7_token_ids")) == want


def test_sentencepiece_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op8_sentencepiece")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i].same_text and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[i].n_best >= 1


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op9_secret_scan")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        b = base(t)
        text = ",".join(f"{k}:{x}:{y}" for x, y, k, _ in b)
        every = sorted(b + added(t), key=lambda x: (x[0], x[3]))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in b) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == ",".join(f"{k}:{x}:{y}" for x, y, k, _ in every)


def test_quality_query(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op10_quality")}
    assert set(got) == set(docs)
    same = {}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        assert same.setdefault(docs[i], r.score) == r.score
