"""The pipeline against the operators one by one, and its stages on hard rows."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as C

from .hard import frame, rows
from .test_exact_and_near import brute
from .test_others import redacted

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_and_registration():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_|pipeline", q)]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names


def test_run_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {r.doc_id: r.text for r in C.quality_classifier(spark, docs, SF).collect()}
    assert 0 < len(accepted) <= docs.count() and len({t for t in accepted.values()}) > 1
    unique = {}
    for i, t in sorted(accepted.items()):
        unique[t] = i
    data = [(i, t) for t, i in unique.items()]
    kept = {c for _, n, c in brute(data)[0]}
    got = C.run(spark, SF).collect()
    assert {r.doc_id for r in got} == kept
    texts = {i: t for t, i in unique.items() if i in kept}
    tokenizer, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), set()
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(redacted(t), add_special_tokens=False).ids + [2], "<u4")
        n = len(ids)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
        want |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024
    marked = {r.doc_id: r.text for r in C.secret_scans(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF).collect()}
    assert marked == {i: redacted(t) for i, t in texts.items()}


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_take_hard_rows(spark, stage):
    df = frame(spark)
    out = stage(spark, df, SF)
    if stage is not C.best_fit_packing:
        assert out.columns == df.columns
        assert not Counter((r.doc_id, r.source) for r in out.collect()) - Counter((i, "s") for i, _ in rows())
    assert stage(spark, frame(spark, empty=True), SF).count() == 0
