import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import media, quality, secret_scan, textkernel, warc
from lexloom.llm.sharding import ConflictError, ShardStore

from .hard import frame, rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(t):
    out = [(m.start(), m.end(), "assign", 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access", 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[0], x[3]))


def added(t):
    out = []
    for k, (name, alphabet, least, w, bound) in enumerate(secret_scan.CLASSES):
        for m in re.finditer("[" + re.escape(alphabet) + "]{%d,}" % least, t):
            c, cur = m[0], None
            if any(re.search(p, c) for p in secret_scan.ALLOW):
                continue
            for i in range(len(c) - w + 1):
                x = c[i : i + w]
                if -sum(x.count(y) / w * math.log2(x.count(y) / w) for y in set(x)) >= bound - 1e-9:
                    if cur and i <= cur[1]:
                        cur[1] = i + w
                    else:
                        out += [(m.start() + cur[0], m.start() + cur[1], name, 3 + k)] if cur else []
                        cur = [i, i + w]
            out += [(m.start() + cur[0], m.start() + cur[1], name, 3 + k)] if cur else []
    return sorted(out, key=lambda x: (x[0], x[3]))


def redacted(t):
    if t is None:
        return None
    out, at = [], 0
    for a, b, *_ in sorted(base(t) + added(t), key=lambda x: (x[0], x[3])):
        if a >= at:
            out += [t[at:a], "<SECRET>"]
        at = max(at, b)
    return "".join(out) + t[at:]


def test_secret_scan(spark):
    more = [(500, "é API_KEY='A1b2C3d4E5' secret:token:abcdefghijk"), (501, "AKIA12345678901 AKIA123456789012 xAKIAAKIAAAAAAAAAAAA"), (502, "Zk3" * 9 + " q9+/Ab0xK2mQ7rT5vW8yB1cD4eF6gH " + "f" * 33)]
    r = random.Random(3)
    code = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") if k // 90 % 2 else "aab1"[k % 4] for k in range(9000))
    more += [(503, "é " + " ".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(4500))), (504, f"x {code}, {code[:2047]} {code[2048 : 2 * 2048 + 30]}\u00e9" + "f" * 2048 + "0"), (505, "token:abcdefgh1 \U0001f600" * 300)]
    data = rows() + more
    got = secret_scan.scan(frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert [tuple(x) for x in r.base] == base(r.text or ""), r.text
        assert [tuple(x) for x in r.added] == added(r.text or ""), r.text
    out = secret_scan.redact(frame(spark, data))
    assert out.columns == frame(spark).columns
    for r in out.collect():
        assert r.base == "b" and r.added == "a"
        assert not base(r.text or "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, redacted(t)) for i, t in data)
    assert secret_scan.scan(frame(spark, empty=True)).count() == 0


def test_warc(spark):
    data = [(1, "u", "a"), (1, "u", "a"), (2, "v", "a"), (None, None, "a"), (5, "http://x/é y", None), (4, "w", ""), (7, "z", "<p>" + "x" * 300_000), (None, "q", None)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in data], "page_id long, url string, html string, data string, n int")
    got = warc.read_warc(warc.write_warc(pages), with_payload=True).collect()
    assert len(got) == len(data)
    first = {"a": 1, "": 4, data[6][2]: 7}
    assert sorted(r.record_id for r in got if r.record_type == "response") == ["<urn:page:1>", "<urn:page:4>", "<urn:page:7>"]
    for r in got:
        if r.record_type == "response":
            assert r.n == r.stated and f"sha1:{r.sha1}" == r.digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
            assert first[bytes(r.payload).decode()] == int(r.record_id[10:-1])
        else:
            assert r.refers_to in ("<urn:page:1>", "<urn:page:4>") and r.n == 0
    assert warc.read_warc(warc.write_warc(pages.filter("false"))).count() == 0
    small = warc.read_warc(warc.write_warc(pages, revisit_bytes=1)).collect()
    assert Counter(r.record_type for r in small if r.stated == 0) == {"response": 3}


@pytest.mark.parametrize("split", [500, 5000, 1 << 20])
def test_warc_ranges(spark, tmp_path, split):
    inner = b"".join(warc.record(k, "u", "A" * 32, 3, b"abc") for k in range(1000, 1050))
    noise = np.random.default_rng(1).bytes(20_000)
    recs = [warc.record(k, "u", "A" * 32, len(p), p) for k, p in enumerate([b"12345", noise, inner, noise + inner + noise, b"", b"x" * 100_000, b"zz"])]
    data = b"".join(recs)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    got = warc.read_warc(files, split).orderBy("offset").collect()
    assert [r.record_id for r in got] == [warc.record_id(k) for k in range(len(recs))]
    a = len(recs[0]) + 40
    path.write_bytes(data[:a] + b"\0" * 30 + data[a + 30 :])
    assert [r.record_id for r in warc.read_warc(files, split).orderBy("offset").collect()] == [warc.record_id(k) for k in range(len(recs)) if k != 1]


def test_shards(spark, tmp_path):
    df = frame(spark)
    store = ShardStore(spark, f"file://{tmp_path}", df.schema, target_bytes=60_000, tier_bytes=2000, fanout=2)
    assert store.version() == 0 and store.read().count() == 0
    for k in range(5):
        store.append(df.filter(F.coalesce(F.pmod("doc_id", F.lit(5)), F.lit(0)) == k))
    before = store.manifest().count()
    v = store.version()
    store.compact(2)
    assert store.version() > v and store.manifest().count() < before
    assert store.read().exceptAll(df).count() == 0 and df.exceptAll(store.read()).count() == 0
    store.append(df.filter("false"))
    assert store.read().count() == df.count()
    with pytest.raises(ConflictError):
        store._commit(store.version() - 1, store.manifest())


def test_media(spark, tmp_path):
    data = rows()
    got = media.audio_features(media.store_audio(frame(spark))).collect()
    assert len(got) == len(data)
    seen, payloads = {}, Counter()
    for i, t in data:
        b = (t or "").encode()
        payloads[i, len(b), hashlib.sha256(b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == payloads
    for r in got:
        assert seen.setdefault((r.payload_sha256), (r.feature, r.media_sha256, r.tail_crc32)) == (r.feature, r.media_sha256, r.tail_crc32)
        assert r.media_bytes == 44 + r.payload_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes
    r = max(got, key=lambda r: r.n_tensors)
    table = media.read_tensors(r.tensors).slice(r.first_tensor, r.n_tensors)
    assert set(table.column("doc_id").to_pylist()) == {r.doc_id} and table.schema.field("log_mel").type == media.TENSOR
    assert table.column("start_ms").to_pylist() == sorted(table.column("start_ms").to_pylist())
    assert table.column("log_mel").combine_chunks().to_numpy_ndarray().shape == (r.n_tensors, 16, 16)
    assert media.audio_features(media.store_audio(frame(spark, empty=True))).count() == 0
    w = media.wav(b"abc")
    assert len(w) % 2 == 0 and bytes(media.wav_samples(w)[1]) == b"abc"


def test_resampling_is_the_sum():
    x = np.random.default_rng(0).integers(-128, 128, 300)
    h = media.phases()
    n = -(-300 * 5 // 8)
    want = [sum(h[(m * 8) % 5][k] * x[(m * 8) // 5 - k] for k in range(16) if 0 <= (m * 8) // 5 - k < 300) for m in range(n)]
    assert media.resample(x, 0, n).tolist() == want and media.resample(x, 70, 50).tolist() == want[70:120]
    e = np.array([0, 0, 5, 1, 1, -5, 0, 0, 5, 0], float)
    assert media.segments(e) == [(2, 5), (8, 10)]
    tone = lambda f: media.log_mel((128 + 80 * np.sin(2 * np.pi * f * np.arange(8000) / 8000)).astype(np.uint8))[0].mean(0).argmax()
    assert tone(300) < tone(900) < tone(2000)


def test_quality_on_held_out_rows():
    r = duckdb.sql("SELECT d.doc_id, d.text, l.quality FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' l USING (doc_id) ORDER BY doc_id").fetchall()
    held = [x for x in r if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    learn = [x for x in r if zlib.crc32(str(x[0]).encode()) % 5][:800]
    m = quality.fit([(*quality.features(np.frombuffer(t.encode(), np.uint8)), y) for _, t, y in learn])
    s = m.scores(pa.array([t for _, t, _ in held]))
    y = np.array([q for *_, q in held])
    assert ((s >= 0.3) == (y == 1)).mean() > 0.98
    assert (s[:50] == np.array([m.scores(pa.array([t]))[0] for _, t, _ in held[:50]])).all()


def test_quality_frames(spark, monkeypatch):
    df = frame(spark)
    labelled = df.filter("doc_id % 2 = 0").withColumn("label", F.when(F.col("doc_id") > 20, 1).when(F.col("doc_id") > 4, 0))
    m = quality.train(labelled, max_rows=15)
    out = quality.score(df, m).collect()
    assert len(out) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    by = {}
    for r in out:
        assert by.setdefault(r.text or "", r.score) == r.score
    monkeypatch.setattr(quality, "_WINDOW", 64)
    long = {r.text: r.score for r in out if r.text and len(r.text) > 4000}
    assert len(long) == 2 and all(abs(m.scores(pa.array([t]))[0] - s) < 1e-12 for t, s in long.items())
    assert quality.score(frame(spark, empty=True), m, keep=["doc_id"]).count() == 0
    assert quality.train(labelled.filter("false")).table.shape == m.table.shape
    names = "text_ Score_ batch label keep".split()
    wide = spark.createDataFrame([(1, "a b", 0.25, 7, *names), (2, None, 0.5, 8, *names)], "doc_id long, text string, Score double, PREDICTED int, " + ", ".join(f"`{n}` string" for n in names))
    assert quality.score(wide, m).columns == ["doc_id", "text", *names, "score", "predicted"]
    assert sorted(map(tuple, quality.accepted(wide, m, threshold=0.0).collect())) == sorted(map(tuple, wide.collect())) and quality.accepted(wide, m, threshold=1.1).count() == 0


def test_quality_is_fitted_by_a_task_on_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"word{i % 7} and word{i % 3} " * (i % 5), i % 2) for i in range(60)], "doc_id long, text string, label int").repartition(3)
    lowest = df.withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(40).collect()
    fit, driver = quality.fit, os.getpid()
    want = fit([(*quality.features(np.frombuffer(r.text.encode(), np.uint8)), r.label) for r in lowest])

    def away(rows, seed):
        assert os.getpid() != driver, "the driver fits the model, so the sample's features come to it"
        return fit(rows, seed)

    monkeypatch.setattr(quality, "fit", away)
    got = quality.train(df, max_rows=40)
    assert (got.table == want.table).all() and got.bias == want.bias


def naive_score(model, text):
    """Words, repeated words and byte n-grams one by one, averaged, then the two-class softmax."""
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    hashed = lambda w: int(textkernel.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]), lower=False)[0][0])
    buckets = [hashed(w) >> 48 for w in words] + [quality.REPEAT for a, b in zip(words, words[1:]) if a == b]
    for n, odd in quality._GRAMS:
        for i in range(len(data) - n + 1):
            h = int.from_bytes(data[i : i + n], "big") & 0xFFFFFFFF
            buckets.append(((h + n) * odd & 0xFFFFFFFF) >> 16)
    mean = sum(int(model.table[b]) for b in buckets) / (quality._SCALE * max(1, len(buckets)))
    return 1 / (1 + math.exp(-(model.bias + mean)))


def test_quality_is_the_naive_score():
    rng = np.random.default_rng(2)
    m = quality.Model(rng.integers(-(1 << 18), 1 << 18, quality.REPEAT + 1), 0.3)
    texts = [t or "" for _, t in rows()]
    got = m.scores(pa.array(texts))
    assert all(abs(g - naive_score(m, t)) < 1e-9 for g, t in zip(got, texts))


def naive_feature(payload):
    """The samples' resampling sum by sum, every frame's transform and mel bands, and the segments, without blocks."""
    x, h = np.frombuffer(payload, np.uint8).astype(int) - 128, media.phases()
    n = -(-len(x) * 5 // 8)
    frames = max(1, math.ceil((n - 256) / 128) + 1) if n > 256 else 1
    y = [sum(h[(k * 8) % 5][j] * x[(k * 8) // 5 - j] for j in range(16) if 0 <= (k * 8) // 5 - j < len(x)) for k in range(frames * 128 + 256)]
    y = (np.array(y) / (1 << 21)).astype(np.float32)
    bank, w = media.mel_bank(5000), np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / 256) for k in range(256)], np.float32)
    power = [np.abs(np.fft.rfft(y[k * 128 : k * 128 + 256] * w)) ** 2 @ bank for k in range(frames)]
    energy, on, start, segs = [10 * math.log10(p.sum() + 1e-10) for p in power], False, 0, []
    mid = np.median(energy)
    for k, e in enumerate(energy):
        if not on and e > mid + 1.5:
            on, start = True, k
        elif on and e < mid - 1.5:
            on = False
            segs.append((start, k))
    return np.array([10 * np.log10(p + 1e-10) for p in power]), energy, segs + ([(start, frames)] if on else [])


def test_audio_features_are_the_naive_ones():
    r = random.Random(4)
    for size in (64, 640, 2560, 6400):
        payload = bytes(r.choice(b"etaoin shrdlu\n") for _ in range(size - 10)) + b"\0" * 10
        mel, energy = media.log_mel(np.frombuffer(payload, np.uint8))
        want, loud, segs = naive_feature(payload)
        assert mel.shape == want.shape and np.abs(mel - want).max() < 1e-2 and np.abs(energy - loud).max() < 1e-3
        assert media.segments(np.array(energy, float)) == segs


def test_stores_of_audio_are_written_once(spark):
    found = media.audio_features(media.store_audio(frame(spark)))
    assert {r.tensors for r in found.collect()} == {r.tensors for r in found.collect()}


def test_old_readers_strange_paths_and_orphans(spark, tmp_path):
    df = frame(spark)
    store = ShardStore(spark, f"file://{tmp_path}/a store+x", df.schema, target_bytes=60_000, tier_bytes=2000, fanout=2)
    for k in range(4):
        store.append(df.filter(F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0)) == k))
    before, v = store.read(), store.version()
    orphan = tmp_path / "a store+x" / "shards" / "left"
    orphan.mkdir()
    store.compact(2)
    assert before.count() == df.count() and store.read(v).count() == df.count() and store.read().exceptAll(df).count() == 0
    store.vacuum()
    assert orphan.exists() and store.versions()[0] == 1
    store.vacuum(1, older_than=-5)
    assert not orphan.exists() and store.versions() == [store.version()] and store.read().count() == df.count()
