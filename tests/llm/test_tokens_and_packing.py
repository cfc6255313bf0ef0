import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexloom.llm import token_ids as T
from lexloom.llm.packing import pack, plan
from lexloom.llm.spm_nbest import SPACE, encode_n_best, lattice
from lexloom.llm.tokenizing import encoder

from .hard import frame, rows

BYTE, WORD, PIECE = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcxyzABC'.,!7éÉ́ßΣσςİ漢\n\t  ▁<|>")) | st.characters(codec="utf-8"), max_size=60))
def test_ids_are_the_librarys(text):
    for path, spaced in ((BYTE, True), (WORD, False)):
        e = encoder(path, spaced)
        assert e.encode([text, "a", text]) == [e.plain(text), e.plain("a"), e.plain(text)]


LINE_ENDS = ["a \nb", "a \n", "a \n\nb", "line one \nline two", "- item \n- item", "x a \nb, \nc!", "a  \nb \n c"]


@pytest.mark.parametrize("text", LINE_ENDS)
def test_a_space_before_a_line_end_keeps_its_id(text):
    for path, spaced in ((BYTE, True), (WORD, False)):
        e = encoder(path, spaced)
        assert e.encode([text]) == [e.plain(text)]


def test_packing_of_spaces_before_line_ends(spark):
    t = Tokenizer.from_file(BYTE)
    got = pack(frame(spark, list(enumerate(LINE_ENDS))), BYTE, with_ids=True).collect()
    want = {(i, len(ids_of(t, x)), zlib.crc32(ids_of(t, x).tobytes())) for i, x in enumerate(LINE_ENDS)}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == want


CAPITALS = ["<|ENDOFTEXT|>", "A <|EndOfText|> B", "<|startOFtext|>!", "One <|endoftext|> TWO<|Endoftext|>", "J\u030c", "x T\u0308y", "H\u0331", "J\u0323\u030c", "T\u0344", "Y\u030a W\u030a"]


@pytest.mark.parametrize("text", CAPITALS)
def test_capitals_of_special_tokens_and_marked_letters(text):
    e = encoder(WORD, False)
    assert e.encode([text]) == [e.plain(text)]


def test_token_files_of_capitals(spark):
    t = Tokenizer.from_file(WORD)
    got = T.read_token_ids(T.write_token_ids(frame(spark, list(enumerate(CAPITALS))), WORD)).collect()
    want = {(i, len(ids_of(t, x)), zlib.crc32(ids_of(t, x).tobytes())) for i, x in enumerate(CAPITALS)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want


def test_packing(spark):
    t = Tokenizer.from_file(BYTE)
    data = rows()
    got = pack(frame(spark), BYTE, with_ids=True).collect()
    want = Counter()
    for i, text in data:
        ids = ids_of(t, text)
        n = len(ids)
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 1024) + 1
    assert pack(frame(spark, empty=True), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_plan_places_every_length_once(histogram):
    room, taken = {}, Counter()
    for length, lo, n, seq, offset in plan(histogram, 64):
        taken[length] += n
        for s in range(seq, seq + n):
            room.setdefault(s, []).append((offset, length))
    assert taken == Counter(histogram)
    for pieces in room.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(room) == list(range(len(room)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(1, 100))
def test_blocks_round_trip(values, percentile):
    v = np.array(values, np.uint32)
    data = T.encode_chunk(v, percentile)
    assert (T.decode_chunk(data) == v).all()
    for k in range(-(-len(v) // T.BLOCK)):
        assert (T.decode_block(data, k) == v[k * T.BLOCK : (k + 1) * T.BLOCK]).all()


def test_token_files(spark, tmp_path):
    t = Tokenizer.from_file(WORD)
    data = rows()
    got = T.read_token_ids(T.write_token_ids(frame(spark), WORD)).collect()
    want = Counter((i, len(ids_of(t, x)), zlib.crc32(ids_of(t, x).tobytes())) for i, x in data)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert T.write_token_ids(frame(spark, empty=True), WORD).count() == 0
    assert T.read_token_ids(T.write_token_ids(frame(spark, empty=True), WORD)).count() == 0
    w = T.Writer(str(tmp_path))
    long = np.arange(3_000_000, dtype="<u4").tobytes()
    w.add(None, long)
    uri, _, _ = w.close()
    assert [x for y in T.read_file(uri) for x in y] == [(None, 3_000_000, zlib.crc32(long))]


def paths(m, text):
    t = SPACE + text.replace(" ", SPACE) if text else ""
    out = []

    def go(i, s, ids):
        if i == len(t):
            out.append((s, ids))
            return
        for j, x, c in m.edges(t, i):
            go(j, s + c, ids + x)

    go(0, 0.0, b"")
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("theinga. \n,é漢▁x!")), max_size=9), st.integers(1, 5))
def test_n_best_is_brute_force(text, n):
    m = lattice(PIECE)
    got, every = m.encode([text], n)[0], paths(m, text)
    scores = dict((i, s) for s, i in every)
    assert [s for s, _ in got] == [s for s, _ in every[:n]]
    assert len({i for _, i in got}) == len(got)
    for s, i in got:
        assert scores[i] == s and m.decode(i) == text.replace(SPACE, " ")


def test_n_best_of_documents(spark):
    got = encode_n_best(frame(spark), PIECE, whole=True).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.n_best == len(r.segmentations) and len(r.segmentations[0]) == r.n_pieces
        assert [float(x) for x in r.scores.split(",")] == sorted((float(x) for x in r.scores.split(",")), reverse=True)
    bad = Counter(r.same_text for r in got)
    assert bad[False] == sum(SPACE in (t or "") for _, t in rows())
    assert encode_n_best(frame(spark, empty=True), PIECE).count() == 0


@pytest.mark.parametrize("text", ["", "a", "  a", "a  b ", "\n\n", "a\nb \nc"])
def test_spaces(text):
    m = lattice(PIECE)
    assert m.decode(m.encode([text])[0][0][1]) == text


POOLS = ["ab c\n \t.,x", " \n\r\t|-*#>`abcXYZ'’s0129", "İıſŉĳﬁǅßẞ aIi!\n.̇̈", "àéîõüñçÅØÞ aE \n.", "áëH̱T̈ Y̊\n", "😀👍🏽 ‍ab\n", "中文字 かな 한글 ab\n.", "ΑΣς σΩ Ӂ\n'"]


def test_random_texts_of_many_kinds():
    """Spaces before line ends, tables, Latin-1, dotted and long letters, combining marks, emoji: ids as the library gives them."""
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice(rng.choice(POOLS) if rng.random() < 0.1 else pool) for _ in range(rng.randrange(1, 25))) for pool in POOLS for _ in range(5000)]
    texts += ["İ!", "x İ? y", "first line \nsecond line", "x. \n", "} \n", "| a | b | \n| c |", "a\r\n b \r\n"]
    for path, spaced in ((BYTE, True), (WORD, False)):
        e = encoder(path, spaced)
        want = [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert e.encode(texts) == want
