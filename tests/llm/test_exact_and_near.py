import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lexloom.llm import ngram_jaccard
from lexloom.llm.components import components
from lexloom.llm.exact_dedup import exact_dedup, keep_one
from lexloom.llm.scratch import Scratch

from .hard import frame, rows


@pytest.mark.parametrize("block,bits", [(8192, 64), (16, 64), (16, 3)])
def test_exact_dedup(spark, block, bits):
    data = rows()
    got = exact_dedup(frame(spark), block_bytes=block, hash_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data
    )
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup(frame(spark, empty=True)).count() == 0


def test_keep_one_keeps_columns_and_one_row(spark):
    df = frame(spark)
    out = keep_one(df)
    assert out.columns == df.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({t or "": 1 for _, t in rows()})
    assert keep_one(frame(spark, empty=True)).count() == 0


def brute(data):
    low = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
    sets = []
    for _, t in data:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(low))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    found = Counter((i, len(sets[k]), i if not sets[k] else least.get(top(k))) for k, (i, _) in enumerate(data))
    return found, len({top(k) for k in range(len(data))})


def family(seed, n, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(50)}"
        out.append(" ".join(w))
    return out


def thue_morse(n):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("chunk,sent,small,hot", [(1024, 64, 64, 1 << 18), (3, 2, 2, 5), (512, 32, 4, 9)])
def test_near_groups(spark, monkeypatch, chunk, sent, small, hot):
    monkeypatch.setattr(ngram_jaccard, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ngram_jaccard, "SENT", sent)
    monkeypatch.setattr(ngram_jaccard, "SMALL", small)
    monkeypatch.setattr(ngram_jaccard, "HOT_ROWS", hot)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = family(1, 40, 60, 4) + family(2, 30, 25, 2) + [f"{passage} {t}" for t in family(3, 30, 12, 3)]
    texts += [*thue_morse(10), "one " * 4 + thue_morse(9)[0], "one " * 4 + thue_morse(9)[1]]
    data = rows() + [(1000 + k, t) for k, t in enumerate(texts)]
    got = ngram_jaccard.near_groups(frame(spark, data)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data)[0]
    assert ngram_jaccard.near_groups(frame(spark, empty=True)).count() == 0
    assert ngram_jaccard.near_groups(frame(spark, [(1, None), (2, " ")])).count() == 2


def test_every_overlap_is_a_product():
    r = random.Random(5)
    for _ in range(60):
        lists = [ngram_jaccard.np.array(sorted(r.sample(range(60), r.randrange(0, 30))), "int64") for _ in range(r.randrange(2, 30))]
        want = {(i, j): len(set(lists[i].tolist()) & set(lists[j].tolist())) for i in range(len(lists)) for j in range(i)}
        cut = r.randrange(60)
        total, early = ngram_jaccard._product(lists, cut)
        assert all(total[i, j] == n for (i, j), n in want.items())
        assert all(early[i, j] == sum(x < cut for x in set(lists[i].tolist()) & set(lists[j].tolist())) for i, j in want)
        some = r.sample(sorted(want), r.randrange(1, len(want) + 1))
        i, j = (ngram_jaccard.np.array(x) for x in zip(*some))
        assert ngram_jaccard._masked_product(lists, i, j).tolist() == [want[p] for p in some]
        of = ngram_jaccard.np.array(sorted(r.randrange(3) for _ in lists))
        found = dict(((int(b), int(a)), (int(n), int(e))) for a, b, n, e in zip(*ngram_jaccard._sparse_product(lists, of, ngram_jaccard.np.array([cut] * 3))))
        assert found == {(i, j): (n, int(early[i, j])) for (i, j), n in want.items() if n and of[i] == of[j]}


def test_a_collision_shows():
    import numpy as np

    from lexloom.llm import textkernel

    texts = [b"a b c d e f", b"f e d c b a", b"a b c d e f a b c d e f", b"", b"a"]
    x, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    proofs = [p for _, p, _ in textkernel.proven_sets(x, at)]
    assert len(set(proofs)) == 5 and not any(c for *_, c in textkernel.proven_sets(x, at))
    assert [len(v) for v in textkernel.shingle_sets(x, at)] == [2, 2, 6, 0, 1]


NAMES = "row own key stay twice doc_ID_ tkey n_shingles first_key __id __t __k __s __sha sha best rid level name h pos proof clash comp"


@pytest.mark.parametrize("keep", [ngram_jaccard.keep_first, keep_one])
def test_extra_columns_of_any_name_keep_their_values(spark, keep):
    names = NAMES.split()
    data = [(k, t, *(f"{n}{k}" for n in names)) for k, t in enumerate(["a b c", "a b c", None, "x y z u v w q", "", "é"])] + [(0, "a b c", *(f"{n}0" for n in names))]
    df = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n.upper() if i % 2 else n}` string" for i, n in enumerate(names)))
    out = keep(df)
    assert out.schema == df.schema
    got = out.collect()
    assert {tuple(r) for r in got} <= set(data) and len({r.text or "" for r in got}) == len({t or "" for _, t, *_ in data})


def test_keep_first(spark):
    data = rows()
    df = frame(spark, data)
    out = ngram_jaccard.keep_first(df).collect()
    assert len(out) == brute(data)[1] and out[0].__fields__ == df.columns
    assert ngram_jaccard.keep_first(frame(spark, empty=True)).count() == 0


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {x.id: x.comp for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in list(up)}


def test_prefix_bound_is_the_papers():
    for n in range(1, 300):
        assert -(-80 * n // 100) == math.ceil(80 * n / 100 - 1e-9)
