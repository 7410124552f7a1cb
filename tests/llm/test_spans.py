import random
from collections import defaultdict

import pytest

from siftloom.llm import spans


def brute(docs, n):
    at = defaultdict(set)
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            at[t[k : k + n]].add(i)
    pairs = {(a, b) for v in at.values() for a in v for b in v if a < b}
    cover = {}
    for i, t in docs:
        m = [False] * len(t or "")
        for k in range(len(t or "") - n + 1):
            if len(at[t[k : k + n]]) > 1:
                m[k : k + n] = [True] * n
        cover[i] = sum(m)
    return pairs, cover


def random_docs(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcd 中é😀") for _ in range(n))
    parts = [text(n) for n in (29, 30, 31, 45, 80)]
    docs = []
    for i in range(40):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            t += rng.choice(parts) + text(rng.randrange(0, 5))
        docs.append((i, t))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "aa" * 50), (103, "aa" * 40), (104, None), (105, "")]
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs = random_docs(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, rep string, hash int").repartition(3)
    pairs, cover = brute(docs, 30)
    rows = spans.shared_pairs(df, 30).collect()
    assert {tuple(r) for r in rows} == pairs and len(rows) == len(pairs)
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(df, 30).collect()}
    assert got == cover
    links = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in spans.shared_links(df, 30).collect()}
    for i, t in docs:
        same = [j for j, u in docs if u == t] if len(t or "") >= 30 else [i]
        assert links[i] == (min(same), len(same), sum(i in p for p in pairs))


def test_group_of_copies_and_boilerplate(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = text(60)
    docs = [(i, text(20) + common + text(20)) for i in range(40)] + [(100 + i, "z" + common[:40]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, _ = brute(docs, 30)
    rows = spans.shared_pairs(df, 30).collect()
    assert len(rows) == len(pairs) == 60 * 59 // 2 and {tuple(r) for r in rows} == pairs


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x" * 400), (1, "x" * 400), (None, "x" * 400)], "doc_id long, text string")
    assert spans.shared_pairs(df).count() == 0
    assert spans.shared_pairs(df.where("false")).count() == 0
    assert spans.shared_share(df.where("false")).count() == 0
    assert [tuple(r) for r in spans.shared_links(df).collect()] == [(1, 1, 1, 0)] and spans.shared_links(df.where("false")).count() == 0


def test_winnowing_never_misses():
    rng = random.Random(1)
    for _ in range(30):
        import numpy as np

        h = np.array([rng.randrange(40) for _ in range(200)], np.uint64)
        chosen = set(spans.winnowed(h, 11).tolist())
        expect = {k for a in range(190) for k in range(a, a + 11) if h[k] == h[a : a + 11].min()}
        assert chosen == expect
