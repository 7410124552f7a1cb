import random

import pytest

from siftloom.llm import leak

WORDS = "amber bridge castle dragon ember forest garden harbor island jungle kettle ladder marble needle ocean pepper quartz river silver timber".split()
STEM = "which of the following best explains why"


def items(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        q = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(12)]
        out.append((i, " ".join(q[:6]) + ". " + STEM.capitalize() + " " + " ".join(q[6:]) + "?", ["right answer", "b", "c", "d"], 0))
    return out


ITEM_SCHEMA = "item_id long, query string, choices array<string>, gold int"
NOISE = "some plain filler text that says nothing of interest at all and goes on "


def found(spark, docs, rows, **kw):
    d = spark.createDataFrame([(i, t, -1) for i, t in docs], "doc_id long, text string, item_id int")
    return {(r.doc_id, r.item_id): r for r in leak.leaks(d, spark.createDataFrame(rows, ITEM_SCHEMA)).collect()}


def stemmed(rows, stems):
    out = []
    for r in rows:
        t = leak.tokens(r[1])
        out.append((*r, [i for i in range(len(t) - leak.STEM_TOKENS + 1) if " ".join(t[i : i + leak.STEM_TOKENS]) in stems]))
    return out


def test_many_blocks_read_the_texts_once(spark, monkeypatch):
    """Blocks of 7 items, two of them kept in memory, give what one block gives, in one pass over the texts."""
    rows = items(30)
    docs = [(i, NOISE + r[1] + NOISE) for i, r in enumerate(rows)]
    want = set(found(spark, docs, rows))
    assert want == {(i, i) for i in range(30)}
    monkeypatch.setattr(leak, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(leak, "KEPT_BLOCKS", 2)
    assert set(found(spark, docs, rows)) == want
    d = spark.createDataFrame(docs, "doc_id long, text string")
    plan = leak.leaks(d, spark.createDataFrame(rows, ITEM_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_whole_partly_and_changed(spark):
    rows = items(30)
    q = [r[1] for r in rows]
    w = [x.split() for x in q]
    swap = lambda t, *at: " ".join("changed" if i in at else x for i, x in enumerate(t))
    docs = [
        (1, NOISE * 9 + q[0] + NOISE),
        (2, NOISE + q[1].upper().replace(" ", "\n *")),
        (3, NOISE + "<b>" + q[2].replace(" ", "</b> <i>") + " right answer"),
        (4, NOISE + " ".join(w[3][:12]) + " [cut] " + NOISE),
        (5, NOISE + swap(w[4], 3, 9)),
        (6, NOISE + " ".join(w[5][:5] + w[5][6:])),
        (7, NOISE + " ".join(w[6][:9])),  # under half
        (8, NOISE + STEM + " " + NOISE),  # the stem alone
        (9, "right answer b c d"),
        (10, " ".join(sorted(w[7]))),  # other order
        (11, None), (12, ""), (13, q[8] + "\n" + q[9]), (14, q[0]), (14, q[0]),
    ]
    got = found(spark, docs, rows)
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (13, 8), (13, 9), (14, 0)}
    assert got[3, 2].answer_near and not got[1, 0].answer_near and got[1, 0].question_share == 1.0


def test_chinese_counts_characters(spark):
    q = "关于任务的版本几乎出版着汀嵩台，每309吨就包围一回壁画。根据材料，可以推断每376小时就连接一回博物馆的原因是什么？"
    rows = [(1, q, ["甲", "乙", "丙", "丁"], 1), (2, "完全不同的问题讲的是另外一件事情，最后要问的是哪一个地方呢？", [], 9)]
    docs = [(1, "前文。" + q.replace("，", " \n") + "后文"), (2, "前文" + q[:40]), (3, "前文" + q[:20]), (4, q.replace("壁", "墙").replace("馆", "院")), (5, q[::-1])]
    assert set(found(spark, docs, rows)) == {(1, 1), (2, 1), (4, 1)}


def test_odd_items_and_empty_tables(spark):
    rows = [(1, None, None, None), (2, "", [], 0), (None, "some question without an id at all", ["a"], 0), (3, "tiny", ["a"], 5), (4, "a short one here", None, 1)]
    got = found(spark, [(1, "he asked a short one here today"), (2, None)], rows)
    assert set(got) == {(1, 4)}
    assert not found(spark, [], rows) and not found(spark, [(1, "text")], [])


def test_retrieval_loses_nothing(monkeypatch, spark):
    """Against every pair verified without retrieval."""
    rng = random.Random(4)
    rows = items(60, 8)
    stems = {" ".join(STEM.split()[i : i + 4]) for i in range(4)}
    ix = leak.build_index(stemmed(rows, stems))
    docs = []
    for _ in range(150):
        i = rng.randrange(60)
        t = leak.tokens(rows[i][1])
        a = rng.randrange(len(t) - 5)
        part = t[a : a + rng.randrange(5, len(t))]
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = rng.choice(WORDS) + "7"
        docs.append(" ".join(rng.choices(WORDS, k=rng.randrange(150))) + " " + " ".join(part) + " " + " ".join(rng.choices(WORDS, k=20)))
    got = {(t, i) for t, i, *_ in leak.search(ix, [leak.tokens(t) for t in docs])}
    want = set()
    for t, text in enumerate(docs):
        d = [ix.vocabulary.get(x, -1) for x in leak.tokens(text)]
        for i in range(60):
            if leak.best_run(ix, i, d, list(range(-len(ix.words[i]), len(d))))[0] >= 0.5 - 1e-9:
                want.add((t, i))
    assert got == want and len(want) > 30


@pytest.mark.parametrize("changes", [0, 1, 2])
def test_halves_over_a_long_stem(changes):
    """Every exact half with inner changes, as long as no more words beyond the stem are changed than kept."""
    stem = "how should a reader respond after learning that this".split()
    rng = random.Random(5)
    rows = [(i, " ".join([*(f"{rng.choice(WORDS)}{i}x{k}" for k in range(8)), *stem, *(f"{rng.choice(WORDS)}{i}y{k}" for k in range(7))]), [], 0) for i in range(6)]
    ix = leak.build_index(stemmed(rows, {" ".join(stem[i : i + 4]) for i in range(len(stem) - 3)}))
    texts, want = ["so " + " ".join(stem) + " on"], set()
    for i, query, *_ in rows:
        words = query.split()
        for a in range(len(words) // 2 + 1):
            part, own = words[a : a + 12], sum(w not in stem for w in words[a : a + 12])
            for k in rng.sample(range(1, 11), changes):
                part[k] = "changed"
            kept = sum(w not in stem and w != "changed" for w in part)
            if kept >= max(1, own - kept):
                want.add((len(texts), i))
            texts.append("some filler " + " ".join(part) + " and more")
    assert len(want) >= (78 if changes < 2 else 74)
    assert {(t, i) for t, i, *_ in leak.search(ix, [leak.tokens(t) for t in texts])} == want


@pytest.mark.parametrize("size", [7, 8])
def test_halves_of_short_items(size):
    """Of half of such an item one changed word leaves one term, by which it must be retrieved."""
    rows = [(i, " ".join(f"{w}{i}" for w in WORDS[:size]), [], 0) for i in range(20)]
    ix = leak.build_index(stemmed(rows, set()))
    texts, want = [], set()
    for i, query, *_ in rows:
        words = query.split()
        for a in range(size - 3):
            for k in (1, 2):
                part = words[a : a + 4]
                part[k] = "changed"
                want.add((len(texts), i))
                texts.append("some filler " + " ".join(part) + " and more")
    assert {(t, i) for t, i, *_ in leak.search(ix, [leak.tokens(t) for t in texts])} == want


def test_blocks_of_items_give_the_same(monkeypatch, spark):
    rows = items(25)
    docs = [(i, NOISE + r[1]) for i, r in enumerate(rows)]
    whole = set(found(spark, docs, rows))
    monkeypatch.setattr(leak, "BLOCK_ITEMS", 7)
    assert set(found(spark, docs, rows)) == whole == {(i, i) for i in range(25)}


@pytest.mark.parametrize("text", ["a" * 200_000, "word " * 50_000, "中" * 50_000])
def test_very_long_texts(spark, text):
    rows = items(5)
    assert set(found(spark, [(1, text + " " + rows[2][1])], rows)) == {(1, 2)}
