import random
import re

import pytest

from siftloom.llm import repeat

TOKEN = re.compile("[一-鿿]|[^\\W_一-鿿]+")


def brute(text):
    """Repeated code points, by sets of windows."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    han = [bool(re.fullmatch("[一-鿿]", w)) for w in words]
    covered = [False] * len(text)
    seen5, seen10 = set(), set()
    for i in range(len(words)):
        if i + 5 <= len(words) and 2 * sum(han[i : i + 5]) <= 5:
            if (g := tuple(words[i : i + 5])) in seen5:
                covered[spans[i][0] : spans[i + 4][1]] = [True] * (spans[i + 4][1] - spans[i][0])
            seen5.add(g)
        j, n = i, 0
        while j < len(words) and n < 10:
            n += len(words[j])
            j += 1
        if n >= 10 and 2 * sum(han[i:j]) > j - i:
            if (g := tuple(words[i:j])) in seen10:
                covered[spans[i][0] : spans[j - 1][1]] = [True] * (spans[j - 1][1] - spans[i][0])
            seen10.add(g)
    return sum(covered)


def texts(n=120, seed=2):
    rng = random.Random(seed)
    en, zh = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split(), "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    out = ["", " ", "one", "a a a a a a a a", "一" * 40, "x" * 5000, "Repeat This Line now please.\n" * 7, "第一句话说的是这件事情。" * 4]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            k = rng.randrange(3)
            if k == 0 and parts:
                parts.append(rng.choice(parts).upper())
            elif k == 1:
                parts.append("".join(rng.choice(zh) for _ in range(rng.randrange(4, 30))) + str(rng.randrange(2000)))
            else:
                parts.append(" ".join(rng.choices(en, k=rng.randrange(3, 15))))
        out.append(rng.choice(["\n", ". ", "，", " "]).join(parts))
    return out


def test_measure_equals_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([*enumerate(t), (998, None), (None, "word")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_chars, r.repeated_chars) for r in repeat.repetition(df).collect()}
    assert got == {i: (len(s), brute(s)) for i, s in enumerate(t)} | {998: (0, 0), None: (4, 0)}


def test_cascade_never_changes_the_result(spark):
    t = texts(200, 5)
    want = {i for i, s in enumerate(t) if s and brute(s) >= 0.3 * len(s)}
    names = list(repeat.RULES)
    for order in ([], names, names[::-1], ["hashed_runs"], repeat.order_rules(t)):
        assert set(repeat.cascade(t, order).tolist()) == want
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    assert {r.doc_id for r in repeat.repetitive(df).collect()} == want and len(want) > 10


def test_rules_bound_the_measure():
    import numpy as np

    t = [s for s in texts(150, 7) if s]
    b = repeat.Batch(t)
    exact = repeat.repeated_chars(b, np.arange(len(t)))
    for rule in repeat.RULES.values():
        assert (rule(b, np.arange(len(t))) >= exact).all()


def test_empty_tables_and_shares(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeat.repetitive(df).count() == 0 and repeat.repetition(df).count() == 0
    row = repeat.repetition(spark.createDataFrame([(1, "Same line here.\nsame line here.\nOther.")], "doc_id long, text string")).first()
    assert row.line_share == pytest.approx(15 / 38) and row.paragraph_share == 0


def test_every_code_point_counts(spark):
    """Letters of any plane repeat; none is folded into another."""
    assert not any(chr(c).isalnum() for c in range(repeat._LETTERS, 0x110000)) and not any(chr(c).lower() != chr(c) for c in range(repeat._CASED, 0x110000))
    g = "".join(chr(0x30000 + i) for i in range(60))
    t = {1: g * 4, 2: g + "".join(chr(0x31350 + i) for i in range(120)), 3: "\U0001f600" * 200, 4: "𝔞𝔟𝔠 𝔡𝔢𝔣 𝔤𝔥𝔦 𝔧𝔨𝔩 𝔪𝔫𝔬 " * 5}
    df = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r.doc_id for r in repeat.repetitive(df).collect()} == {1, 4}
    assert {r.doc_id: r.repeated_chars for r in repeat.repetition(df).collect()}[1] == 180
