import random
from collections import defaultdict

import pytest

from siftloom.llm import mix, pack


def packed(spark, sizes, capacity, **kw):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")
    return pack.pack(df, capacity, **kw).collect()


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_fits(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, None, 1, 2, 33, 34, 50, 67, 100, 101, 250, rng.randrange(1, 100)]) for _ in range(300)]
    rows = packed(spark, sizes, 100)
    used, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.bin_id].append((r.bin_offset, r.n_tokens))
        parts[r.doc_id].append((r.part, r.n_tokens))
    for spans in used.values():
        end = 0
        for start, n in sorted(spans):
            assert start == end
            end += n
        assert end <= 100
    for i, n in enumerate(sizes):
        if not n:
            assert i not in parts
        else:
            got = sorted(parts[i])
            assert [p for p, _ in got] == list(range(len(got))) and sum(x for _, x in got) == n
            assert len(got) == 1 if n <= 100 else all(x == 100 for _, x in got[:-1])
    least = -(-sum(n or 0 for n in sizes) // 100)
    assert len(used) <= least * 1.15 + 1


def test_large_items_pair_at_most_twice():
    bins = pack.pack_sizes([60, 55, 45, 40, 34, 34, 34, 5], 100)
    large = defaultdict(int)
    for b in bins[:7]:
        large[b] += 1
    assert max(large.values()) == 2 and bins[0] == bins[3] and bins[1] == bins[2]


def test_many_groups_and_empty(spark):
    rows = packed(spark, [7] * 500, 10, group_tokens=100)
    assert len({r.bin_id for r in rows}) == 500 and len({r.bin_id >> 32 for r in rows}) > 5
    assert packed(spark, [0], 10) == []
    report = pack.fill_report(pack.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 10), 10).first()
    assert report.n_bins == 0 and report.fill is None


def _fill(children, budget):
    """Plain water filling: {name: (weight, capacity)}."""
    left, share, open_ = budget, dict.fromkeys(children, 0.0), dict(children)
    while open_ and left > 1e-9:
        level = left / sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c <= w * level]
        if not full:
            for k, (w, _) in open_.items():
                share[k] = w * level
            return share
        for k in full:
            share[k] = open_.pop(k)[1]
            left -= share[k]
    return share


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_plain_filling(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, l, f"s{s}", rng.randrange(1, 1000)) for d in "AB" for l in ("en", "zh") for s in range(4) if rng.random() < 0.8]
    wanted = [(f"s{s}", 0.5, rng.random(), rng.choice([1, 2, None])) for s in range(4)] + [("gone", 0.1, 0.3, 1)]
    t = spark.createDataFrame(wanted, "source string, keep_fraction double, mix_weight double, max_repeats int")
    df = spark.createDataFrame(leaves, "domain_type string, lang string, source string, leaf_tokens long")
    total = sum(x[3] for x in leaves)
    by_source = defaultdict(int)
    for x in leaves:
        by_source[x[2]] += x[3]
    goal = {s: (w, r or 1) for s, _, w, r in wanted}
    full = {x[:3]: (goal[x[2]][0] * x[3] / by_source[x[2]], x[3] * goal[x[2]][1]) for x in leaves}
    for fraction in (0.2, 0.9, 5.0):
        got = {(r.domain_type, r.lang, r.source): r.leaf_budget for r in mix.leaf_budgets(df, t, total * fraction).collect()}
        add = lambda keys: (sum(full[k][0] for k in keys), sum(full[k][1] for k in keys))
        top = _fill({d: add([k for k in full if k[0] == d]) for d in {k[0] for k in full}}, total * fraction)
        for d, room in top.items():
            mid = _fill({l: add([k for k in full if k[:2] == (d, l)]) for l in {k[1] for k in full if k[0] == d}}, room)
            for l, inner in mid.items():
                for k, v in _fill({k: full[k] for k in full if k[:2] == (d, l)}, inner).items():
                    assert got[k] == pytest.approx(v, abs=1e-6)


def test_leaves_smaller_than_a_text_hand_on_what_they_leave(spark):
    """A source of many leaves of one or two long texts each still gets its share, within a text."""
    rng = random.Random(4)
    docs = [(i, "ABCDEFGHIJKLMNO"[i % 15], ["en", "zh", "und"][i % 3], "spread", rng.randrange(300, 900)) for i in range(60)]
    docs += [(1000 + i, "A", "en", "large", 100 + i % 50) for i in range(2000)]
    sized = spark.createDataFrame(docs, "doc_id long, domain_type string, lang string, source string, n_tokens long")
    t = spark.createDataFrame([("spread", 0.1, 0.05, 1), ("large", 0.1, 0.95, 2)], "source string, keep_fraction double, mix_weight double, max_repeats int")
    total = sum(d[4] for d in docs)
    for fraction in (0.05, 0.3, 0.6):
        got = defaultdict(int)
        for r in mix.mix(sized, t, fraction).collect():
            got[r.source] += r.n_tokens * r.copies
        want = {"spread": min(0.05 * fraction * total, sum(d[4] for d in docs[:60])), "large": 0.95 * fraction * total}
        assert abs(got["spread"] - want["spread"]) <= 450 and abs(got["large"] - want["large"]) <= 75, (fraction, got, want)


def test_mix_meets_shares_and_repeats(spark):
    docs = [(i, "ABC"[i % 3], "en", f"s{i % 2}", 10 + i % 7) for i in range(600)] + [(9999, "A", "en", "other", 50), (10000, "A", "en", "s0", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, domain_type string, lang string, source string, n_tokens long")
    t = spark.createDataFrame([("s0", 0.1, 0.9, 3), ("s1", 0.1, 0.1, 1), ("none", 0.1, 0.2, 1)], "source string, keep_fraction double, mix_weight double, max_repeats int")
    rows = mix.mix(sized, t, 0.8).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and not {9999, 10000} & {r.doc_id for r in rows}
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens * r.copies
        assert 1 <= r.copies <= (3 if r.source == "s0" else 1)
    total = sum(d[4] for d in docs) * 0.8
    assert sum(tokens.values()) == pytest.approx(total, rel=0.02) and tokens["s0"] / sum(tokens.values()) == pytest.approx(0.9, abs=0.02)
    again = mix.mix(sized.repartition(7), t, 0.8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    report = {r.source: r for r in mix.share_report(mix.mix(sized, t, 0.8), sized, t).collect()}
    assert report["s0"].actual_share == pytest.approx(0.9, abs=0.02) and report["none"].actual_share == 0 and report["other"].target_share == 0
    assert mix.mix(sized.where("false"), t).count() == 0
