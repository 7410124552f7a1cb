import math
import random
from collections import defaultdict

import pytest

from siftloom.llm import cutoff

RECORDS = "dataset string, source string, score double"
TARGETS = "source string, keep_fraction double, mix_weight double, max_repeats int"


def brute(rows, fractions):
    by = defaultdict(list)
    for d, s, x in rows:
        by[d, s].append(x)
    out = {}
    for key, xs in by.items():
        good = sorted((x for x in xs if x is not None and math.isfinite(x)), reverse=True)
        f = fractions.get(key[1])
        k = 0 if f is None else max(0, min(len(good), math.ceil(round(f * len(good), 6))))
        c = good[k - 1] if k else None
        out[key] = (len(xs), len(good), k, c, sum(x >= c for x in good) if k else 0, sum(x > c for x in good) if k else 0)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_sorting(spark, seed):
    rng = random.Random(seed)
    draw = {"ties": lambda: float(rng.randrange(1, 6)), "fine": lambda: rng.random() * 5, "one": lambda: 3.0, "no": lambda: None, "odd": lambda: rng.choice([None, float("nan"), float("inf"), 2.5, 1.0])}
    rows = [(d, s, f()) for s, f in draw.items() for d in ("a", "b") for _ in range(rng.randrange(1, 400))] + [("a", "untargeted", 1.0), ("a", None, 2.0)]
    fractions = {"ties": 0.37, "fine": rng.random(), "one": 0.5, "no": 0.5, "odd": 1.5, "absent": 0.1}
    t = spark.createDataFrame([(f" {s}.jsonl", f, 0.1, 1) for s, f in fractions.items()], TARGETS)
    df = spark.createDataFrame(rows, RECORDS).repartition(5)
    found = cutoff.cutoffs(df, t)
    got = {(r.dataset, r.source): (r.n_records, r.n_scored, r.target_kept, r.cutoff, r.kept, r.kept_above) for r in found.collect()}
    want = brute(rows, fractions)
    assert got == want
    rows_ = cutoff.kept(df, found).collect()
    assert all((r.target_kept, r.cutoff, r.kept) == want[r.dataset, r.source][2:5] for r in rows_)
    kept = len(rows_)
    assert kept == sum(v[4] for k, v in want.items() if k[1] is not None)


def test_edges(spark):
    df = spark.createDataFrame([("a", "s", 1.0), ("a", "s", 2.0), ("a", "z", 2.0), ("a", "n", 4.0)], RECORDS)
    t = spark.createDataFrame([("s", 0.5, 0.0, 1), ("s", None, 0.0, 1), ("z", 0.0, 0.0, 1), ("n", -1.0, 0.0, 1), (None, 0.5, 0.0, 1)], TARGETS)
    got = {r.source: (r.cutoff, r.kept) for r in cutoff.cutoffs(df, t).collect()}
    assert got == {"s": (2.0, 1), "z": (None, 0), "n": (None, 0)}
    assert cutoff.cutoffs(df.where("false"), t).count() == 0
    assert {r.cutoff for r in cutoff.cutoffs(df, t.where("false")).collect()} == {None}
