import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftloom.operators import prefix, sample, select
from siftloom.plans import catalog


def attributes(spark, rows):
    return spark.createDataFrame(rows, "row_id string, n_tokens long, metric double, domain_1 string, domain_2 string")


def rows(n, seed=0):
    rng = random.Random(seed)
    return [(f"r{i:04d}", rng.randrange(1, 50), float(rng.randrange(1, 6)), rng.choice("ABC"), rng.choice("xy")) for i in range(n)]


def greedy(part, budget, bottom=False):
    out, total = [], 0
    for r in sorted(part, key=lambda r: (r[2] if bottom else -r[2], r[0])):
        if out and total >= budget:
            break
        out.append(r[0])
        total += r[1]
    return set(out)


@pytest.mark.parametrize("partitions", [1, 13])
def test_running_total_for_any_partitioning(spark, partitions):
    data = rows(300)
    df = attributes(spark, data).repartition(partitions)
    got = prefix.running_total(df, ["domain_1"], [F.col("row_id")], {"t": F.col("n_tokens"), "i": F.lit(1)}).collect()
    sums, counts = defaultdict(int), defaultdict(int)
    want = {}
    for r in data:
        sums[r[3]] += r[1]
        counts[r[3]] += 1
        want[r[0]] = (sums[r[3]], counts[r[3]])
    assert {r.row_id: (r.t, r.i) for r in got} == want


@pytest.mark.parametrize("budget", [0, 1, 500, 10**9])
@pytest.mark.parametrize("bottom", [False, True])
def test_uniform(spark, budget, bottom):
    data = rows(200)
    got = {r.row_id for r in select.select_subset(attributes(spark, data), budget, "uniform", bottom).collect()}
    assert got == greedy(data, budget, bottom)


def test_strategies(spark):
    data = rows(400, 2)
    df, budget = attributes(spark, data), 3000
    total = sum(r[1] for r in data)
    groups = defaultdict(list)
    for r in data:
        groups[r[3]].append(r)
    org = set().union(*(greedy(p, sum(r[1] for r in p) * budget // total) for p in groups.values()))
    equi = set().union(*(greedy(p, budget // 3) for p in groups.values()))
    multi = set()
    for p in groups.values():
        t = sum(r[1] for r in p)
        outer = t * budget // total
        for d in "xy":
            inner = [r for r in p if r[4] == d]
            multi |= greedy(inner, sum(r[1] for r in inner) * outer // t)
    ids = lambda s: {r.row_id for r in select.select_subset(df, budget, s).collect()}
    assert ids("org_domain") == org and ids("equi_domain") == equi and ids("multi_domain") == multi and len(ids(None)) == 400
    with pytest.raises(ValueError):
        select.select_subset(df, 1, "other")


def test_margin_caps_candidates(spark):
    data = rows(100, 3)
    total = sum(r[1] for r in data)
    got = select.select_subset(attributes(spark, data), total // 2, "uniform", margin=0.0).count()
    assert got <= math.ceil(100 * (total // 2) / total)


def test_upsampling_reaches_the_budget(spark):
    data = rows(50, 4)
    total = sum(r[1] for r in data)
    got = select.select_subset(attributes(spark, data), 3 * total, "uniform", seed=1, upsample=True)
    picked = got.collect()
    assert sum(r.n_tokens for r in picked) >= 3 * total and len({(r.row_id, r.copy_no) for r in picked}) == len(picked) and {r.row_id for r in picked} == {r[0] for r in data}
    again = select.select_subset(attributes(spark, data).repartition(5), 3 * total, "uniform", seed=1, upsample=True)
    assert sorted(map(tuple, picked)) == sorted(map(tuple, again.collect()))
    wide = select.fetch(attributes(spark, data).select("row_id", "metric"), got, "row_id")
    assert wide.count() == len(picked)


def test_empty_and_unusable_rows(spark):
    df = attributes(spark, [])
    assert select.select_subset(df, 10, "org_domain").count() == 0 and select.select_subset(df, 10, "uniform", upsample=True).count() == 0
    raw = spark.createDataFrame([("a", None, "3", "x"), ("b", 0, "3", "x"), ("c", 5, None, None), ("d", 5, "4", None)], "id string, len int, s string, dom string")
    got = select.with_attributes(raw, "id", "len", ["s"], ["dom"]).collect()
    assert [(r.row_id, r.metric, r.domain_1) for r in got] == [("d", 4.0, "")]


def test_score_and_domain_filters(spark):
    df = attributes(spark, rows(100, 5))
    assert {r.metric for r in select.filter_scores(df, [4, 5]).collect()} == {4.0, 5.0} and {r.domain_1 for r in select.filter_domains(df, ["A"]).collect()} == {"A"}


def test_shards(spark):
    df = attributes(spark, rows(97, 6)).select("row_id", "n_tokens")
    contiguous = sorted((r.row_id, r.shard) for r in select.shard_contiguous(df, 5).collect())
    assert [sum(s == k for _, s in contiguous) for k in range(5)] == [20, 20, 19, 19, 19] and [s for _, s in contiguous] == sorted(s for _, s in contiguous)
    strided = sorted((r.row_id, r.shard) for r in select.shard_strided(df, 5).collect())
    assert [s for _, s in strided] == [i % 5 for i in range(97)]
    by_tokens = defaultdict(int)
    for r in select.shard_by_tokens(df, 300).collect():
        by_tokens[r.shard] += r.n_tokens
    assert max(by_tokens.values()) < 350 and {r.shard for r in select.shard_by_tokens(df, 0).collect()} == {0}
    assert select.shard_by_rows(df, 300).agg(F.countDistinct("shard").alias("n")).first().n == len(by_tokens)


def test_tails(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(250)] + [("t", 999, 1.0)], "source string, id long, score double")
    got = {(r.source, r.tail): set() for r in select.tail_fraction(df, ["source"], "score", "id").collect()}
    for r in select.tail_fraction(df, ["source"], "score", "id").collect():
        got[r.source, r.tail].add(r.id)
    assert got == {("s", "top"): {249, 248}, ("s", "bottom"): {0, 1}, ("t", "top"): {999}, ("t", "bottom"): {999}}


def test_splits_and_samples(spark):
    df = attributes(spark, rows(300, 7))
    parts = sample.split_exact(df, ["domain_1"], 10, 5, 20, sample.hash_order("row_id", 3)).collect()
    count = defaultdict(int)
    for r in parts:
        count[r.domain_1, r.split] += 1
    assert all(count[d, s] == n for d in "ABC" for s, n in (("test", 10), ("valid", 5), ("train", 20))) and len({r.row_id for r in parts}) == 105
    assert sample.sample_exactly(df, 7, "row_id").count() == 7
    with pytest.raises(ValueError):
        sample.sample_exactly(df, 301, "row_id")
    assert sample.sample_per_group(df, ["domain_1"], 4, [F.col("row_id")]).count() == 12
    assert sample.limit_fraction(df, 0.015, "row_id").count() == 5 and sample.limit_fraction(df, 8, "row_id").count() == 8


def test_rebalance(spark):
    df = spark.createDataFrame([("s", i, 1 if i < 10 else 4) for i in range(100)] + [("t", i, 5) for i in range(100, 110)] + [("s", 999, None)], "source string, id long, score int")
    out = sample.rebalance(df, "source", "score", [F.col("id")], 4, 2)
    added = out.where("copy_no > 0").collect()
    assert len(added) == min(80 // 4, 10) * 2 and {r.score for r in added} == {1} and {r.source for r in added} == {"s"} and out.count() == 111 + 20
    sizes = {r.source: r.draws for r in sample.rebalance_sizes(df, "source", "score", 4, 2).collect()}
    assert sizes == {"s": 20, "t": 0}


def test_fewshot_never_shows_the_document(spark):
    df = spark.createDataFrame([(t, i) for t in "ab" for i in range(5 if t == "a" else 2)], "task string, doc long").withColumn("doc", F.col("doc") + F.when(F.col("task") == "b", 100).otherwise(0))
    got = defaultdict(list)
    for r in sample.fewshot(df, df, "task", "doc", 3, [F.col("example")]).collect():
        got[r.doc].append((r.shot, r.example))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 1), (2, 2), (3, 3)], 1: [(1, 0), (2, 2), (3, 3)], 2: [(1, 0), (2, 1), (3, 3)], 3: [(1, 0), (2, 1), (3, 2)], 4: [(1, 0), (2, 1), (3, 2)], 100: [(1, 101)], 101: [(1, 100)]}


def test_choices_and_order(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, ["a", "b", "c", "a"])], "id long, c array<string>")
    got = df.select(sample.shuffled_choices(F.col("c"), F.col("id"), 5).alias("x")).collect()
    assert all(sorted(r.x) == ["a", "a", "b", "c"] for r in got)
    order = sample.length_order(df.withColumn("n", F.col("id")), F.col("n"), "id").collect()
    assert {r.id: r.place for r in order} == {1: 2, 2: 1}
    assert sample.rank_stride(df, "id", 1, 2).count() == 1


def test_rank_strides_hold_every_row(spark, tmp_path):
    """By row number: ids that aren't dense, far beyond any bound on their value."""
    ids = [3, 7, 8, 4999, 5000, 70_000, 70_001, 10**12, 10**12 + 9]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "doc_id long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.queries()["rank_strided"](spark, str(tmp_path)).collect()}
    assert got == {(x, k % 4) for k, x in enumerate(ids)}
    first = {tuple(r) for r in sample.rank_strides(df, "doc_id", 4, 6).collect()}
    assert first == {(x, k % 4) for k, x in enumerate(ids[:6])}
