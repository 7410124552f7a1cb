import pytest
from pyspark.sql import functions as F

from siftloom.operators import chunk, sample
from siftloom.operators import evaluate as ev
from siftloom.sources import readers, writers

ROWS = [(1, "a", "the red cat", ["red cat", "dog"], [True, None]), (2, "a", None, [], []), (3, "b", "", None, None)]
SCHEMA = "id long, g string, p string, refs array<string>, ok array<boolean>"


def frames(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df, df.where("false")


def test_grouped_metrics_take_nulls_and_nothing(spark):
    df, none = frames(spark)
    assert {r.g: (r.n, r.acc) for r in ev.flat_accuracy(df, ["g"], "ok").collect()} == {"a": (2, 0.5)}
    assert {r.g: (r.n, r.em, r.f1) for r in ev.reference_scores(df, ["g"], "p", "refs").collect()} == {"a": (2, 0.5, 0.5), "b": (1, 0.0, 0.0)}
    assert {r.g: r.f1 for r in ev.mean_class_f1(df, ["g"], F.col("id"), F.lit(1), [1, 9]).collect()} == {"a": pytest.approx(1 / 3), "b": 0.0}
    assert [r.bleu for r in ev.smoothed_bleu(df.withColumn("r", F.lit("the red cat")), "id", "p", "r").orderBy("id").collect()] == [pytest.approx(100.0), 0.0, 0.0]
    assert [tuple(r) for r in ev.exploded_answers(df.where("id = 1").withColumn("refs", F.concat("refs", F.array(F.lit("dog")))), "id", "refs").collect()] == [(1, 0, "red cat"), (1, 1, "dog")]
    for out in (ev.flat_accuracy(none, ["g"], "ok"), ev.reference_scores(none, ["g"], "p", "refs"), ev.rolling_rows(none.withColumn("ll", F.lit(1.0)), "id", "ll", "p"), ev.grouped_requests(none, ["g"], "id"), ev.exploded_answers(none, "id", "refs")):
        assert out.count() == 0
    assert [r.value for r in ev.rolling_metrics(ev.rolling_rows(df.withColumn("ll", F.lit(-2.0)), "id", "ll", "p").where("id = 1")).orderBy("metric").collect()] == pytest.approx([2 / 11 / 0.6931471805599453, 2.718281828 ** (2 / 11), 2.718281828 ** (2 / 3)])


def test_thresholds(spark):
    rows = [(1, "red", ["red"], 0.1), (2, "blue", [], 0.2), (3, "green", ["green"], 0.3), (4, "grey", [], 0.9)]
    df = spark.createDataFrame(rows, "id long, p string, refs array<string>, na double")
    r = ev.squad_thresholds(df, "p", "refs", "na", "id").first()
    assert (r.best_exact, r.best_exact_thresh, r.best_f1) == (75.0, 0.1, 75.0)  # answering 1 alone is as good as answering 1 to 3
    assert ev.squad_thresholds(df.where("id in (2, 4)"), "p", "refs", "na", "id").first().best_exact_thresh == 0.0


def test_templates_refuse_what_they_do_not_know(spark):
    df = spark.createDataFrame([("x|y", ["u", "v"], 1)], "a string, l array<string>, k int")
    show = lambda t: df.select(ev.resolve(t, df.columns).alias("x")).first().x
    assert show("{{a | replace('|', '-')}} {{l[-1]}} {{l[k]}} {{l | join(', ')}} {{'q' | upper}}") == "x-y v v u, v Q"
    for bad in ("{{nope}}", "{{a | exec('x')}}", "{{a"):
        with pytest.raises(ValueError):
            show(bad)


def test_regressions_and_draws(spark):
    a = spark.createDataFrame([("t", "m", 0.5), ("u", "m", 0.1)], "task string, metric string, value double")
    b = spark.createDataFrame([("t", "m", 0.4), ("v", "m", 0.2)], "task string, metric string, value double")
    assert {r.task: r.verdict for r in ev.regression_table(a, b).collect()} == {"t": "worse", "u": "removed", "v": "added"}
    docs = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(99, 7)], "id long, g int")
    got = sample.fewshot_random(docs, docs, "g", "id", 3, 5).collect()
    per = {}
    for r in got:
        per.setdefault(r.id, []).append(r.example)
    assert set(per) == set(range(9)) and all(len(x) == len(set(x)) == 3 and k not in x and all(y % 2 == k % 2 for y in x) for k, x in per.items())
    assert len({tuple(x) for x in per.values()}) > 2 and sorted(map(tuple, sample.fewshot_random(docs.repartition(5), docs, "g", "id", 3, 5).collect())) == sorted(map(tuple, got))
    restored = spark.createDataFrame([([5, -1, 8], [-100, -100, -100, -1, 6, 7])], "i array<int>, l array<int>").select(chunk.span_restore(F.concat("i", F.array(*map(F.lit, (-1, 6, 7)))), F.col("l")).alias("x"))
    assert restored.first().x == [5, 6, 7, 8]


def test_buckets_and_shards(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(f"w{i % 5} x", i) for i in range(40)], "g string, k long")
    writers.write_buckets(lines, str(tmp_path / "b"), "g", "k", 3)
    back = readers.read_buckets(spark, str(tmp_path / "b"))
    assert sorted((r.ngram, int(r.key)) for r in back.collect()) == sorted((f"w{i % 5} x", i) for i in range(40))
    monkeypatch.setattr(writers, "ROWS_PER_FILE", 5)
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "v long, shard int")
    path = str(tmp_path / "s")
    assert writers.write_shards(df, path)
    (tmp_path / "s/_SUCCESS").unlink()
    (tmp_path / "s/shard=1/_SUCCESS").unlink()
    kept = sorted(p.name for p in (tmp_path / "s/shard=0").glob("*.parquet"))
    assert len(kept) >= 4 and writers.write_shards(df, path)  # the finished shard stays as it is, the other is written again
    assert sorted(p.name for p in (tmp_path / "s/shard=0").glob("*.parquet")) == kept and spark.read.parquet(path).count() == 40
