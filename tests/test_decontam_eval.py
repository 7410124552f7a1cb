import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftloom.operators import decontam, evaluate, score
from siftloom.plans import catalog


def test_ngrams_and_overlap(spark):
    docs = spark.createDataFrame([(i, f"Common, words come here again {'x' if i else 'y'}") for i in range(12)] + [(99, None), (98, "short")], "doc_id long, text string")
    got = {r.ngram: r.n_docs for r in decontam.frequent_ngrams(docs, "doc_id", "text", 3, 11).collect()}
    assert got == {"common words come": 12, "words come here": 12, "come here again": 12}
    held = spark.createDataFrame([(1, "COMMON words come; there"), (2, "nothing like it")], "item long, q string")
    assert [tuple(r) for r in decontam.overlap(docs, "doc_id", "text", held, "item", "q", 3).collect()] == [(1, 1, 12)]


@pytest.mark.parametrize("length, hits, want", [
    (1000, [], [(0, 1000)]), (200, [], [(0, 200)]), (199, [], []),
    (1000, [(500, 510)], [(0, 300), (710, 1000)]),  # 200 characters around the hit go, and one more behind it
    (1000, [(0, 10)], [(210, 1000)]), (1000, [(990, 1000)], [(0, 790)]), (1000, [(200, 210)], [(410, 1000)]),
    (1000, [(400, 410), (405, 420)], [(620, 1000)]),  # the part before is no longer than 200
    (2000, [(500, 510), (1100, 1110)], [(0, 300), (1310, 2000)]),
    (3000, [(500, 510), (1500, 1510)], [(0, 300), (709, 1300), (1710, 3000)]),
    (3000, [(500, 510)] * 10, [(0, 300), (710, 3000)]), (3000, [(500, 510)] * 11, []),
])
def test_cutting_rules(spark, length, hits, want):
    df = spark.createDataFrame([(hits, length)], "h array<struct<begin: int, stop: int>>, n int")
    got = df.select(decontam.clean_intervals(F.col("h"), F.col("n")).alias("x")).first().x
    assert [tuple(x) for x in got] == want


@pytest.mark.parametrize("most", [10**6, 0])
def test_decontaminate_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_GRAMS", most)
    filler = " ".join(f"w{i}" for i in range(200))
    held = spark.createDataFrame([("The quick, brown fox jumps",)], "q string")
    docs = spark.createDataFrame([(1, filler + " the QUICK brown fox jumps " + filler), (2, filler), (3, "tiny"), (4, None)], "doc_id long, text string")
    got = {}
    for r in decontam.decontaminate(docs, "doc_id", "text", held, "q", 5).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert set(got) == {1, 2} and got[2] == [filler] and len(got[1]) == 2 and not any("fox" in c for c in got[1])


def run(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v))
    return df.select(column.alias("x")).first().x


def test_filters(spark):
    r = F.col("r")
    go = lambda steps, v: run(spark, evaluate.pipeline(r, steps), r=v)
    assert go([("regex", r"#### (\-?[0-9\.\,]+)")], ["a #### 12", "none"]) == ["12", "[invalid]"]
    assert go([("regex", r"(\d+)|([A-Z])", 2, -1)], ["1 then B", "C 7"]) == ["B", "7"]
    assert go([("remove_whitespace",)], ["  a ", "\n\tb"]) == ["a ", "b"]
    assert go([("majority_vote",)], ["b", "a", "a", "b", "c"]) == ["b"] and go([("majority_vote",)], []) == []
    assert go([("uppercase",), ("lowercase",), ("take_first_k", 2), ("take_first",)], ["Ab", "c"]) == ["ab"]
    assert go([("map", {"a": "1"}, "?")], ["a", "z"]) == ["1", "?"]
    pick = evaluate.multi_choice(r"answer is (\([A-D]\))", ignore_case=True, ignore_punctuation=True)
    df = spark.createDataFrame([(["the answer is (B)", "I choose the red cat.", "so: C", "unclear", None], ["blue dog", "one", "red cat"])], "r array<string>, c array<string>")
    assert df.select(pick("r", "c").alias("x")).first().x == ["(B)", "(C)", "(C)", "[invalid]", "[invalid]"]


def test_metrics_of_a_document(spark):
    df = spark.createDataFrame([([-1.0, -1.0, -3.0], ["aa", "a", "aaa"], 0), ([-1.0, -2.0], ["a", "b"], 5), ([-2.0, -1.0], ["a", "b"], 1)], "s array<double>, c array<string>, g int")
    s, c, g = F.col("s"), F.col("c"), F.col("g")
    got = df.select(evaluate.accuracy(s, g).alias("a"), evaluate.accuracy_norm(s, c, g).alias("n"), evaluate.brier(s, g).alias("b")).collect()
    assert [r.a for r in got] == [1.0, 0.0, 1.0] and [r.n for r in got] == [1.0, 0.0, 1.0]
    p = [math.exp(x) for x in (-2.0, -1.0)]
    assert got[2].b == pytest.approx((p[0] / sum(p)) ** 2 + (p[1] / sum(p) - 1) ** 2)
    assert df.where("g = 1").select(evaluate.gold_rank(s, g).alias("r")).first().r == 1
    assert df.where("g = 1").select(evaluate.accuracy_mutual(s, F.array(F.lit(-9.0), F.lit(0.0)), g).alias("r")).first().r == 0.0
    assert df.where("g = 0").select(evaluate.accuracy_multi(s, F.array(F.lit(0), F.lit(2))).alias("r")).first().r == 1.0
    e = lambda a, b, **k: run(spark, evaluate.exact_match(F.col("a"), F.col("b"), **k), a=a, b=b)
    assert e("A b!", "a B", ignore_case=True, ignore_punctuation=True) == 1.0 and e("a1", "a2", ignore_numbers=True) == 1.0 and e("x, y", "x y", ignore=[","]) == 1.0 and e("a", "b") == 0.0


def test_aggregations(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(2), rng.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, t int, p int")
    counts = df.groupBy("g", F.col("t").alias("truth"), F.col("p").alias("predicted")).agg(F.count("*").alias("n"))
    mcc = {r.g: r.mcc for r in evaluate.matthews(counts, ["g"]).collect()}
    f1 = {r.g: r.f for r in df.groupBy("g").agg(evaluate.binary_f1(F.col("t"), F.col("p")).alias("f")).collect()}
    for g in "ab":
        n = Counter((t, p) for h, t, p in rows if h == g)
        tp, tn, fp, fn = n[1, 1], n[0, 0], n[0, 1], n[1, 0]
        assert mcc[g] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        assert f1[g] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    a = evaluate.all_correct(spark.createDataFrame([("x", 1, True), ("x", 1, False), ("x", 2, True)], "t string, q int, ok boolean"), ["t"], ["q"], F.col("ok")).first()
    assert a.acc_all == 0.5 and a.n_groups == 2


def test_bleu_chrf_ter(spark):
    df = spark.createDataFrame([("t", "the cat sat on the mat", "the cat sat on a mat"), ("t", "a dog", "a big dog")], "t string, p string, r string")

    def plain_bleu(order):
        m, t = [0] * order, [0] * order
        for _, p, r in df.collect():
            for n in range(1, order + 1):
                a, b = (Counter(tuple(x.split()[i : i + n]) for i in range(len(x.split()) - n + 1)) for x in (p, r))
                m[n - 1] += sum((a & b).values())
                t[n - 1] += sum(a.values())
        penalty = min(1.0, math.exp(1 - 9 / 8))
        return 100 * penalty * math.exp(sum(math.log(x / y) for x, y in zip(m, t)) / order)

    assert evaluate.corpus_bleu(df, ["t"], "p", "r", 3).first().bleu == pytest.approx(plain_bleu(3))
    assert evaluate.corpus_chrf(df.withColumn("r", F.col("p")), ["t"], "p", "r").first().chrf == pytest.approx(100)
    assert 0 < evaluate.corpus_chrf(df, ["t"], "p", "r").first().chrf < 100
    assert evaluate.corpus_ter(df, ["t"], "p", "r").first().ter == pytest.approx(100 * 2 / 9)


def test_errors_and_groups(spark):
    rng = random.Random(42)
    xs = [rng.random() for _ in range(1000)]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(xs)], "g string, k int, x double")
    mean = sum(xs) / 1000
    closed = math.sqrt(sum((x - mean) ** 2 for x in xs) / 999 / 1000)
    boot = evaluate.bootstrap_stderr(df, ["g"], "k", "x", lambda x, w: F.sum(x * w) / F.sum(w), 400).first().stderr
    again = evaluate.bootstrap_stderr(df.repartition(7), ["g"], "k", "x", lambda x, w: F.sum(x * w) / F.sum(w), 400).first().stderr
    assert boot == pytest.approx(again, rel=1e-9)
    assert boot == pytest.approx(closed, rel=0.12)
    assert evaluate.stderr_kind("bleu", 100000) == ("bootstrap", 100) and evaluate.stderr_kind("mean", 10)[0] == "closed" and evaluate.stderr_kind("x", 10)[0] == "none"
    se = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1) / len(v))
    parts = [[1] * 40 + [0] * 60, [1] * 30 + [0] * 30, [1] * 10 + [0] * 70]
    res = spark.createDataFrame([("a", se(p), len(p)) for p in parts], "grp string, stderr double, n int")
    assert evaluate.pooled_stderr(res, ["grp"]).first().stderr == pytest.approx(se(sum(parts, [])), abs=2e-3)
    results = spark.createDataFrame([("x", 0.3, 0.1, 20), ("y", 0.2, 0.1, 40), ("z", 0.4, 0.1, 100)], "task string, value double, stderr double, n int")
    tree = {"all": ["one", "z"], "one": ["x", "y", "x"]}
    got = {r.grp: r for r in evaluate.group_rollup(results, tree).collect()}
    assert got["all"].macro == pytest.approx(0.3) and got["all"].micro == pytest.approx(0.3375) and got["one"].n_tasks == 2
    with pytest.raises(ValueError):
        evaluate.flatten_tree({"a": ["b"], "b": ["a"]})
    assert evaluate.match_names(["m*", "x"], ["mmlu", "x", "y", "mx"]) == ["mmlu", "mx", "x"]
    z = evaluate.compare_runs(results, results.withColumn("value", F.col("value") + 0.1)).first()
    assert z.z == pytest.approx(-0.1 / math.sqrt(0.02)) and z.p_value == pytest.approx(0.4795, abs=1e-3)
    table = evaluate.results_table([{"task": "t", "metric": "acc", "value": 0.5, "stderr": 0.01}, {"task": "u", "metric": "ppl", "value": 9.0}], {"acc": True, "ppl": False})
    assert "|acc|↑|0.5000|±|0.0100|" in table and "|ppl|↓|9.0000||N/A|" in table
    grouped = evaluate.responses_by_document(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id int, idx int, response string")).first()
    assert grouped.responses == ["a", "b"]
    squad = evaluate.squad_report(spark.createDataFrame([("the cat", ["cat", "dog"], 0.0), ("x", [], 2.0), ("x", [], 0.0)], "p string, r array<string>, na double"), "p", "r", "na").first()
    assert squad.exact == pytest.approx(200 / 3) and squad.has_answer_f1 == 100 and squad.no_answer_exact == 50


def test_instruction_checks(spark):
    text = "Title <<My Song>>\n* one [name]\n* two [date]\nThe end"
    checks = [("no_comma",), ("bullets", 2), ("placeholders", 2), ("title",), ("ends_with", "the end"), ("keywords", "ONE", "two"), ("forbidden", "three"), ("max_words", 5), ("starts_with", "title"), ("all_lower",), ("quoted",), ("json",)]
    assert run(spark, evaluate.follows(F.col("r"), checks), r=text) == [True] * 7 + [False, True, False, False, False]
    assert run(spark, evaluate.follows(F.col("r"), [("json",), ("no_comma",)]), r='```json\n{"a": 1}\n```') == [True, True]
    assert run(spark, evaluate.follows(F.col("r"), [("starts_with", "body")]), r="Sure!\nbody") == [False]
    assert run(spark, evaluate.follows(F.col("r"), [("starts_with", "body")], loose=True), r="Sure!\nbody") == [True]
    assert run(spark, evaluate.follows(F.col("r"), [("no_comma",)]), r="  ") == [False]


def test_perplexity_of_whole_texts(spark, tmp_path):
    """A text beyond 2,049 words whose end differs from its beginning."""
    spark.createDataFrame([("known",)], "query string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, "known " * 2049 + "new " * 951), (2, "known"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.ppl) for r in catalog.queries()["perplexity_scores"](spark, str(tmp_path)).collect()}
    logs = [math.log(2 / 3)] * 2049 + [math.log(1 / 3)] * 951
    assert got[1] == (3000, round(math.exp(-sum(logs) / 3000), 6)) and got[2] == (1, 1.5) and got[3] == (0, 1.0)


def test_scoring_and_cache(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b c d")], "id int, text string").repartition(2)
    first = {r.id: r.output for r in score.annotate(df, F.col("text"), score.HeuristicScorer, "test").collect()}
    assert first[2] is None and first[1].count("\n") == 14 and first == {r.id: r.output for r in score.annotate(df, F.col("text"), score.HeuristicScorer, "test", batch=1).collect()}
    logs = score.token_logprobs(df, "id", "text", lambda: score.UnigramModel({"a": 3, "b": 1}), "uni", most=2)
    got = {r.id: (r.n, r.p) for r in logs.select("id", F.size("logprobs").alias("n"), score.perplexity(F.col("logprobs")).alias("p")).collect()}
    assert got[2] == (0, 1.0) and got[3][0] == 3 and got[1][1] == pytest.approx(math.exp(-(math.log(4 / 7) + math.log(2 / 7)) / 2))
    requests = spark.createDataFrame([("q1",), ("q2",), ("q2",), (None,)], "q string").withColumn("key", score.cache_key(F.col("q")))
    cache = requests.where("q = 'q1'").select("key", F.lit("old").alias("output"))
    asked = []

    def answer(missing):
        asked.append(missing.count())
        return missing.select("key", F.lit("new").alias("output"))

    answered, grown = score.with_cache(requests, cache, answer)
    assert sorted((r.q or "", r.output) for r in answered.collect()) == [("", "new"), ("q1", "old"), ("q2", "new"), ("q2", "new")] and asked == [2] and grown.count() == 3


def test_references_and_fields(spark):
    assert run(spark, evaluate.rouge(F.col("a"), F.col("b")), a="The cat, sat", b="the cat ran") == pytest.approx(2 / 3)
    assert run(spark, evaluate.rouge(F.col("a"), F.col("b"), 2), a="the cat sat", b="a dog") == 0.0
    gap = run(spark, evaluate.reference_gap(F.col("t"), F.col("f"), lambda r: evaluate.rouge(F.col("p"), r)), t=["big cat", "cat"], f=["dog"], p="cat")
    assert (gap.best, gap.diff, gap.acc) == (1.0, 1.0, 1.0)
    logs = F.array(*[F.log(F.lit(x)) for x in (0.5, 0.25, 0.25)])
    assert run(spark, evaluate.true_mass(logs, F.array(F.lit(1), F.lit(0), F.lit(1)))) == pytest.approx(0.75)
    assert tuple(run(spark, evaluate.likelihood_preference(F.lit(-1.0), F.lit(-3.0)))) == (2.0, 1.0)
    assert run(spark, evaluate.leave_one_out(F.col("r")), r=["a", "b", "c"]) == [["b", "c"], ["a", "c"], ["a", "b"]] and run(spark, evaluate.leave_one_out(F.col("r")), r=["a"]) == [["a"]]
    df = spark.createDataFrame([("q", 2, ("z",))], "a string, n int, s struct<t: string>")
    get = lambda spec: df.select(evaluate.resolve(spec, df.columns).alias("x")).first().x
    assert [get(x) for x in ("a", "Q: {{a}} {{s.t}}", "12", "['x', 'y']", 3, ["a", "lit"], "plain")] == ["q", "Q: q z", 12, ["x", "y"], 3, ["q", "lit"], "plain"]
    with pytest.raises(ValueError):
        get("{{missing}}")
    shots = F.array(F.struct(F.lit(2).alias("shot"), F.lit("two").alias("text")), F.struct(F.lit(1).alias("shot"), F.lit("one").alias("text")))
    assert run(spark, evaluate.fewshot_context(F.lit("D. "), shots, F.lit("Q"))) == "D. one\n\ntwo\n\nQ"
