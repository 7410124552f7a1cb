import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftloom.functions.labels import METRICS
from siftloom.operators import filters, parse, rater, stats

NAMES = ["Textual Accuracy", "Semantic Coherence", *[f"Criterion {i}" for i in range(3, 14)], "Overall Score"]


def answer(scores=None, domain="Domain Type: [B]Finance"):
    return "\n".join(f"[{i + 1}]{n}: {s}/5" for i, (n, s) in enumerate(zip(NAMES, scores or [1, 2, 3, 4, 5, 1.5, 2.5, 3.5, 4.5, 1, 2, 3, 4, 5]))) + "\n" + domain


ONE = [3] * 14
CASES = [
    ("error", answer(), "api_failure"), (None, answer(), "api_failure"), ("success", answer().replace("[1]Textual Accuracy: 1/5", "[1]Textual Accuracy: N/A"), "na_present"),
    ("success", None, "no_scores"), ("success", "nothing", "no_scores"), ("success", "[1]Textual Accuracy: 3/5", "too_few"), ("success", answer() + "\n" + answer(ONE)[:60], "too_many"),
    ("success", answer(ONE) + "\n" + answer([4] * 14), "conflicting"), ("success", answer(ONE, "") + "\n" + answer(ONE), "ok"), ("success", answer(domain="none").replace("[", "(").replace("]", ")"), "no_category"),
    ("success", answer() + "\nDomain Type: [C]Law", "several_categories"), ("success", answer(), "ok"),
]


def test_every_failure_class(spark):
    df = spark.createDataFrame([(i, s, a) for i, (s, a, _) in enumerate(CASES)], "i int, status string, answer string")
    got = {r.i: r for r in parse.accept(df, "en").collect()}
    assert {i: r.outcome for i, r in got.items()} == {i: c[2] for i, c in enumerate(CASES)}
    assert got[len(CASES) - 1].scores == [1, 2, 3, 4, 5, 1.5, 2.5, 3.5, 4.5, 1, 2, 3, 4, 5] and got[len(CASES) - 1].category == "B"
    typed = {r.i: r for r in parse.typed_ratings(parse.accept(df, "en")).collect()}
    last = typed[len(CASES) - 1]
    assert [last[m] for m in METRICS] == [1, 2, 3, 4, 5, 1, 2, 4, 5, 1, 2, 3, 4, 5]


def test_chinese_answers_keep_whole_scores(spark):
    text = "\n".join(f"[{i + 1}]指标：{4.5 if i else 2}/5" for i in range(14)) + "\n领域类型：[F]娱乐"
    row = parse.accept(spark.createDataFrame([("success", text)], "status string, answer string"), "zh").first()
    assert row.outcome == "ok" and row.scores == [2.0] + [4.5] * 13 and row.category == "F"


def test_chinese_numbers_must_be_closed(spark):
    """A bracketed number counts only as an item of its own: not with another digit or word inside."""
    odd = ["[15]附注：3/5", "[1]：4/5", "[2019年]：5/5"]
    df = spark.createDataFrame([(x,) for x in [*odd, "[14]总评：3/5"]], "a string")
    assert [list(r.s) for r in df.select(parse.scores(F.col("a"), "zh").alias("s")).collect()] == [[], [], [], [3.0]]


def test_requests_and_texts(spark):
    docs = spark.createDataFrame([("en_a_7", '"..."Some $1 {text} body'), ("b_1", None)], "document_index string, text string")
    built = {r["index"]: r.request_json for r in parse.build_requests(docs, "document_index", "text", "Rate:\nText: {text}\nDomain Types: x", "m", 0.5, 9).collect()}
    content = built["en_a_7"].messages[0].content
    assert content == "Rate:\nText: Some $1 {text} body\nDomain Types: x" and built["en_a_7"].temperature == 0.5 and built["b_1"].messages[0].content == "Rate:\nText: \nDomain Types: x"
    texts = spark.createDataFrame([(content,), ("no form",)], "r string").select(parse.original_text(F.col("r"), "en").alias("t")).collect()
    assert [r.t for r in texts] == ["Some $1 {text} body", None]
    assert parse.build_sample(docs, "document_index", F.lit("q"), F.lit("a")).first().source == "en_a"
    assert parse.build_sample(docs, "document_index", F.lit("q"), F.lit("a"), "qwen").first().conversations[0]["from"] == "user"
    with pytest.raises(ValueError):
        parse.build_sample(docs, "document_index", F.lit("q"), F.lit("a"), "x")
    assert parse.detail_text(docs, "document_index", docs, "document_index", "text").count() == 2
    assert [r.document_index for r in parse.exclude_existing(docs, "document_index", docs.limit(1), "document_index").collect()] == ["b_1"]
    assert spark.range(1).select(parse.domain_name(F.lit("B")).alias("a"), parse.domain_name(F.lit("Z")).alias("b"), parse.domain_name(F.lit("B"), "zh").alias("c")).first()[:] == ("Finance", None, "金融")


def test_model_output(spark):
    df = spark.createDataFrame([("C\n" + "\n".join("3" * 14),), ("C\n3",), (None,)], "output string")
    assert [r.overall_score for r in parse.parse_model_output(df, "output").collect()] == ["3"]
    assert parse.parse_model_output(df, "output", False).count() == 3


def test_validity_and_audits(spark):
    bad = [None, "", "0", "6", "4.5", "a", "²", " 3", "3", "05"]
    df = spark.createDataFrame([(v, "3") for v in bad], "a string, b string")
    assert [r.ok for r in df.select(filters.all_valid(["a", "b"]).alias("ok")).collect()] == [False] * 8 + [True] * 2
    audit = lambda x: filters.audit_ids(spark.createDataFrame([(i,) for i in x], "i long"), F.col("i")).first().complete
    assert audit([3, 1, 2]) and not audit([1, 3]) and not audit([1, 1, 2]) and audit([])
    assert filters.keep_columns(df, ["b", "none"]).columns == ["b"] and filters.rename_columns(df, ["a"], ["c"]).columns == ["c", "b"]
    nested = spark.createDataFrame([(("x",),)], "m struct<n: string>")
    assert nested.select(filters.field(nested, "m.n").alias("v")).first().v == "x"


@pytest.fixture(scope="module")
def ratings():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 300), "t": rng.integers(1, 6, 300), "p": rng.integers(1, 6, 300)})
    pdf["p"] = np.where(rng.random(300) < 0.5, pdf["t"], pdf["p"])
    return pdf


def test_rater_reports(spark, ratings):
    df = spark.createDataFrame(ratings)
    got = {r.g: r for r in rater.score_report(df, ["g"], "t", "p").collect()}
    classes = {r.g: r for r in rater.class_report(df, ["g"], "t", "p").collect()}
    for g, part in ratings.groupby("g"):
        t, p = part["t"], part["p"]
        low = t < 3
        assert got[g].accuracy_5 == pytest.approx((t == p).mean()) and got[g].accuracy_2 == pytest.approx(((t < 3) == (p < 3)).mean())
        assert got[g].negative_accuracy == pytest.approx((p[low] < 3).mean()) and got[g].positive_accuracy == pytest.approx((p[~low] >= 3).mean())
        assert got[g].miss_1 == pytest.approx(((t < 2) & (p >= 3)).sum() / low.sum()) and got[g].misjudge_1 == pytest.approx(((t >= 4) & (p < 3)).sum() / (~low).sum())
        assert got[g].pearson == pytest.approx(t.corr(p))
        f1, recalls = [], []
        for k in sorted(set(t) | set(p)):
            both = ((t == k) & (p == k)).sum()
            f1.append(2 * both / ((t == k).sum() + (p == k).sum()))
            if (t == k).any():
                recalls.append(round(both / (t == k).sum(), 3))
        assert classes[g].macro_f1 == pytest.approx(np.mean(f1)) and classes[g].recall_variance == pytest.approx(np.var(recalls), abs=1e-6)
    cases = rater.false_cases(df, "t", "p").groupBy("case").count().collect()
    assert {r["case"]: r["count"] for r in cases} == {"miss": int(((ratings.t < 2) & (ratings.p >= 3)).sum()), "misjudge": int(((ratings.t >= 4) & (ratings.p <= 2)).sum())}
    empty = rater.score_report(df.where("t >= 3"), ["g"], "t", "p").first()
    assert empty.negative_accuracy is None and empty.miss_1 is None


def test_statistics_against_pandas(spark, ratings):
    df = spark.createDataFrame(ratings)
    corr = stats.correlations(df, "t", ["p"]).first()
    ranks = ratings[["t", "p"]].rank()
    assert corr.spearman == pytest.approx(ranks["t"].corr(ranks["p"])) and corr.pearson == pytest.approx(ratings["t"].corr(ratings["p"]))
    assert stats.pearson_matrix(df, ["t", "p"]).first().pearson == pytest.approx(corr.pearson)
    m = {r.criterion: r for r in stats.mean_and_variance(df, ["t", "p"]).collect()}
    assert m["t"].variance == pytest.approx(ratings["t"].var()) and {r.place for r in m.values()} == {1, 2}
    gap = {r.g: r.gap for r in stats.good_bad_gap(df, "g", "t").collect()}
    assert gap == pytest.approx({g: (x["t"] >= 3).mean() - (x["t"] < 3).mean() for g, x in ratings.groupby("g")})
    diff = {r.g: r for r in stats.discrepancy(df.where("g <> 'c'"), df.where("g <> 'a'"), ["g"], ["t"]).collect()}
    assert set(diff) == {"a", "b", "c"} and diff["a"].n_2 == 0 and diff["b"].t_diff == pytest.approx(0) and diff["c"].t_diff is None
    assert stats.mean_ignoring_nan(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"), ["x"]).first()[:] == (1.0, 1)
    logs = spark.createDataFrame([("a", -1.0), ("a", -2.0), (None, -1.0), ("b", None)], "d string, ll double")
    ppl = {r.domain: r.perplexity for r in stats.mean_perplexity(logs, "d", "ll").collect()}
    e = np.e
    assert ppl == pytest.approx({"a": (e + e**2) / 2, "unknown": e, "all": (2 * e + e**2) / 3})
    steps = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1), (4, float("nan"))], "step int, eval_loss double")
    assert [r.step for r in stats.least_k(steps, "eval_loss", 2, "step").collect()] == [3, 1]
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-100",), ("x",)], "n string")
    number = F.expr("try_cast(regexp_extract(n, '-([0-9]+)$', 1) as int)")
    assert [r.n for r in stats.greatest_k(names, number, 1).collect()] == ["checkpoint-100"]
    assert stats.length_statistics(steps, F.col("step"), 2).first().n_truncated == 2
