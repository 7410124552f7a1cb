import string

import pytest
from pyspark.sql import functions as F

from siftloom.functions import labels, numeric, text
from siftloom.operators import evaluate


def one(spark, column, **values):
    """A column evaluated over one row of literals."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if v is not None else F.lit(None).cast("string"))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("CommonCrawl", "CommonCrawl"), ("commoncrawl ", "CommonCrawl"), ("RedPajamaC4", "C4"), ("zh_web_v2.jsonl", "zh_web_v2"), ("/data/x/en_news.jsonl.zst", "en_news"), (" ", None), (None, None), ("\tBook\n", "Book"),
])
def test_sources(spark, raw, want):
    assert one(spark, labels.canonical_source(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("F", "F"), ("f", "F"), ("[F]", "F"), ("Domain: F", "F"), ("Entertainment", "F"), ("娱乐", "F"), (" [ b ] ", "B"), ("P", "unknown"), ("N/A", "unknown"), ("", "unknown"), (None, "unknown"), ("FG", "unknown"),
])
def test_domains(spark, raw, want):
    assert one(spark, labels.canonical_domain(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, want", [("zh-CN", "zh"), ("EN", "en"), ("english ", "en"), (None, "und"), ("", "und"), ("fr", "fr")])
def test_langs(spark, raw, want):
    assert one(spark, labels.canonical_lang(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, want", [(None, None), ("", None), ("0", None), ("6", None), ("05", 5), ("4.5", None), ("a", None), ("²", None), (" 3", None), ("５", None), ("3", 3)])
def test_ratings(spark, raw, want):
    assert one(spark, labels.rating(F.col("s")), s=raw) == want


@pytest.mark.parametrize("raw, source, line", [("a_b_7", "a_b", 7), ("x", None, None), ("x_y", "x", None), (None, None, None), ("_3", None, 3)])
def test_ids(spark, raw, source, line):
    assert one(spark, labels.source_of_id(F.col("s")), s=raw) == source and one(spark, labels.line_of_id(F.col("s")), s=raw) == line


def test_cleaning_and_counts(spark):
    t = '"..."Body ![](/a/b.png)\nrest'
    assert one(spark, text.clean_text(F.col("s")), s=t) == "Body rest"
    assert one(spark, text.clean_text(F.col("s")), s="x\n\"...\"y") == "x\n\"...\"y"
    assert [one(spark, f(F.col("s")), s=" a  b é") for f in (text.word_count, text.trimmed_word_count, text.byte_count)] == [4, 3, 8]
    assert one(spark, text.word_count(F.col("s")), s=None) == 0 and one(spark, text.trimmed_word_count(F.col("s")), s=" ") == 0


def test_ngram_form_is_ascii_only(spark):
    s = "Don't STOP—Été, (ok)! " + string.punctuation
    want = s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation))
    assert one(spark, text.ngram_form(F.col("s")), s=s) == want


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_word_ngrams(spark, n):
    w = "a b  c d".split()
    assert one(spark, text.word_ngrams(F.col("s"), n), s=" a b  c d ") == [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    assert one(spark, text.word_ngrams(F.col("s"), n), s=None) == []


@pytest.mark.parametrize("n", range(0, 9))
def test_truncation(spark, n):
    t = [str(i) for i in range(n)]
    got = spark.createDataFrame([(t,)], "t array<string>").select(text.truncate_middle(F.col("t"), 5).alias("a"), text.truncate_keep(F.col("t"), 5, 2).alias("b")).first()
    assert got.a == (t if n <= 5 else t[:2] + ["..."] + t[-3:]) and got.b == (t if n <= 5 else t[:2] + t[-2:])
    assert one(spark, text.truncate_chars(F.col("s"), 5), s="".join(t)) == ("".join(t) if n <= 5 else "".join(t)[:2] + "".join(t)[-3:])


def test_answer_forms(spark):
    assert one(spark, text.answer_form(F.col("s")), s=" The Cat's  hat, a an ") == "cats hat"
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a="red red cat", b="red cat cat") == pytest.approx(2 / 3)
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a="the", b="x") == 0
    assert one(spark, text.number_aware_form(F.col("s")), s="The 3 cats") == "3.0 cats"
    assert one(spark, text.clean_answer(F.col("s")), s="Yes.\nNo!") == "yes no"


def test_detokenizers(spark):
    assert one(spark, text.general_detokenize(F.col("s")), s="do n't ( go ) , now .") == "don't (go), now."
    assert one(spark, text.wikitext_detokenize(F.col("s")), s="a @-@ b , ( c ) = = x") == "a-b, (c) == x"
    assert one(spark, text.hellaswag_detokenize(F.col("s")), s=" Open [title] the [step] door  now ") == "Open. the door now"
    assert one(spark, text.dialogue_detokenize(F.col("s")), s="it 's `` ok '' .") == 'it\'s "ok".'


def test_small_functions(spark):
    assert one(spark, text.escaped_split(F.col("s"), ","), s="a,b\\,c,d") == ["a", "b\\,c", "d"]
    assert one(spark, text.sanitized(F.col("s")), s='a/b:"c"') == "a__b__c__"
    assert one(spark, text.template("x {a} $1 {b}", a=F.col("a"), b=F.col("b")), a="{b}$0", b=None) == "x {b}$0 $1 "
    with_, without = "I:{instruction} J:{input}", "I:{instruction}"
    assert one(spark, text.instruction_prompt(F.col("a"), F.col("b"), with_, without), a="q", b="") == "I:q"
    assert one(spark, text.instruction_prompt(F.col("a"), F.col("b"), with_, without), a="q", b="z") == "I:q J:z"
    soft = one(spark, text.softmax(F.array(F.lit(1.0), F.lit(2.0))))
    assert sum(soft) == pytest.approx(1) and soft[1] / soft[0] == pytest.approx(2.718281828, rel=1e-6)
    assert [round(one(spark, text.emotion_scale(F.lit(float(x)))), 3) for x in (0, 4, 7)] == [0.0, 3.25, 7.0]
    assert 0 <= one(spark, text.stable_bucket(F.col("s"), 500), s="x") < 500
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None


def test_correlation_of_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "x double, y double")
    assert df.agg(numeric.correlation(F.col("x"), F.col("y")).alias("c")).first().c is None


def test_latex_and_bags(spark):
    assert evaluate.boxed_answer(r"so \boxed{a} then \boxed{\frac{1}{2}}.") == r"\frac{1}{2}" and evaluate.boxed_answer("none") is None
    equal = [(r"\frac12", r"\dfrac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("x=3", "3"), (r"\sqrt3", r"\sqrt{3}"), ("3/4", r"\frac{3}{4}"), (r"10\text{ cm}", "10"), (r"90^\circ", "90"), (".25", "0.25"), (r"\frac{a}b", r"\frac{a}{b}"), (None, None), (r"50\%", "50"), (r"\left( 1, 2 \right)", "(1,2)"), (r"2\sqrt 5+\tfrac34", r"2\sqrt{5}+\frac{3}{4}")]
    other = [("3", "4"), ("3", None), (r"\frac12", r"\frac21"), ("long=3", "3")]
    df = spark.createDataFrame([(a, b, True) for a, b in equal] + [(a, b, False) for a, b in other], "a string, b string, same boolean")
    wrong = [tuple(r) for r in df.select("a", "b", "same", evaluate.latex_equal(F.col("a"), F.col("b")).alias("x")).collect() if r.x != r.same]
    assert not wrong
    assert evaluate.bag_f1(["red cat", "dog"], ["dog", "red cat"]) == 1.0 and evaluate.bag_f1(["3 cats"], ["4 cats"]) == 0.0 and evaluate.bag_f1([], ["x"]) == 0.0
    assert evaluate.bag_f1(["a b"], ["a b", "c"]) == 0.5


def test_multiset_overlap_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a", None], ["a", "a", "a", "c"]), ([], ["a"]), (["x"] * 500, ["x"] * 300 + ["y"])], "a array<string>, b array<string>")
    assert [r.n for r in df.select(text.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 0, 300]
