import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from siftloom.llm import bpe, budget, common  # noqa: E402

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(encoding):
    memo = bpe.Memo(bpe.memo(bpe.DEFAULT_VOCABULARY).ranks, most=50)
    rng = random.Random(5)
    letters = "abcdefgh XYZ 'll 's12 -—…中文的东西。，​­\x1c\x85\xa0　\n\r\té😀がñ"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert memo.of(s) == len(encoding.encode_ordinary(s)), repr(s)
    assert len(memo) <= 51


def test_long_and_odd_texts(encoding):
    memo = bpe.memo(bpe.DEFAULT_VOCABULARY)
    for s in ("", "a" * 5000, "中" * 3000, " " * 999, "<|endoftext|>", "é" * 400):
        assert memo.of(s) == len(encoding.encode_ordinary(s))
    assert memo.of(None) == 0


def test_budget_by_slice(spark, encoding):
    rows = [("A", "en", "B", "one two"), ("A", "en", "B", "one two"), ("A", "en", None, None), ("z", "zh", "C", "中文 text"), ("z", "zh", "C", "")]
    df = spark.createDataFrame(rows, "source string, lang string, domain_type string, text string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in budget.token_budget(df).collect()}
    n = lambda s: len(encoding.encode_ordinary(s))
    assert got == {("A", "en", "B"): (2, 14, 2 * n("one two")), ("A", "en", None): (1, 0, 0), ("z", "zh", "C"): (2, 7, n("中文 text"))}
    assert budget.token_budget(df.where("false")).count() == 0
    total = {(r.dimension, r.value): r.n_tokens for r in budget.rollup(budget.token_budget(df)).collect()}
    assert total["all", "all"] == sum(v[2] for v in got.values()) and total["source", "A"] == 2 * n("one two")


def test_sizes_keep_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 7), (2, "two words", "y", 8)], "doc_id long, text string, source string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.source) for r in common.token_sizes(df).collect()}
    assert got == {1: (0, "x"), 2: (2, "y")}


def test_clashing_and_missing_labels(spark):
    df = spark.createDataFrame([(1, "t", None, "RedPajamaC4_9", "zh-CN", "Domain: F", "extra")], "doc_id long, text string, source string, document_index string, lang string, domain_type string, rep string")
    assert tuple(common.sliced(df).first())[2:] == ("C4", "zh", "F")
