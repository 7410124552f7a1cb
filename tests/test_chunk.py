import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.operators import chunk
from siftloom.plans import catalog


def frame(spark, arrays):
    return spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id long, tokens array<int>")


def plain_chunks(t, most, overlap):
    out, start = [], 0
    while overlap + start < len(t):
        out.append(t[start : start + most])
        start += most - overlap
    return out


@pytest.mark.parametrize("most, overlap", [(2, 0), (4, 1), (8, 3), (5, 2)])
def test_chunks(spark, most, overlap):
    arrays = [list(range(n)) for n in range(20)] + [None]
    got = {}
    for r in chunk.chunk(frame(spark, arrays), "tokens", most, overlap).collect():
        got.setdefault(r.id, {})[r.position] = r.tokens
    want = {i: dict(enumerate(c)) for i, a in enumerate(arrays) if a and (c := plain_chunks(a, most, overlap))}
    assert got == want
    assert all(len(r.tokens) >= 2 for r in chunk.chunk(frame(spark, arrays), "tokens", most, overlap, 2).collect())
    with pytest.raises(ValueError):
        chunk.chunk(frame(spark, arrays), "tokens", 2, 2)


def test_packing_equals_a_running_buffer(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 99, rng.integers(0, 40)).tolist() for _ in range(60)]
    buffer, want = [], []
    for i, a in enumerate(arrays):
        buffer += a
        while len(buffer) >= 16:
            want.append((buffer[:16], i))
            buffer = buffer[16:]
    got = sorted((r.row_no, r.tokens, r.id) for r in chunk.pack_fixed(frame(spark, arrays).repartition(6), ["id"], "id", "tokens", 16).collect())
    assert [(t, i) for _, t, i in got] == want


@pytest.mark.parametrize("text, sep, least, include, want", [
    ("aa bb cc dd", " ", 3, False, ["aa bb", "cc dd"]), ("aa bb cc dd", " ", 3, True, ["aa bb ", "cc dd"]), ("abc", "", 2, False, ["abc"]), ("", " ", 2, False, []), ("a  b", " ", 0, False, ["a", "b"]), ("abc", " ", -1, False, ["abc"]),
])
def test_presplit(spark, text, sep, least, include, want):
    assert chunk.split_min_chars(text, sep, least, include) == want
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert [r.text for r in chunk.presplit(df, "text", sep, least, include).orderBy("id", "piece").collect()] == want


@pytest.mark.parametrize("most, context", [(10, 1), (10, 8), (10, 10), (2, 1)])
def test_rolling_windows(spark, most, context):
    """Every token is predicted once and in order, from inputs that end one before it and are as long as they can be."""
    df = spark.createDataFrame([(n,) for n in (0, 1, 9, 10, 11, 30, 34)], "n int").select("n", chunk.rolling_windows(F.col("n"), most, context).alias("w"))
    for r in df.collect():
        assert [p for w in r.w for p in range(w.target_start, w.target_end)] == list(range(r.n))
        for k, w in enumerate(r.w):
            assert w.input_end == w.target_end - 1 and w.input_end - w.input_start == (min(most, r.n) if k == 0 else most)
            new = w.target_end - w.target_start
            assert new == (min(most, r.n) if k == 0 else most - context + 1) or (k == len(r.w) - 1 and 0 < new < most - context + 1)


@pytest.mark.parametrize("n, most, context, want", [
    (5, 4, 1, [(-1, 3, 0, 4), (0, 4, 4, 5)]), (6, 4, 3, [(-1, 3, 0, 4), (1, 5, 4, 6)]), (3, 4, 4, [(-1, 2, 0, 3)]), (4, 2, 2, [(-1, 1, 0, 2), (0, 2, 2, 3), (1, 3, 3, 4)]),
])
def test_rolling_windows_worked(spark, n, most, context, want):
    got = spark.range(1).select(chunk.rolling_windows(F.lit(n), most, context).alias("w")).first().w
    assert [tuple(w) for w in got] == want


def test_disjoint_windows(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5], [2, 3, 4, 5, 6]), ([1, 2, 3, 4, 5], [4, 5, 6])], "a array<int>, b array<int>")
    got = [r.x for r in row.select(chunk.disjoint(F.col("a"), F.col("b"))[0].alias("x")).collect()]
    assert got == [[1], [1, 2, 3]]


def test_masks_and_padding(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [4, 5])], "id int, p array<int>, r array<int>")
    m = df.select(chunk.loss_mask(F.col("p"), F.col("r"), 4).alias("m")).first().m
    assert m.input_ids == [1, 2, 3, 4] and m.labels == [-100, -100, -100, 4]
    padded = {r.id: (r.tokens, r.attention_mask) for r in chunk.pad_batches(frame(spark, [[1, 2, 3], [4], [5, 6]]).withColumn("b", F.col("id") % 2), "tokens", "b").collect()}
    assert padded == {0: ([1, 2, 3], [1, 1, 1]), 1: ([4], [1]), 2: ([5, 6, 0], [1, 1, 0])}
    chat = spark.createDataFrame([([("system", "abc"), ("user", "de"), ("assistant", "fg")],)], "m array<struct<role: string, content: string>>")
    encode = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    x = chat.select(chunk.chat_loss_mask(F.col("m"), encode, 9).alias("x")).first().x
    assert x.input_ids == [*map(ord, "abcdefg"), 0, 0] and x.labels == [-100] * 5 + [102, 103, -100, -100] and x.attention_mask == [1] * 7 + [0, 0]


def test_random_chunk_and_infill(spark):
    df = frame(spark, [list(range(100, 150)), [1, 2], None])
    got = {r.id: r.tokens for r in chunk.random_chunk(df, "tokens", 8, "id").collect()}
    assert len(got[0]) == 8 and got[0] == list(range(got[0][0], got[0][0] + 8)) and got[1] == [1, 2]
    masks = [-1, -2, -3, -4]
    for r in chunk.span_infill(df, "tokens", "id", masks).collect():
        t = {0: list(range(100, 150)), 1: [1, 2], 2: []}[r.id]
        body, learned = [x for x, y in zip(r.input_ids, r.labels) if y == -100], [y for y in r.labels if y != -100]
        spans, cur = {}, None
        for x in learned:
            if x in masks:
                cur = spans.setdefault(x, [])
            else:
                cur.append(x)
        assert [y for x in body for y in (spans[x] if x in spans else [x])] == t
        assert r.id != 0 or spans


def test_whole_chats_learn_every_answer(spark, tmp_path):
    prompt, answer = " ".join(["ask"] * 100), " ".join(["word"] * 90)
    message = "struct<model: string, messages: array<struct<role: string, content: string>>>"
    rows = [(1, ("m", [("user", prompt)]), answer), (2, ("m", [("user", "one two")]), None), (3, ("m", [("user", "one")]), "a b")]
    spark.createDataFrame(rows, f"request_id long, request_json {message}, gpt_response string").write.parquet(f"{tmp_path}/gpt_responses.parquet")
    got = {r.request_id: tuple(r)[1:] for r in catalog.queries()["chat_loss_mask"](spark, str(tmp_path)).collect()}
    assert got == {1: (190, 190, 90, 660), 2: (2, 2, 0, 6), 3: (3, 3, 2, 5)}
