"""Token arrays cut, packed, windowed, masked and padded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.numeric import draw
from siftloom.functions.text import bound

from siftloom.session import checkpointed

from .prefix import BROADCAST_ROWS, running_total


def chunk_starts(n: Column, most: int, overlap: int) -> Column:
    """Number of overlapping chunks of a text of ``n`` tokens: none for ``n <= overlap``."""
    return F.greatest(F.ceil((n - overlap) / (most - overlap)), F.lit(0)).cast("int")


def chunk(df: DataFrame, tokens: str, most: int, overlap: int = 0, least: int = 1) -> DataFrame:
    """One row a chunk: other columns, ``position`` and the chunk as ``tokens``.

    Chunk k starts at ``k * (most - overlap)`` and has at most ``most`` tokens; chunks under
    ``least`` tokens, only ever the last, are dropped. Null and short texts give no row.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be under the chunk size")
    step, keep = most - overlap, [c for c in df.columns if c != tokens]
    k = chunk_starts(F.size(tokens), most, overlap)
    cut = bound(F.col(tokens), lambda t: F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(t, i * step + 1, most))))
    return df.select(*keep, F.posexplode(cut).alias("position", tokens)).where(F.size(tokens) >= least)


def random_start(n: Column, most: int, key: Column, seed: int = 42) -> Column:
    """Where the chunk of ``most`` of ``n`` tokens begins, drawn from the key."""
    return (draw(F.lit(seed), key) % (F.greatest(n - most, F.lit(0)) + 1)).cast("int")


def random_chunk(df: DataFrame, tokens: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """One chunk a text at a seeded offset; shorter texts whole."""
    start = random_start(F.size(tokens), most, F.col(key), seed)
    return df.withColumn(tokens, F.slice(F.col(tokens), (start + 1).cast("int"), F.lit(most)))


def split_min_chars(text: str, separator: str, least: int, include: bool = False) -> list[str]:
    """Pieces of a text, each cut at the first separator at or after ``least`` characters; no empty pieces."""
    if not separator or least < 0:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        at = text.find(separator, start + least)
        end = len(text) if at < 0 else at + (len(separator) if include else 0)
        if end > start:
            out.append(text[start:end])
        start = len(text) if at < 0 else at + len(separator)
    return out


def presplit(df: DataFrame, text: str, separator: str, least: int, include: bool = False) -> DataFrame:
    """One row a piece: other columns, ``piece`` number and the piece as ``text``. Null and empty texts give none."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_min_chars(t, separator, least, include) if t else [])

    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(cut(text)).alias("piece", text))


def pack_fixed(chunks: DataFrame, order: list[str], label: str, tokens: str, most: int) -> DataFrame:
    """Chunks laid end to end in ``order`` and cut into rows of exactly ``most`` tokens: ``row_no, label, tokens``.

    ``label`` is that of the chunk that completes the row; the last, partial row is dropped.
    ``order`` names a chunk: its columns are not null and no two chunks are equal in them.
    """
    sized = chunks.select(*dict.fromkeys([*order, label]), tokens, F.size(tokens).alias("n")).where("n > 0")
    # Places are summed over the order and sizes alone; the arrays join them once.
    stops = checkpointed(running_total(sized.select(*order, "n"), [], [F.col(c) for c in order], {"stop": F.col("n")}).drop("n"))
    placed = sized.join(F.broadcast(stops) if stops.count() <= BROADCAST_ROWS else stops, order).withColumn("start", F.col("stop") - F.col("n"))
    whole = stops.agg((F.floor(F.max("stop") / most) * most).alias("kept"))
    rows = F.explode(F.sequence(F.floor(F.col("start") / most), F.floor((F.col("stop") - 1) / most))).alias("row_no")
    parts = placed.crossJoin(F.broadcast(whole)).where("start < kept").select("*", rows).where(F.col("row_no") * most < F.col("kept"))
    low, high = F.greatest(F.col("row_no") * most, F.col("start")), F.least((F.col("row_no") + 1) * most, F.col("stop"))
    piece = F.slice(F.col(tokens), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    packed = parts.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct(low.alias("at"), F.col(label).alias("label"), piece.alias("piece")))).alias("p"))
    return packed.select("row_no", F.element_at("p", -1)["label"].alias(label), F.flatten(F.transform("p", lambda x: x["piece"])).alias(tokens))


def rolling_windows(n: Column, most: int, context: int) -> Column:
    """Windows of a rolling log-likelihood over ``n`` tokens: array of ``(input_start, input_end, target_start, target_end)``.

    The first window predicts ``min(most, n)`` tokens from a prefix token (input start -1);
    each next one predicts ``most - context + 1`` more, the last what is left, always with
    the longest context that fits. Positions are 0-based, ends exclusive; none for n = 0.
    """
    step = most - context + 1
    first = F.least(n, F.lit(most))
    more = F.greatest(F.ceil((n - first) / step), F.lit(0)).cast("int")
    window = lambda a, b, c, d: F.struct(a.cast("int").alias("input_start"), b.cast("int").alias("input_end"), c.cast("int").alias("target_start"), d.cast("int").alias("target_end"))
    head = F.array(window(F.lit(-1), first - 1, F.lit(0), first))

    def later(k: Column) -> Column:
        begin = first + k * step
        end = F.least(begin + step, n)
        return window(end - most - 1, end - 1, begin, end)

    tail = F.when(more > 0, F.transform(F.sequence(F.lit(0), more - 1), later)).otherwise(F.array().cast("array<struct<input_start:int,input_end:int,target_start:int,target_end:int>>"))
    return F.when(n > 0, F.concat(head, tail)).otherwise(F.array().cast("array<struct<input_start:int,input_end:int,target_start:int,target_end:int>>"))


def disjoint(inputs: Column, targets: Column) -> tuple[Column, Column]:
    """A window whose context ends where its targets begin: the last ``size(targets) - 1`` inputs are cut off."""
    return F.slice(inputs, F.lit(1), F.greatest(F.size(inputs) - F.size(targets) + 1, F.lit(0))), targets


def loss_mask(prompt: Column, response: Column, most: int, ignore: int = -100) -> Column:
    """``input_ids, labels`` of a prompt and response: prompt labels ignored, both cut to ``most``."""
    ids = F.slice(F.concat(prompt, response), 1, most)
    labels = F.slice(F.concat(F.transform(prompt, lambda x: F.lit(ignore)), response), 1, most)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def chat_loss_mask(messages: Column, encode: Callable[[Column], Column], most: int | None, pad: int = 0, ignore: int = -100) -> Column:
    """``input_ids, labels, attention_mask`` of a chat: only assistant turns are learned, right-padded or cut to ``most``; whole and without padding if that is None."""
    ids = F.flatten(F.transform(messages, lambda m: encode(m["content"])))
    labels = F.flatten(F.transform(messages, lambda m: F.when(m["role"] == "assistant", encode(m["content"])).otherwise(F.transform(encode(m["content"]), lambda x: F.lit(ignore)))))
    fill = lambda a, v: a if most is None else F.slice(F.concat(a, F.array_repeat(F.lit(v), F.greatest(F.lit(most) - F.size(a), F.lit(0)).cast("int"))), 1, most)
    return F.struct(fill(ids, pad).alias("input_ids"), fill(labels, ignore).alias("labels"), fill(F.transform(ids, lambda x: F.lit(1)), 0).alias("attention_mask"))


def pad_batches(df: DataFrame, tokens: str, batch: str, pad: int = 0) -> DataFrame:
    """Token arrays right-padded to the longest of their batch, with ``attention_mask``."""
    most = df.groupBy(batch).agg(F.max(F.size(tokens)).alias("_most"))
    missing = F.greatest(F.col("_most") - F.size(tokens), F.lit(0))
    return df.join(most, batch).withColumns({
        "attention_mask": F.concat(F.transform(F.col(tokens), lambda x: F.lit(1)), F.array_repeat(F.lit(0), missing)),
        tokens: F.concat(F.col(tokens), F.array_repeat(F.lit(pad), missing)),
    }).drop("_most")


def span_infill(df: DataFrame, tokens: str, key: str, mask_ids: list[int], rate: float = 0.15, mean_span: float = 3.0, seed: int = 42) -> DataFrame:
    """Spans replaced by mask ids, followed by each mask id and what it stands for: ``input_ids, labels``.

    About ``rate`` of the tokens go into spans of ``mean_span`` tokens on average; the draw
    depends on ``key`` and ``seed`` alone. Spans never touch; texts too short keep all tokens.
    """
    import numpy as np
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ins, outs = [], []
            for k, t in zip(pdf[key], pdf[tokens]):
                t = [] if t is None else [int(x) for x in t]
                rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}:{k}"))
                spans = min(len(mask_ids), int(round(len(t) * rate / mean_span)), (len(t) - 1) // 2)
                inputs, labels = list(t), [-100] * len(t)
                if spans > 0:
                    total = max(spans, min(int(round(len(t) * rate)), len(t) - spans - 1))
                    cuts = np.sort(rng.choice(total - 1, spans - 1, replace=False)) + 1 if spans > 1 else np.array([], int)
                    sizes = np.diff([0, *cuts, total])
                    gaps = np.sort(rng.choice(len(t) - total - 1, spans, replace=False)) if len(t) - total - 1 >= spans else np.arange(spans)
                    inputs, target, at, used = [], [], 0, 0
                    for m, size, gap in zip(mask_ids, sizes, gaps):
                        start = int(gap) + 1 + used
                        inputs += [*t[at:start], m]
                        target += [m, *t[start : start + int(size)]]
                        at, used = start + int(size), used + int(size)
                    inputs += t[at:]
                    labels = [-100] * len(inputs) + target
                    inputs = inputs + target
                ins.append(inputs)
                outs.append(labels)
            yield pd.DataFrame({key: pdf[key], "input_ids": ins, "labels": outs})

    kind = dict(df.dtypes)[key]
    return df.select(key, tokens).mapInPandas(run, f"`{key}` {kind}, input_ids array<int>, labels array<int>")


def span_restore(input_ids: Column, labels: Column) -> Column:
    """The tokens that ``span_infill`` took apart: each mark, a negative id, is followed by what it stands for in the learned part."""
    body = F.filter(F.zip_with(input_ids, labels, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"] == -100)
    learned = F.filter(labels, lambda y: y != -100)

    def of(mark: Column) -> Column:
        at = F.array_position(learned, mark).cast("int")
        rest = F.slice(learned, at + 1, F.size(learned))
        end = F.array_position(F.transform(rest, lambda x: x < 0), True).cast("int")
        return F.slice(rest, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(rest)))

    return F.flatten(F.transform(body, lambda p: F.when(p["x"] < 0, of(p["x"])).otherwise(F.array(p["x"]))))
