"""Tokens per source, language and domain (problem 5).

Method: every distinct piece of a batch is reduced by priority-queue merges over a
linked symbol list (see ``bpe``), its surviving symbols are weighted by the piece's
frequency, and the sums are rolled up: inside the Python worker per slice, then by
Spark's partial and final aggregation. No text is shuffled; a slice that holds a
third of all rows costs one row a batch.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

SLICE = ["source", "lang", "domain_type"]


def token_budget(texts: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, by: list[str] = SLICE) -> DataFrame:
    """Documents, code points and tokens per slice.

    ``texts`` has ``text`` and the string columns ``by``. A null text counts as a
    document of no tokens; null slice labels form a slice of their own; an empty
    table gives no row; repeated rows count each time; other columns are ignored.
    """
    schema = ", ".join(f"`{c}` string" for c in by) + ", n_docs bigint, n_chars bigint, n_tokens bigint"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = bpe.memo(vocabulary)
        for b in batches:
            found: dict[tuple, list] = defaultdict(lambda: [0, 0, Counter()])
            for *key, text in zip(*(b.column(c).to_pylist() for c in by), b.column("text").to_pylist()):
                slot = found[tuple(key)]
                slot[0] += 1
                if text:
                    slot[1] += len(text)
                    slot[2].update(bpe.pieces(text))
            rows = [(*k, n, chars, memo.weighted(c)) for k, (n, chars, c) in found.items()]
            if rows:
                cols = list(zip(*rows))
                types = [pa.string()] * len(by) + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*by, "n_docs", "n_chars", "n_tokens"])

    sums = [F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")]
    return texts.select(*by, "text").mapInArrow(reduce, schema).groupBy(*by).agg(*sums)


def rollup(budget: DataFrame, by: list[str] = SLICE) -> DataFrame:
    """Totals of each dimension alone and of everything: ``dimension, value, n_docs, n_chars, n_tokens, token_share``."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in by]
    pairs.append(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    totals = (
        budget.select(F.explode(F.array(*pairs)).alias("k"), "n_docs", "n_chars", "n_tokens")
        .groupBy("k.dimension", "k.value")
        .agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_chars", "n_tokens")])
    )
    whole = budget.agg(F.sum("n_tokens").alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("n_tokens") / F.col("whole")).otherwise(F.lit(0.0))
    return totals.join(F.broadcast(whole)).select("dimension", "value", "n_docs", "n_chars", "n_tokens", share.alias("token_share"))
