"""Running a model over rows: pluggable scorers, perplexity, and a response cache."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import METRICS


class Scorer(Protocol):
    """Answers prompts. A scorer is built once in each worker, from the factory given to ``annotate``."""

    def __call__(self, prompts: Sequence[str]) -> list[str]: ...


class HeuristicScorer:
    """A stand-in without a model: a domain letter and 14 ratings from simple counts of the text, always the same."""

    def __call__(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for p in prompts:
            words = p.split()
            distinct = len(set(words)) / max(1, len(words))
            letters = sum(c.isalpha() for c in p) / max(1, len(p))
            base = 1 + round(2 * distinct + 2 * letters)
            marks = [min(5, max(1, base + (len(words) * (i + 3)) % 3 - 1)) for i in range(len(METRICS))]
            out.append("\n".join([chr(ord("A") + len(p) % 15), *map(str, marks)]))
        return out


_scorers: dict[str, Scorer] = {}


def annotate(df: DataFrame, prompt: Column, factory: Callable[[], Scorer], name: str, output: str = "output", batch: int = 2048) -> DataFrame:
    """``df`` with the scorer's answer to ``prompt`` as ``output``; null prompts get null.

    The scorer is made once in each Python worker and kept under ``name``. Inside a batch
    prompts go longest first, so that a model pads little; the order of rows is kept.
    """
    fields = [f for f in df.schema.fields if f.name != output]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{output}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _scorers:
            _scorers[name] = factory()
        for pdf in batches:
            prompts = pdf.pop("_prompt")
            order = sorted((i for i, p in enumerate(prompts) if isinstance(p, str)), key=lambda i: -len(prompts.iloc[i]))
            answers: list[str | None] = [None] * len(prompts)
            for first in range(0, len(order), batch):
                part = order[first : first + batch]
                for i, a in zip(part, _scorers[name]([prompts.iloc[i] for i in part])):
                    answers[i] = a
            pdf[output] = answers
            yield pdf

    return df.drop(output).withColumn("_prompt", prompt).mapInPandas(run, schema)


class UnigramModel:
    """Log probability of whitespace words by add-one counts: the smallest language model that makes perplexity testable."""

    def __init__(self, counts: dict[str, int]):
        self.counts, self.total = counts, sum(counts.values()) + len(counts) + 1

    @classmethod
    def fit(cls, texts: Sequence[str]) -> UnigramModel:
        return cls(dict(Counter(w for t in texts for w in t.split())))

    def __call__(self, texts: Sequence[str], most: int | None) -> list[list[float]]:
        return [[math.log((self.counts.get(w, 0) + 1) / self.total) for w in t.split()[: None if most is None else most + 1]] for t in texts]


def token_logprobs(df: DataFrame, key: str, text: str, factory: Callable[[], Callable], name: str, most: int | None = 2048) -> DataFrame:
    """``key, logprobs``: log probability of each of the first ``most`` + 1 tokens under the model; of all tokens if that is None, for models without a context."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _scorers:
            _scorers[name] = factory()
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "logprobs": _scorers[name](["" if t is None else t for t in pdf[text]], most)})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, logprobs array<double>")


def mean_loglikelihood(logprobs: Column) -> Column:
    """Sum over the tokens divided by their number, or by 1 for none."""
    return F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(logprobs), F.lit(1))


def perplexity(logprobs: Column) -> Column:
    return F.exp(-mean_loglikelihood(logprobs))


def cache_key(*parts: Column) -> Column:
    """Key of a request: SHA-256 of its JSON."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def with_cache(requests: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all requests answered, the new cache). Both tables have ``key``; the cache has ``output``.

    Only requests the cache lacks are answered, and each distinct one once.
    """
    known = cache.dropDuplicates(["key"]).select("key", "output")
    missing = requests.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = answer(missing).select("key", "output")
    grown = known.unionByName(fresh)
    return requests.join(grown, "key", "left"), grown
