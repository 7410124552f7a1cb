"""N-gram contamination: document frequencies, overlap with held-out texts, cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.text import LOWER, PUNCTUATION, UPPER, ngram_form, word_ngrams
from siftloom.session import checkpointed

_TABLE = str.maketrans(UPPER + PUNCTUATION, LOWER + "\0" * len(PUNCTUATION))
#: Most n-grams of held-out texts that are sent to every task, about 100 MB; more are joined by shuffle.
BROADCAST_GRAMS = 1_000_000


def _normal(s: str) -> str:
    return s.translate(_TABLE).replace("\0", "")


def gram_table(df: DataFrame, key: str, text: str, n: int = 13) -> DataFrame:
    """``ngram, key``, distinct: the runs of ``n`` words of each text in normal form."""
    return df.select(F.col(key), F.explode(F.array_distinct(word_ngrams(ngram_form(F.col(text)), n))).alias("ngram"))


def _grams(text: str, n: int) -> Column:
    return F.array_distinct(word_ngrams(ngram_form(F.col(text)), n))


def frequent_ngrams(df: DataFrame, key: str, text: str, n: int = 13, more_than: int = 10) -> DataFrame:
    """``ngram, n_docs`` of n-grams in more than so many distinct texts. Texts count once each, so no distinct count is needed.

    Counted as 64-bit hashes first, an eighth of the strings; then as strings where the hash
    is frequent, so n-grams of one hash are told apart. ``df`` is read twice.
    """
    hashed = df.select(F.explode(F.array_distinct(F.transform(_grams(text, n), lambda g: F.xxhash64(g)))).alias("h"))
    often = checkpointed(hashed.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > more_than).select("h"))
    often = F.broadcast(often) if often.count() <= BROADCAST_GRAMS else often
    grams = df.select(F.explode(_grams(text, n)).alias("ngram")).withColumn("h", F.xxhash64("ngram"))
    return grams.join(often, "h").groupBy("ngram").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > more_than)


def overlap(train: DataFrame, key: str, text: str, held_out: DataFrame, held_key: str, held_text: str, n: int = 13) -> DataFrame:
    """``held_key, n_grams, n_docs``: held-out texts with an n-gram in some training text.

    The n-grams of the held-out side are sent to every task up to ``BROADCAST_GRAMS``, so of
    the training side only hits are shuffled; beyond, both sides are joined by shuffle.
    """
    wanted = checkpointed(gram_table(held_out, held_key, held_text, n))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_GRAMS else wanted
    hits = gram_table(train, key, text, n).join(wanted, "ngram")
    return hits.groupBy(held_key).agg(F.countDistinct("ngram").alias("n_grams"), F.countDistinct(key).alias("n_docs"))


def _first_words(grams: set[str]) -> frozenset[str]:
    return frozenset(g.split(" ", 1)[0] for g in grams)


def split_words(text: str) -> list[tuple[int, int]]:
    """(start, end exclusive) of each run without white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def dirty_spans(text: str, dirt: set[str], n: int, first: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """Spans of the word n-grams whose normal form is registered, end exclusive.

    ``first`` may hold the first words of the registered n-grams: only runs that begin with one are looked up.
    """
    at = split_words(text)
    if len(at) < n or not dirt:
        return []
    words = _normal("\n".join([text[a:b] for a, b in at])).split("\n")
    found = []
    for i in range(len(words) - n + 1):
        if (first is None or words[i] in first) and " ".join(words[i : i + n]) in dirt:
            found.append((at[i][0], at[i + n - 1][1]))
    return found


def clean_intervals(hits: Column, length: Column, window: int = 200, most: int = 10, least: int = 200) -> Column:
    """What is left of a text around its hits: array of ``begin, stop`` in characters, stop exclusive.

    ``hits`` holds ``begin, stop`` of each hit in order. A hit is cut with ``window``
    characters around it, which leaves the gaps between the cuts. A gap counts if it is
    longer than ``least``; the last one loses its first character. A text with more than
    ``most`` hits leaves nothing, one without hits itself if it has ``least`` characters.
    """
    interval = lambda a, b: F.struct(a.cast("int").alias("begin"), b.cast("int").alias("stop"))
    cuts = F.transform(hits, lambda h: interval(F.greatest(h["begin"] - window, F.lit(0)), F.least(h["stop"] - 1 + window, length)))
    # Gap k lies between cut k - 1 and cut k; hits come in order and are equally many words, so overlapping cuts leave no gap.
    edges = F.zip_with(F.concat(F.array(interval(F.lit(0), F.lit(0))), F.slice(cuts, F.lit(1), F.size(cuts) - 1)), cuts, lambda before, cut: interval(before["stop"], cut["begin"]))
    inner = F.filter(edges, lambda g: g["stop"] - g["begin"] > least)
    end = F.element_at(cuts, -1)["stop"]
    after = F.when(length - end > least, F.array(interval(end + 1, length))).otherwise(F.array().cast("array<struct<begin: int, stop: int>>"))
    whole = F.when(length >= least, F.array(interval(F.lit(0), length))).otherwise(F.array().cast("array<struct<begin: int, stop: int>>"))
    n = F.size(hits)
    return F.when(n == 0, whole).when(n <= most, F.concat(inner, after)).otherwise(F.array().cast("array<struct<begin: int, stop: int>>"))


def decontaminate(docs: DataFrame, key: str, text: str, held_out: DataFrame, held_text: str, n: int = 13, window: int = 200, most: int = 10, least: int = 200) -> DataFrame:
    """``key, chunk, text``: the clean chunks of each text, in order. Null texts give none.

    N-grams of the held-out texts are sent to every task up to ``BROADCAST_GRAMS``; beyond,
    each text first gets the hits among its own n-grams by a join.
    """
    dirt = gram_table(held_out.withColumn("_k", F.lit(0)), "_k", held_text, n).select("ngram").distinct()
    kind = dict(docs.dtypes)[key]
    if dirt.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        grams = {r.ngram for r in dirt.collect()}
        shared = docs.sparkSession.sparkContext.broadcast((grams, _first_words(grams)))
        rows = docs.select(key, text).withColumn("_d", F.lit(None).cast("array<string>"))
    else:
        shared = None
        # The join sees the form of the raw words, as the cleaner does.
        hits = docs.select(key, F.explode(F.transform(word_ngrams(F.col(text), n), ngram_form)).alias("ngram")).join(dirt, "ngram").groupBy(key).agg(F.collect_set("ngram").alias("_d"))
        rows = docs.select(key, text).join(hits, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for t, d in zip(pdf[text], pdf["_d"]):
                bad, first = shared.value if shared is not None else (set(d) if d is not None else set(), None)
                found.append([{"begin": a, "stop": b} for a, b in dirty_spans(t, bad, n, first)])
            yield pd.DataFrame({key: pdf[key], "text": pdf[text], "hits": found})

    marked = rows.where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, text string, hits array<struct<begin: int, stop: int>>")
    pieces = marked.select(key, "text", F.posexplode(clean_intervals(F.col("hits"), F.length("text"), window, most, least)).alias("chunk", "at"))
    return pieces.select(key, "chunk", F.substring(F.col("text"), F.col("at.begin") + 1, F.col("at.stop") - F.col("at.begin")).alias("text"))
