"""Deterministic samples and splits. Orders are seeded hashes, or any order column given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.numeric import draw
from siftloom.session import checkpointed

from .prefix import running_total


def hash_order(key: str, seed: int) -> list[Column]:
    return [draw(F.lit(seed), F.col(key)), F.col(key)]


def sample_per_group(df: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group in the given order; all rows of smaller groups."""
    return running_total(df, by, order, {"_place": F.lit(1)}).where(F.col("_place") <= n).drop("_place")


def sample_exactly(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement, in hash order; fails if there are fewer."""
    have = df.count()
    if have < n:
        raise ValueError(f"{n} rows wanted, {have} there")
    return sample_per_group(df, [], n, hash_order(key, seed))


def split_exact(df: DataFrame, by: list[str], test: int, valid: int, train: int | None, order: list[Column]) -> DataFrame:
    """Adds ``split``: in each group the first ``test`` rows are test, the next ``valid`` valid, the next ``train`` train; the rest is dropped."""
    place = F.col("_place")
    split = F.when(place <= test, "test").when(place <= test + valid, "valid")
    split = split.otherwise("train") if train is None else split.when(place <= test + valid + train, "train")
    return running_total(df, by, order, {"_place": F.lit(1)}).withColumn("split", split).where("split is not null").drop("_place")


def rebalance(train: DataFrame, by: str, score: str, order: list[Column], quantile: int, k: int, seed: int = 0) -> DataFrame:
    """``train`` with rows of the smaller class (score under 3, or 3 and more) of each group drawn again, as ``copy_no``.

    ``min(|high - low| // quantile, |minority|) * k`` draws with replacement are added a
    group; draw j takes row ``hash(group, k, j) mod |minority|`` of the class. Rows without
    a score belong to no class and are kept once. A group without a minority gets none.
    """
    ranked = checkpointed(
        running_total(train.withColumn("_high", F.when(F.col(score) >= 3, 1).when(F.col(score) < 3, 0)), [by, "_high"], order, {"_place": F.lit(1)})
    )
    n = ranked.where("_high is not null").groupBy(by).agg(F.count_if(F.col("_high") == 1).alias("high"), F.count_if(F.col("_high") == 0).alias("low"))
    goal = n.withColumn("small", F.least("high", "low")).withColumn("class", (F.col("high") < F.col("low")).cast("int"))
    goal = goal.withColumn("draws", F.least(F.floor(F.abs(F.col("high") - F.col("low")) / quantile), F.col("small")) * k).where("draws > 0")
    pick = draw(F.lit(seed), F.col(by), F.lit(k), F.col("copy_no")) % F.col("small") + 1
    # The draws of one group are made by as many tasks as it has blocks of them.
    blocks = goal.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("draws") - 1) / 4096)))).repartition(by, "block")
    each = F.sequence(F.col("block") * 4096 + 1, F.least(F.col("draws"), (F.col("block") + 1) * 4096))
    drawn = blocks.withColumn("copy_no", F.explode(each)).select(by, F.col("class").alias("_high"), pick.alias("_place"), F.col("copy_no").cast("int"))
    again = drawn.join(ranked, [by, "_high", "_place"])
    return ranked.withColumn("copy_no", F.lit(0)).unionByName(again.select(*ranked.columns, "copy_no")).drop("_high", "_place")


def rebalance_sizes(train: DataFrame, by: str, score: str, quantile: int, k: int) -> DataFrame:
    """What ``rebalance`` adds to each group: ``by, high, low, draws``."""
    n = train.groupBy(by).agg(F.coalesce(F.count_if(F.col(score) >= 3), F.lit(0)).alias("high"), F.coalesce(F.count_if(F.col(score) < 3), F.lit(0)).alias("low"))
    return n.withColumn("draws", (F.least(F.floor(F.abs(F.col("high") - F.col("low")) / quantile), F.least("high", "low")) * k).cast("long"))


def limit_fraction(df: DataFrame, limit: float, order: str) -> DataFrame:
    """The first rows in order: ``ceil(n * limit)`` for a limit under 1, else ``limit`` rows."""
    n = int(-(-df.count() * limit // 1)) if limit < 1 else int(limit)
    return sample_per_group(df, [], n, [F.col(order)])


def rank_stride(df: DataFrame, row: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Rows of one of ``world`` ranks by their number, of the first ``limit``."""
    mine = df.where(F.col(row) % world == rank)
    return mine if limit is None else mine.where(F.col(row) < limit)


def rank_strides(df: DataFrame, order: str, world: int, limit: int | None = None) -> DataFrame:
    """Every row, or the first ``limit`` by ``order``, with the ``rank`` whose stride over row numbers from 0 holds it."""
    numbered = running_total(df, [], [F.col(order)], {"_place": F.lit(1)})
    numbered = numbered if limit is None else numbered.where(F.col("_place") <= limit)
    return numbered.withColumn("rank", (F.col("_place") - 1) % world).drop("_place")


def fewshot(docs: DataFrame, pool: DataFrame, by: str, doc: str, k: int, order: list[Column]) -> DataFrame:
    """``doc, shot, example``: ``k`` examples of the same group for each document, never itself.

    ``order`` ranks the pool by its columns ``by, example``. Only the first ``k + 1`` examples
    of a group can be drawn, so the join is with those.
    """
    first = running_total(pool.select(by, F.col(doc).alias("example")), [by], order, {"place": F.lit(1)}).where(F.col("place") <= k + 1)
    pairs = docs.select(by, doc).join(first, by).where(F.col("example") != F.col(doc))
    own = docs.select(by, F.col(doc).alias("example")).join(first, [by, "example"]).select(by, F.col("example").alias(doc), F.col("place").alias("own"))
    shot = F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0)
    return pairs.join(own, [by, doc], "left").withColumn("shot", shot).where(F.col("shot") <= k).select(doc, "shot", "example")


def fewshot_random(docs: DataFrame, pool: DataFrame, by: str, doc: str, k: int, seed: int = 0) -> DataFrame:
    """``doc, shot, example``: ``k`` examples of the same group drawn for each document by a seed, never itself.

    The pool of a group is numbered once in a seeded order; a document starts at a drawn
    place and takes those that follow, so its examples are distinct, and only ``k + 1`` rows
    a document are joined, never documents times pool.
    A group of fewer than ``k + 1`` examples gives what it has.
    """
    place = running_total(pool.select(by, F.col(doc).alias("example")), [by], [draw(F.lit(seed), F.col("example")), F.col("example")], {"place": F.lit(1)})
    sizes = pool.groupBy(by).agg(F.count("*").alias("_n"))
    walked = docs.select(by, doc).join(sizes, by).withColumn("_try", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n") - 1).cast("int"))))
    first = draw(F.lit(seed), F.lit("start"), F.col(doc))
    walked = walked.withColumn("place", (first + F.col("_try")) % F.col("_n") + 1)
    found = walked.join(place, [by, "place"]).where(F.col("example") != F.col(doc))
    order = Window.partitionBy(doc).orderBy("_try")
    return found.withColumn("shot", F.row_number().over(order)).where(F.col("shot") <= k).select(doc, "shot", "example")


def shuffled_choices(choices: Column, key: Column, seed: int = 0) -> Column:
    """The choices in an order that depends on the document and seed alone."""
    return F.transform(F.array_sort(F.transform(choices, lambda c, i: F.struct(draw(F.lit(seed), key, i, c).alias("h"), i.alias("i"), c.alias("c")))), lambda s: s["c"])


def length_order(df: DataFrame, length: Column, row: str) -> DataFrame:
    """Adds ``place``: longest first, ties by row; sort by ``row`` to restore the order."""
    return running_total(df.withColumn("_len", length), [], [F.col("_len").desc(), F.col(row)], {"place": F.lit(1)}).drop("_len")
