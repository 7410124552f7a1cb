"""Distributions, rankings, correlations and comparisons of rated rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.numeric import correlation, ratio


def long_form(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each metric of each row: ``keys, criterion, value``."""
    return df.unpivot(list(keys), list(metrics), "criterion", "value")


def counts_by_dimension(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """``dimension, value, n, share`` of each dimension alone, in one pass with grouping sets. Null values are a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    counted = df.select(pairs.alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def share_within(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """``outer, inner, n, share``: how the rows of each outer value spread over the inner values."""
    counted = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def rating_distribution(df: DataFrame, source: str, metrics: Sequence[str]) -> DataFrame:
    """``source, criterion, value, n, share`` with shares of all rows of the source, rated or not."""
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    counted = long_form(df, [source], metrics).where("value is not null").groupBy(F.col(source).alias("source"), "criterion", "value").agg(F.count("*").alias("n"))
    return counted.join(sizes, counted["source"].eqNullSafe(sizes["source"])).select(counted["source"], "criterion", "value", "n", (F.col("n") / F.col("rows")).alias("share"))


def mean_and_variance(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``criterion, n, mean, variance`` (sample variance), nulls left out, with the rank by mean."""
    rows = long_form(df, [], metrics).where("value is not null").groupBy("criterion")
    out = rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("mean", 9).desc(), "criterion")))


def means_by(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """``by, n`` and the mean of each metric."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def rank_groups(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """``by, criterion, mean``, the place of the group among all groups of the criterion, and of the criterion in the group.

    Ranked by means rounded to 9 digits, ties by name.
    """
    means = long_form(means_by(df, by, metrics), [by], metrics).withColumnRenamed("value", "mean").where("mean is not null")
    value = F.round("mean", 9).desc()
    return means.withColumn("place_of_group", F.row_number().over(Window.partitionBy("criterion").orderBy(value, by))).withColumn(
        "place_of_criterion", F.row_number().over(Window.partitionBy(by).orderBy(value, "criterion"))
    )


def score_classes(score):
    """Two and three classes of a score: good from 3 up; low, middle at 3, high."""
    return F.when(score >= 3, "good").when(score < 3, "bad"), F.when(score > 3, "high").when(score == 3, "middle").when(score < 3, "low")


def good_bad_gap(df: DataFrame, by: str, score: str) -> DataFrame:
    """``by, n, good, bad, gap`` of the scored rows, good meaning 3 and more, with the place by gap."""
    scored = df.where(F.col(score).isNotNull())
    share = F.avg(F.when(F.col(score) >= 3, 1.0).otherwise(0.0))
    out = scored.groupBy(by).agg(F.count("*").alias("n"), share.alias("good")).withColumn("bad", 1 - F.col("good")).withColumn("gap", 2 * F.col("good") - 1)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("gap", 9).desc(), by)))


def discrepancy(first: DataFrame, second: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means and row counts of two samples side by side with their difference, for groups in either (full outer)."""
    a = first.groupBy(*by).agg(F.count("*").alias("n_1"), *[F.avg(m).alias(f"{m}_1") for m in metrics])
    b = second.groupBy(*by).agg(F.count("*").alias("n_2"), *[F.avg(m).alias(f"{m}_2") for m in metrics])
    both = a.join(b, list(by), "full_outer")
    return both.select(*by, F.coalesce("n_1", F.lit(0)).alias("n_1"), F.coalesce("n_2", F.lit(0)).alias("n_2"), *[(F.col(f"{m}_1") - F.col(f"{m}_2")).alias(f"{m}_diff") for m in metrics])


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))


def pearson_matrix(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``a, b, pearson`` of each pair, over the rows where both are finite.

    One aggregate holds the sums of all pairs, so rows are neither multiplied nor shuffled;
    one row a task is.
    """
    clean = df.select(*[F.when(_finite(m), F.col(m).cast("double")).alias(m) for m in metrics])
    pairs = list(combinations(metrics, 2))
    wide = clean.agg(*[correlation(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(rows.alias("p")).select("p.*")


def correlations(df: DataFrame, main: str, others: Sequence[str]) -> DataFrame:
    """``criterion, n, pearson, spearman`` of one field against others, over rows where both are finite.

    Spearman is Pearson over average ranks. Ranks come from the counts of the distinct
    values (a few thousand for ratings), so no task sorts all rows.
    """
    pairs = long_form(df, [main], others).where(_finite(main) & _finite("value")).select("criterion", F.col(main).cast("double").alias("x"), F.col("value").cast("double").alias("y"))
    counted = pairs.groupBy("criterion", "x", "y").agg(F.count("*").alias("n"))

    def ranks(c: str) -> DataFrame:
        per = counted.groupBy("criterion", c).agg(F.sum("n").alias("m"))
        below = F.coalesce(F.sum("m").over(Window.partitionBy("criterion").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return per.select("criterion", c, (below + (F.col("m") + 1) / 2).alias(f"rank_{c}"))

    ranked = counted.join(ranks("x"), ["criterion", "x"]).join(ranks("y"), ["criterion", "y"])

    def weighted(a: str, b: str):
        w = F.sum("n")
        s = lambda e: F.sum(F.col("n") * e)
        A, B = F.col(a), F.col(b)
        top = w * s(A * B) - s(A) * s(B)
        return ratio(top, F.sqrt(w * s(A * A) - s(A) * s(A)) * F.sqrt(w * s(B * B) - s(B) * s(B)))

    return ranked.groupBy("criterion").agg(F.sum("n").alias("n"), weighted("x", "y").alias("pearson"), weighted("rank_x", "rank_y").alias("spearman"))


def mean_perplexity(df: DataFrame, domain: str, loglikelihood: str) -> DataFrame:
    """``domain, n, perplexity``: mean of exp(-ll) per domain and, as domain ``all``, overall, with one rollup."""
    rows = df.where(F.col(loglikelihood).isNotNull()).withColumn(domain, F.coalesce(F.col(domain), F.lit("unknown")))
    rolled = rows.rollup(domain).agg(F.count("*").alias("n"), F.avg(F.exp(-F.col(loglikelihood))).alias("perplexity"), F.grouping(domain).alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col(domain)).alias("domain"), "n", "perplexity")


def corpus_statistics(df: DataFrame, file: str, text: str) -> DataFrame:
    """``file, n_docs, n_chars, first_doc``: per file, with the number of documents in files before it by name."""
    per = df.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    before = Window.partitionBy(F.lit(1)).orderBy(F.col("file").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("first_doc", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))


def length_statistics(df: DataFrame, length, truncated_at: int) -> DataFrame:
    """One row: ``n, mean, longest, shortest, n_truncated`` of a length column."""
    return df.select(length.alias("len")).agg(
        F.count("len").alias("n"), F.avg("len").alias("mean"), F.max("len").alias("longest"), F.min("len").alias("shortest"),
        F.coalesce(F.sum((F.col("len") > truncated_at).cast("int")), F.lit(0)).alias("n_truncated"),
    )


def mean_ignoring_nan(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: the mean of each metric over rows where it is a number, and how many those are."""
    clean = [F.nanvl(m, F.lit(None).cast("double")) for m in metrics]
    return df.agg(*[F.avg(c).alias(m) for c, m in zip(clean, metrics)], *[F.count(c).alias(f"n_{m}") for c, m in zip(clean, metrics)])


def order_by_sum(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``total``: sum of the fields as numbers, what is missing or no number counting 0. Sort by it for the ranking."""
    total = F.lit(0.0)
    for f in fields:
        total = total + F.coalesce(F.expr(f"try_cast(`{f}` as double)"), F.lit(0.0))
    return df.withColumn("total", total)


def least_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The ``k`` rows with the least values, nulls and NaN left out."""
    return df.where(F.col(by).isNotNull() & ~F.isnan(by)).orderBy(by, tie).limit(k)


def greatest_k(df: DataFrame, by, k: int) -> DataFrame:
    """The ``k`` rows with the greatest values of a column, nulls left out."""
    return df.where(by.isNotNull()).orderBy(by.desc()).limit(k)
