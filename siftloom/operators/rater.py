"""How well a rater's answers match the true ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.numeric import correlation
from siftloom.session import checkpointed

from .prefix import BROADCAST_ROWS
from .stats import correlations


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """``by, truth, predicted, n``; rows where either is null are left out."""
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by, label, n_true, n_predicted, right, recall, f1`` over the labels seen on either side; undefined is 0."""
    true = counts.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    pred = counts.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = true.join(pred, [*by, "label"], "full_outer").select(*by, "label", zero("n_true"), zero("n_predicted"), zero("right"))
    recall = F.when(F.col("n_true") > 0, F.col("right") / F.col("n_true"))
    return both.withColumn("recall", recall).withColumn("f1", 2 * F.col("right") / (F.col("n_true") + F.col("n_predicted")))


def class_report(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """``by, n, accuracy, macro_f1, micro_f1, weighted_f1, recall_variance``: variance is of the class recalls rounded to 3 digits."""
    classes = per_class(confusion(df, by, truth, predicted), by)
    return classes.groupBy(*by).agg(
        F.sum("n_true").alias("n"), (F.sum("right") / F.sum("n_true")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (2 * F.sum("right") / (F.sum("n_true") + F.sum("n_predicted"))).alias("micro_f1"), (F.sum(F.col("f1") * F.col("n_true")) / F.sum("n_true")).alias("weighted_f1"),
        F.var_pop(F.round("recall", 3)).alias("recall_variance"),
    )


def score_report(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """Five- and two-class accuracy, recall of the low and high class, misses and misjudgements, of scores 1 to 5.

    ``negative`` is a true score under 3. Misses are shares of the negative rows: true under
    2 and rated 3 or more; true 2 to 3 and rated over 3; the same rated 3. Misjudgements are
    shares of the positive rows: true 4 or more and rated under 3; true 3 to 4 and rated
    under 3. A share of no rows is null.
    """
    t, p = F.col(truth), F.col(predicted)
    low = t < 3
    part = lambda of, yes: (F.count_if(of & yes) / F.nullif(F.count_if(of), F.lit(0)))
    return df.where(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy_5"), F.avg(((t < 3) == (p < 3)).cast("double")).alias("accuracy_2"),
        part(low, p < 3).alias("negative_accuracy"), part(~low, p >= 3).alias("positive_accuracy"),
        part(low, (t < 2) & (p >= 3)).alias("miss_1"), part(low, (t >= 2) & (p > 3)).alias("miss_2"), part(low, (t >= 2) & (p == 3)).alias("miss_3"),
        part(~low, (t >= 4) & (p < 3)).alias("misjudge_1"), part(~low, (t < 4) & (p < 3)).alias("misjudge_2"), correlation(t, p).alias("pearson"),
    )


def rating_pairs(true: DataFrame, predicted: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """``key, criterion, truth, predicted`` of rows on both sides: joined once as they are, then spread over the criteria."""
    both = true.select(key, *[F.col(m).alias(f"t_{m}") for m in metrics]).join(predicted.select(key, *[F.col(m).alias(f"p_{m}") for m in metrics]), key)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("criterion"), F.col(f"t_{m}").alias("truth"), F.col(f"p_{m}").alias("predicted")) for m in metrics]))
    return both.select(key, pairs.alias("x")).select(key, "x.*")


def all_rating_report(pairs: DataFrame) -> DataFrame:
    """``score_report`` per criterion with Spearman, each criterion against its own truth."""
    ranks = []
    for c in ("truth", "predicted"):
        counted = pairs.where("truth is not null and predicted is not null").groupBy("criterion", c).agg(F.count("*").alias("m"))
        below = F.coalesce(F.sum("m").over(Window.partitionBy("criterion").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks.append(counted.select("criterion", c, (below + (F.col("m") + 1) / 2).alias(f"rank_{c}")))
    # Ratings have a few values each; finer scores make larger tables, joined by shuffle.
    ranks = [F.broadcast(r) if r.count() <= BROADCAST_ROWS else r for r in map(checkpointed, ranks)]
    ranked = pairs.join(ranks[0], ["criterion", "truth"]).join(ranks[1], ["criterion", "predicted"])
    spearman = ranked.groupBy("criterion").agg(correlation(F.col("rank_truth"), F.col("rank_predicted")).alias("spearman"))
    return score_report(pairs, ["criterion"], "truth", "predicted").join(spearman, "criterion", "left")


def false_cases(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows that are bad misses (true under 2, rated 3 or more) or misjudgements (true 4 or more, rated 2 or less), as ``case``."""
    t, p = F.col(truth), F.col(predicted)
    return df.withColumn("case", F.when((t < 2) & (p >= 3), "miss").when((t >= 4) & (p <= 2), "misjudge")).where("case is not null")


__all__ = ["all_rating_report", "class_report", "confusion", "correlations", "false_cases", "per_class", "rating_pairs", "score_report"]
