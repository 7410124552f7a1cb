"""Score cutoffs that keep a target fraction of each source (problem 2).

Method: distributed quickselect. Equal scores of a source are first counted together,
so the search runs over weighted values. In each round every partition gives the
weighted median of each source's values still open there; the weighted median of those,
weighted by what the partition holds, is the source's pivot; counts above and at the
pivot tell which side holds the target rank, and the other side is discarded. Sources
are searched together and leave once their rank is isolated.

Scale: values of one source lie in all partitions, so a source with a third of all rows
is searched by all tasks. A round moves one row per source and partition. At least a
quarter of a source's open weight goes each round, so rounds grow with the logarithm
of the distinct scores. The state is one row a source and is broadcast only where few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import canonical_source
from siftloom.session import checkpointed

from .common import BROADCAST_ROWS, hinted

KEY = ["dataset", "source"]


def targets(mix_targets: DataFrame) -> DataFrame:
    """``source, keep_fraction`` by canonical source; the greatest fraction where a source is named twice, null if none."""
    return mix_targets.select(canonical_source(F.col("source")).alias("source"), F.nanvl("keep_fraction", F.lit(None).cast("double")).alias("keep_fraction")).where(
        "source is not null"
    ).groupBy("source").agg(F.max("keep_fraction").alias("keep_fraction"))


def _round(values: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """One round: the state with cutoff, or narrower bounds, of each source. ``few``: whether the state may be broadcast."""
    mark = F.broadcast if few else lambda df: df
    live = values.join(mark(state.select(*KEY, "low", "high")), KEY).where(
        (F.col("low").isNull() | (F.col("score") > F.col("low"))) & (F.col("high").isNull() | (F.col("score") < F.col("high")))
    )
    local = live.groupBy(*KEY, F.spark_partition_id().alias("part")).agg(F.expr("percentile(score, 0.5, n)").alias("median"), F.sum("n").alias("weight"))
    pivots = local.groupBy(*KEY).agg(F.expr("percentile(median, 0.5, weight)").alias("pivot"))
    at = live.join(mark(pivots), KEY)
    over = at.groupBy(*KEY).agg(
        F.max("pivot").alias("pivot"), F.sum(F.when(F.col("score") > F.col("pivot"), F.col("n")).otherwise(0)).alias("gt"),
        F.sum(F.when(F.col("score") == F.col("pivot"), F.col("n")).otherwise(0)).alias("eq"),
    )
    up, here = F.col("rank") <= F.col("gt"), F.col("rank") <= F.col("gt") + F.col("eq")
    return mark(state).join(over, KEY).select(
        *KEY,
        F.when(up | here, F.col("rank")).otherwise(F.col("rank") - F.col("gt") - F.col("eq")).alias("rank"),
        F.when(up, F.col("pivot")).otherwise(F.col("low")).alias("low"),
        F.when(up | here, F.col("high")).otherwise(F.col("pivot")).alias("high"),
        F.when(up, F.col("above")).when(here, F.col("above") + F.col("gt")).otherwise(F.col("above") + F.col("gt") + F.col("eq")).alias("above"),
        F.when(~up & here, F.col("pivot")).alias("cutoff"),
        F.when(~up & here, F.col("eq")).alias("ties"),
    )


def cutoffs(records: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``dataset, source, keep_fraction, n_records, n_scored, target_kept, cutoff, kept, kept_above``, one row a source.

    ``records`` has ``dataset, source STRING, score DOUBLE``; a null, NaN or infinite score
    counts in ``n_records`` only. ``target_kept`` is the fraction of the scored records,
    rounded up; ``cutoff`` the greatest score such that at least so many are at or above
    it, ``kept`` how many are (more than the target where scores tie), ``kept_above`` how
    many are above it. Without a target, a target of 0 or less, or no scored record, the
    cutoff is null and nothing is kept; a fraction over 1 keeps all. Repeated rows count
    each time. Sources that only the targets name get no row. Empty tables give none.
    """
    score = F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == F.lit(float("inf"))), None).otherwise(F.col("score"))
    values = checkpointed(records.select(*KEY, score.alias("score")).groupBy(*KEY, "score").agg(F.count("*").alias("n")))
    sizes = values.groupBy(*KEY).agg(F.sum("n").alias("n_records"), F.coalesce(F.sum(F.when(F.col("score").isNotNull(), F.col("n"))), F.lit(0)).alias("n_scored"))
    exact = F.ceil(F.round(F.col("keep_fraction") * F.col("n_scored"), 6))
    wanted = F.when(F.col("keep_fraction").isNotNull(), F.least(F.col("n_scored"), exact))
    goals = checkpointed(sizes.join(hinted(targets(mix_targets)), "source", "left").withColumn("target_kept", F.greatest(F.coalesce(wanted, F.lit(0)), F.lit(0)).cast("long")))
    values = values.where("score is not null")
    none = F.lit(None).cast("double")
    state = goals.where("target_kept > 0").select(*KEY, F.col("target_kept").alias("rank"), none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("above"), none.alias("cutoff"), F.lit(None).cast("long").alias("ties"))
    done = state.where("false")
    state = checkpointed(state)
    while open_ := state.count():
        state = checkpointed(_round(values, state, open_ <= BROADCAST_ROWS))
        done = done.unionByName(state.where("cutoff is not null"))
        state = state.where("cutoff is null")
    done = done.select(*KEY, "cutoff", "above", "ties")
    return goals.join(hinted(done), KEY, "left").select(
        *KEY, "keep_fraction", "n_records", "n_scored", "target_kept", "cutoff",
        F.coalesce(F.col("above") + F.col("ties"), F.lit(0)).alias("kept"), F.coalesce("above", F.lit(0)).alias("kept_above"),
    )


def kept(records: DataFrame, found: DataFrame) -> DataFrame:
    """The records at or above their source's cutoff, with all their columns and the source's ``cutoff, target_kept, kept``.

    A record without a usable score is never kept; where the fraction keeps all scored
    records the cutoff is their least score, so it changes nothing for them.
    """
    return records.join(hinted(found.where("cutoff is not null").select(*KEY, "cutoff", "target_kept", "kept")), KEY).where("score >= cutoff and not isnan(score) and score < double('infinity')")
