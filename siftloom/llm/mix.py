"""Mixing sources to target weights (problem 7).

Method: hierarchical budgeting. Leaves are (domain, language, source). A source's
weight is spread over its leaves by their tokens. The budget flows down the tree
domain - language - source: at each node the children fill in proportion to their
weight up to their capacity (tokens times allowed repeats), and what a full child
cannot take goes to its siblings; only what no sibling can take is left to the level
above, because a node never receives more than its subtree can hold. Each leaf then
takes whole seeded epochs and, of the last epoch, the prefix that meets its budget.

Prefixes end between texts, so what one leaf leaves over, or takes too much, is settled
with the other leaves of its source: the texts of a source are taken in the order of
their place in the leaf's epoch over the part of it that the leaf should get, until the
source has its budget. So a leaf ends within a text or so of its budget, and a source
within half the text at its cut, however small its leaves are.

Scale: the tree has one row a leaf, the places of the texts come from sums over
``PARTS`` hash ranges of each leaf; both are broadcast behind a check. The filling level
of a node is closed form over its children in order of capacity per weight, a window
over a few rows. The cut of a source is found among as many levels as there are
thousands of texts, and then inside the one level that straddles it, so no task sorts a
whole source even if it holds a third of all texts. Texts themselves are shuffled only
in that level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.labels import canonical_source
from siftloom.session import checkpointed

from .common import hinted

LEAF = ["domain_type", "lang", "source"]
#: Hash ranges of a leaf whose sums place its texts; a place is exact to a fraction of a range.
PARTS = 128
#: Texts a level holds on average.
LEVEL_TEXTS = 2048


def _fill(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``share``: the budget of each child. Needs ``weight, capacity`` and the parent's ``budget``."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = w.orderBy("ratio", *LEAF[: len(parent) + 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col(budget) - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (
        F.greatest(F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)), F.col("weight"))
    )
    ranked = children.withColumn("ratio", ratio).where("ratio is not null").withColumn("level", level).withColumn("place", F.row_number().over(order))
    # Full children come first; the level of the first that is not full holds for it and all after it.
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(w)
    share = F.when(first.isNull() | (F.col("place") < first["place"]), F.col("capacity")).otherwise(F.col("weight") * first["level"])
    return ranked.withColumn("share", F.least(share, F.col("capacity"))).drop("ratio", "level", "place")


def targets(mix_targets: DataFrame) -> DataFrame:
    """``source, mix_weight, max_repeats``: canonical source, null or negative weight 0, null repeats 1, repeated rows added up."""
    return (
        mix_targets.select(canonical_source(F.col("source")).alias("source"), "mix_weight", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(
            F.sum(F.greatest(F.coalesce(F.nanvl("mix_weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("mix_weight"),
            F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"),
        )
    )


def leaf_budgets(leaves: DataFrame, mix_targets: DataFrame, budget: float) -> DataFrame:
    """``domain_type, lang, source, leaf_tokens, max_repeats, leaf_budget`` of each leaf that gets a share.

    ``leaves`` has the tokens of each leaf. A source without a target or with weight 0
    gets nothing; a target without texts passes its weight on, as it has no leaf.
    """
    of_source = Window.partitionBy("source")
    known = (
        leaves.join(targets(mix_targets), "source")
        .withColumn("weight", F.col("mix_weight") * F.col("leaf_tokens") / F.sum("leaf_tokens").over(of_source))
        .withColumn("capacity", (F.col("leaf_tokens") * F.col("max_repeats")).cast("double"))
        .where("weight > 0 and capacity > 0")
    )
    add = [F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity")]
    top = known.groupBy("domain_type").agg(*add)
    room = top.agg(F.least(F.lit(float(budget)), F.coalesce(F.sum("capacity"), F.lit(0.0))).alias("room"))
    top = _fill(top.crossJoin(F.broadcast(room)), [], "room").select("domain_type", F.col("share").alias("room"))
    mid = known.groupBy("domain_type", "lang").agg(*add).join(top, "domain_type")
    mid = _fill(mid, LEAF[:1], "room").select("domain_type", "lang", F.col("share").alias("room"))
    low = _fill(known.join(mid, ["domain_type", "lang"]), LEAF[:2], "room")
    return low.select(*LEAF, "leaf_tokens", "max_repeats", F.col("share").alias("leaf_budget"))


def mix(sized: DataFrame, mix_targets: DataFrame, budget_fraction: float = 0.4, seed: int = 17) -> DataFrame:
    """One row for each text used: ``doc_id, source, lang, domain_type, n_tokens, copies``.

    ``sized`` has ``doc_id, source, lang, domain_type, n_tokens`` with canonical labels; it
    is read three times, so it should be a table or checkpoint. The mix has
    ``budget_fraction`` times the tokens of ``sized``. A text is used at most ``max_repeats``
    times: whole epochs first, then the prefix of one seeded order. The text at a source's
    cut is taken if at least half of it fits. Texts without tokens are never used. Repeated
    rows count as texts of their own. An empty table gives an empty mix.
    """
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens")), 11)  # 53 bits, exact as a double
    texts = sized.select("doc_id", *LEAF, "n_tokens", (spot / F.lit(float(1 << 53)) * PARTS).alias("spot")).where("n_tokens > 0").withColumn("part", F.floor("spot"))
    parts = checkpointed(texts.groupBy(*LEAF, "part").agg(F.sum("n_tokens").alias("part_tokens"), F.count("*").alias("n")))
    leaves = parts.groupBy(*LEAF).agg(F.sum("part_tokens").alias("leaf_tokens"))
    whole = parts.agg(F.sum("part_tokens").alias("tokens"), F.sum("n").alias("n")).first()
    budgets = leaf_budgets(leaves, mix_targets, (whole.tokens or 0) * budget_fraction)
    epochs = F.least(F.floor(F.col("leaf_budget") / F.col("leaf_tokens")), F.col("max_repeats"))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens")).otherwise(F.lit(0.0))
    budgets = checkpointed(budgets.withColumn("epochs", epochs).withColumn("rest", rest).select(*LEAF, "leaf_tokens", "epochs", "rest"))
    before = F.coalesce(F.sum("part_tokens").over(Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(parts.withColumn("start", before).join(F.broadcast(budgets), LEAF).select(*LEAF, "part", "start", "part_tokens", "epochs", "rest"))
    # 1 is where a leaf's prefix should end.
    place = (F.col("start") + (F.col("spot") - F.col("part")) * F.col("part_tokens")) / F.col("rest")
    levels = max(1024, (whole.n or 0) // LEVEL_TEXTS)
    placed = texts.join(hinted(starts), [*LEAF, "part"]).withColumn("place", F.when(F.col("rest") > 0, place))
    placed = placed.withColumn("level", F.floor(F.least("place", F.lit(16.0)) * levels)).drop("spot", "part", "start", "part_tokens", "rest")
    goals = budgets.groupBy("source").agg(F.sum("rest").alias("goal"))
    sums = placed.where("level is not null").groupBy("source", "level").agg(F.sum("n_tokens").alias("tokens"))
    up_to = F.sum("tokens").over(Window.partitionBy("source").orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    cuts = sums.withColumn("up_to", up_to).join(F.broadcast(goals), "source").where("up_to > goal").groupBy("source").agg(
        F.min(F.struct("level", (F.col("up_to") - F.col("tokens")).alias("before"), "goal")).alias("cut")
    )
    cuts = checkpointed(cuts.select("source", F.col("cut.level").alias("cut"), "cut.before", "cut.goal"))
    cut = placed.join(hinted(cuts), "source", "left")
    at_cut = F.coalesce(F.col("level") == F.col("cut"), F.lit(False))
    inside = Window.partitionBy("source").orderBy("place", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("n_tokens")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.where(at_cut).withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.withColumn("more", (F.col("before") + F.col("n_tokens") / 2 <= F.col("goal")).cast("int"))
    # A source whose texts all fit has no cut.
    rest = cut.where(~at_cut).withColumn("more", F.coalesce(F.col("level").isNotNull() & (F.col("cut").isNull() | (F.col("level") < F.col("cut"))), F.lit(False)).cast("int"))
    out = rest.unionByName(edge).withColumn("copies", (F.col("epochs") + F.col("more")).cast("int"))
    return out.where("copies > 0").select("doc_id", "source", "lang", "domain_type", "n_tokens", "copies")


def share_report(mixed: DataFrame, sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """Target and reached share of each source of the targets or the texts, with repeats used."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies")
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    whole = got.agg(F.sum("mix_tokens").alias("whole"))
    rows = targets(mix_targets).join(have, "source", "full_outer").join(got, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select(
        "source", F.coalesce("mix_weight", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        zero("source_tokens"), zero("mix_tokens"), zero("n_docs"), zero("most_copies"), "max_repeats",
    )
