"""Selection of a subset under a token budget: filters, strategies, up-sampling, shards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.numeric import draw
from siftloom.session import checkpointed

from .prefix import BROADCAST_ROWS, running_total


def composite_metric(fields: Sequence[str]) -> Column:
    """Sum of the fields as doubles; the constant 1 without fields. A null field makes the metric null."""
    return reduce(add, [F.col(f).cast("double") for f in fields]) if fields else F.lit(1.0)


def with_attributes(df: DataFrame, row_id: str, length: str, metric_fields: Sequence[str], domain_fields: Sequence[str] = ()) -> DataFrame:
    """The narrow table that selection works on: ``row_id, n_tokens, metric, domain_1 .. domain_n``.

    Domain fields may be dotted paths. Rows whose length or metric is null, or whose length
    is not positive, can't be budgeted and are dropped. Null domains become ``''``.
    """
    domains = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"domain_{i + 1}") for i, f in enumerate(domain_fields)]
    out = df.select(F.col(row_id).alias("row_id"), F.col(length).cast("long").alias("n_tokens"), composite_metric(metric_fields).alias("metric"), *domains)
    return out.where("n_tokens > 0 and metric is not null")


def filter_scores(attributes: DataFrame, target_scores: Sequence[float]) -> DataFrame:
    """Rows whose summed metric is one of the scores."""
    return attributes.where(F.col("metric").isin([float(s) for s in target_scores]))


def filter_domains(attributes: DataFrame, target_domains: Sequence[str]) -> DataFrame:
    """Rows whose first domain is one of those given."""
    return attributes.where(F.col("domain_1").isin(list(target_domains)))


def _order(bottom: bool, seed: int | None) -> list[Column]:
    if seed is not None:
        return [draw(F.lit(seed), F.col("row_id")), F.col("row_id")]
    return [F.col("metric").asc() if bottom else F.col("metric").desc(), F.col("row_id")]


def top_by_budget(attributes: DataFrame, budgets: DataFrame, by: list[str], bottom: bool = False, margin: float | None = None, seed: int | None = None) -> DataFrame:
    """Best rows of each group up to the row that reaches the group's budget, that row included; always at least one.

    ``budgets`` has ``by`` and ``budget``. Ties are broken by ``row_id``. With ``margin`` only
    the first ``ceil(n * (budget / total + margin))`` rows of a group are candidates. With
    ``seed`` the order is a seeded permutation instead of the metric.
    """
    ranked = running_total(attributes, by, _order(bottom, seed), {"reached": F.col("n_tokens"), "place": F.lit(1)})
    size = budgets.select(*[F.col(c).alias(f"_{c}") for c in by], "budget", *([F.col("total").alias("_total"), F.col("n").alias("_n")] if margin is not None else []))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = ranked.join(size, reduce(Column.__and__, same)) if by else ranked.crossJoin(F.broadcast(size))
    chosen = joined.where((F.col("reached") - F.col("n_tokens") < F.col("budget")) | (F.col("place") == 1))
    if margin is not None:
        chosen = chosen.where(F.col("place") <= F.ceil(F.col("_n") * (F.col("budget") / F.col("_total") + margin)))
    return chosen.select(*attributes.columns, "place")


def _totals(attributes: DataFrame, by: list[str]) -> DataFrame:
    return attributes.groupBy(*by).agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n"), F.min("metric").alias("lowest"), F.max("metric").alias("highest"))


def budgets_for(attributes: DataFrame, tokens: int, strategy: str) -> tuple[DataFrame, list[str]]:
    """(budget of each group, grouping columns) of a strategy.

    ``uniform``: one budget. ``org_domain``: by the first domain's share of tokens, rounded
    down. ``equi_domain``: equal. ``multi_domain``: by share to the first domain, then by
    share to the second inside it, rounded down each time.
    """
    if strategy == "uniform":
        return _totals(attributes, []).withColumn("budget", F.lit(int(tokens))), []
    per = _totals(attributes, ["domain_1"])
    whole = per.agg(F.sum("total").alias("whole"), F.count("*").alias("groups"))
    share = F.floor(F.col("total").cast("decimal(38,0)") * F.lit(int(tokens)) / F.col("whole")).cast("long")
    if strategy == "org_domain":
        return per.crossJoin(F.broadcast(whole)).withColumn("budget", share).drop("whole", "groups"), ["domain_1"]
    if strategy == "equi_domain":
        return per.crossJoin(F.broadcast(whole)).withColumn("budget", F.floor(F.lit(int(tokens)) / F.col("groups")).cast("long")).drop("whole", "groups"), ["domain_1"]
    if strategy == "multi_domain":
        outer = per.crossJoin(F.broadcast(whole)).select("domain_1", share.alias("outer"), F.col("total").alias("outer_total"))
        inner = _totals(attributes, ["domain_1", "domain_2"]).join(outer, "domain_1")
        part = F.floor(F.col("total").cast("decimal(38,0)") * F.col("outer") / F.col("outer_total")).cast("long")
        return inner.withColumn("budget", part).drop("outer", "outer_total"), ["domain_1", "domain_2"]
    raise ValueError(f"unknown strategy {strategy!r}")


def select_subset(
    attributes: DataFrame, tokens: int, strategy: str | None = "uniform", bottom: bool = False, margin: float | None = None, seed: int | None = None, upsample: bool = False,
) -> DataFrame:
    """Rows of the subset, with their attributes and ``copy_no`` (0, or 1 and up for up-sampled copies).

    Rows whose metrics are all equal come in a seeded permutation. Filters come first, as shares are taken of what is left. ``strategy=None`` keeps every
    row. An empty table gives an empty subset; a budget over the total gives every row, and
    with ``upsample`` also draws with replacement until the budget is reached.
    """
    if strategy is None:
        return attributes.withColumn("copy_no", F.lit(0))
    budgets, by = budgets_for(attributes, tokens, strategy)
    budgets = checkpointed(budgets)
    if seed is None:
        # Where no metric tells rows apart, a permutation does, so that the subset is no run of ids.
        ends = budgets.agg(F.min("lowest").alias("low"), F.max("highest").alias("high")).first()
        seed = 0 if ends.low is not None and ends.low == ends.high else None
    chosen = top_by_budget(attributes, budgets, by, bottom, margin, seed)
    if not upsample:
        return chosen.drop("place").withColumn("copy_no", F.lit(0))
    return _upsampled(checkpointed(chosen), budgets, by, 0 if seed is None else seed)


def _upsampled(chosen: DataFrame, budgets: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Adds ``ceil(shortfall / mean tokens)`` seeded draws to each group that stays short, again until none is."""
    out = chosen.withColumn("copy_no", F.lit(0))
    added = chosen.groupBy(*by).agg(F.sum("n_tokens").alias("have"), F.count("*").alias("rows"))
    state = budgets.select(*by, "budget").join(added, by) if by else budgets.select("budget").crossJoin(added)
    state = state.withColumn("drawn", F.lit(0).cast("long")).withColumn("base", F.col("rows"))
    # Each turn draws at least one row of each short group, and every row has tokens, so the loop ends.
    while True:
        short = checkpointed(state.where("have < budget and rows > 0").withColumn("draws", F.ceil((F.col("budget") - F.col("have")) / (F.col("have") / (F.col("rows") + F.col("drawn"))))))
        if short.isEmpty():
            break
        # Draw j of a group is a row number; draws of one group are made by as many tasks as there are blocks.
        blocks = short.select(*by, "base", "drawn", "draws", F.explode(F.sequence(F.lit(0), F.floor((F.col("draws") - 1) / 4096))).alias("block")).repartition(*by, "block")
        drawn = blocks.select(*by, "base", F.explode(F.sequence(F.col("drawn") + F.col("block") * 4096 + 1, F.col("drawn") + F.least(F.col("draws"), (F.col("block") + 1) * 4096))).alias("copy_no"))
        picks = drawn.withColumn("place", draw(F.lit(seed), *[F.col(c) for c in by], F.col("copy_no")) % F.col("base") + 1).drop("base")
        extra = checkpointed(picks.join(chosen, [*by, "place"]).select(*chosen.columns, F.col("copy_no").cast("int")))
        out = out.unionByName(extra)
        more = extra.groupBy(*by).agg(F.sum("n_tokens").alias("more"), F.count("*").alias("count"))
        joined = short.join(more, by) if by else short.crossJoin(more)
        state = joined.select(*by, "budget", (F.col("have") + F.col("more")).alias("have"), "rows", (F.col("drawn") + F.col("count")).alias("drawn"), "base")
    return out.drop("place")


def fetch(data: DataFrame, selected: DataFrame, row_id: str) -> DataFrame:
    """The wide rows of a selection; a row selected several times comes several times, as ``copy_no``."""
    return data.join(selected.select(F.col("row_id").alias(row_id), "copy_no"), row_id)


def shard_by_tokens(rows: DataFrame, tokens_per_shard: int, order: str = "row_id") -> DataFrame:
    """Adds ``shard``: rows in order, a new shard each ``tokens_per_shard`` tokens by the tokens before a row."""
    if tokens_per_shard <= 0:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    summed = running_total(rows, [], [F.col(order)], {"reached": F.col("n_tokens")})
    return summed.withColumn("shard", F.floor((F.col("reached") - F.col("n_tokens")) / tokens_per_shard)).drop("reached")


def shard_by_rows(rows: DataFrame, tokens_per_shard: int, order: str = "row_id") -> DataFrame:
    """Adds ``shard`` with boundaries at rows ``round(i * limit / total * n)`` (half to even), as if all rows had equal tokens."""
    numbered = running_total(rows, [], [F.col(order)], {"_place": F.lit(1)})
    whole = rows.agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n"))
    # Edge i is near i * step, so the edges before a row are those up to about place / step, give or take one.
    edge = lambda i: F.bround(i * tokens_per_shard / F.col("_t") * F.col("_n"))
    edges = F.greatest(F.lit(1), F.ceil(F.col("_t") / tokens_per_shard))
    near = F.greatest(F.floor(F.col("_place") * F.col("_t") / F.col("_n") / tokens_per_shard) - 2, F.lit(0))
    some = F.sequence(F.lit(1), F.lit(4))
    return (
        numbered.crossJoin(F.broadcast(whole))
        .withColumn("_near", F.least(near, edges))
        .withColumn("shard", (F.col("_near") + F.size(F.filter(some, lambda k: (F.col("_near") + k <= edges) & (edge(F.col("_near") + k) < F.col("_place"))))).cast("long"))
        .drop("_near", "_t", "_n", "_place")
    )


def shard_contiguous(rows: DataFrame, shards: int, order: str = "row_id") -> DataFrame:
    """Adds ``shard``: contiguous parts, the first ``n % shards`` of them one row longer."""
    numbered = running_total(rows, [], [F.col(order)], {"_place": F.lit(1)})
    whole = rows.agg(F.count("*").alias("_n"))
    low, extra = F.floor(F.col("_n") / shards), F.col("_n") % shards
    cut = extra * (low + 1)
    at = F.col("_place") - 1
    shard = F.when(at < cut, F.floor(at / (low + 1))).otherwise(extra + F.floor((at - cut) / F.greatest(low, F.lit(1))))
    return numbered.crossJoin(F.broadcast(whole)).withColumn("shard", shard.cast("long")).drop("_place", "_n")


def shard_strided(rows: DataFrame, shards: int, order: str = "row_id") -> DataFrame:
    """Adds ``shard``: the row's number modulo ``shards``."""
    numbered = running_total(rows, [], [F.col(order)], {"_place": F.lit(1)})
    return numbered.withColumn("shard", (F.col("_place") - 1) % shards).drop("_place")


def tail_fraction(rows: DataFrame, by: list[str], score: str, tie: str, fraction: float = 0.01) -> DataFrame:
    """Top and bottom ``max(floor(fraction * n), 1)`` rows of each group by score: ``tail`` is ``top`` or ``bottom``; the tails may overlap."""
    sizes = checkpointed(rows.groupBy(*by).agg(F.greatest(F.floor(F.count("*") * fraction), F.lit(1)).alias("_most")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    out = []
    for tail, first in (("top", F.col(score).desc()), ("bottom", F.col(score).asc())):
        ranked = running_total(rows, by, [first, F.col(tie)], {"_place": F.lit(1)})
        out.append(ranked.join(sizes, by).where("_place <= _most").drop("_most").withColumn("tail", F.lit(tail)).withColumnRenamed("_place", "place"))
    return out[0].unionByName(out[1])
