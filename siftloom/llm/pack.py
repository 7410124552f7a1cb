"""Filling fixed-capacity containers (problem 6).

Method: large-item matching. A text above the capacity is cut into full parts and a
rest; every other text stays whole. Items above a third of the capacity go at most
two to a bin, each open bin taking the largest item that still fits; the smaller
items then fill the remaining gaps by best fit, and open new bins once nothing fits.

Scale: items are spread by a hash of their id over packing groups of a bounded total
size, each packed by one task; a group leaves at most a bin or so part empty, so the
loss is one bin in ``group_tokens / capacity``. Only ids and sizes are shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a packing group on average, besides its bound in tokens.
GROUP_ROWS = 500_000
PACKED = "doc_id bigint, part int, n_tokens bigint, bin_id bigint, bin_offset bigint"


class _Sizes:
    """A multiset of sizes 0 to capacity with largest-at-most and smallest-at-least, as bits of one integer."""

    def __init__(self):
        self.items: dict[int, list[int]] = defaultdict(list)
        self.bits = 0

    def add(self, size: int, what: int) -> None:
        self.items[size].append(what)
        self.bits |= 1 << size

    def take(self, size: int) -> int:
        what = self.items[size].pop()
        if not self.items[size]:
            self.bits &= ~(1 << size)
        return what

    def at_most(self, size: int) -> int:
        return (self.bits & ((1 << (size + 1)) - 1)).bit_length() - 1

    def at_least(self, size: int) -> int:
        rest = self.bits >> size
        return size + (rest & -rest).bit_length() - 1 if rest else -1


def pack_sizes(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; every size is 1 to ``capacity``. Items of one size keep their order."""
    bins = [-1] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    n_large = sum(3 * s > capacity for s in sizes)
    large, gaps, made = _Sizes(), _Sizes(), 0
    for i in reversed(order[:n_large]):
        large.add(sizes[i], i)
    while large.bits:
        first = large.take(large.bits.bit_length() - 1)
        bins[first] = made
        gap = capacity - sizes[first]
        if (size := large.at_most(gap)) > 0:
            bins[large.take(size)] = made
            gap -= size
        gaps.add(gap, made)
        made += 1
    for i in order[n_large:]:
        if (gap := gaps.at_least(sizes[i])) < 0:
            gap, where = capacity, made
            made += 1
        else:
            where = gaps.take(gap)
        bins[i] = where
        gaps.add(gap - sizes[i], where)
    return bins


def pack(sizes: DataFrame, capacity: int = 2048, group_tokens: int = 16_000_000) -> DataFrame:
    """One row for each part of each text: ``doc_id, part, n_tokens, bin_id, bin_offset``.

    ``sizes`` has ``doc_id BIGINT, n_tokens BIGINT``; other columns are ignored. Texts
    without tokens (null or 0) get no row, since they fill nothing. A repeated row is
    packed each time. Parts are numbered from 0; only texts above ``capacity`` have more
    than one, all but the last full. Bins never hold more than ``capacity``. Bin ids are
    ``group * 2**32 + bin``. Rows with a null id are packed too. An empty table gives none.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = sizes.select("doc_id", "n_tokens").where("n_tokens > 0")
    total, rows = items.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // max(group_tokens, capacity)), -(-rows // GROUP_ROWS))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        n = pdf["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        parts = full + (rest > 0)
        of = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.where(part < full[of], capacity, rest[of])
        bins = np.asarray(pack_sizes(size.tolist(), capacity), dtype=np.int64)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[by_bin])
        starts = ends - size[by_bin]
        first = np.concatenate([[True], bins[by_bin][1:] != bins[by_bin][:-1]]) if len(bins) else np.zeros(0, bool)
        offset = np.empty(len(bins), np.int64)
        offset[by_bin] = starts - np.maximum.accumulate(np.where(first, starts, 0)) if len(bins) else starts
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].astype("Int64").to_numpy()[of] if pdf["doc_id"].isna().any() else pdf["doc_id"].to_numpy()[of],
            "part": part.astype(np.int32), "n_tokens": size, "bin_id": bins + (int(key[0]) << 32), "bin_offset": offset,
        })

    group = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()), F.col("n_tokens")), F.lit(groups))
    return items.withColumn("packing_group", group).groupBy("packing_group").applyInPandas(fill, PACKED)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Bins, tokens, mean fill and the least number of bins any packing could use, in one row."""
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.agg(
        F.count("*").alias("n_bins"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_parts"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / capacity).alias("least_bins"),
        F.round(F.try_divide(F.sum("used").cast("double"), F.count("*") * capacity), 6).alias("fill"),
    )


__all__ = ["fill_report", "pack", "pack_sizes"]
