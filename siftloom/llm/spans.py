"""Long exact spans shared between records (problem 8).

Method: Rabin-Karp hashes of every fixed-length window of code points, counted in
Spark; repeated windows merge into maximal removal intervals. The tokens are code
points, as the spans are asked for in them.

Counting a window at every code point would shuffle many times the input, so the
count runs twice, and loses nothing:

1. Every window of 2/3 of the length is hashed. Of each ``length - probe + 1``
   neighbouring ones only the least hash is counted (winnowing). Any span of the full
   length holds one of these neighbourhoods entirely, so two records that share such a
   span share the least hash too; a hash found in one record only rules out its place.
2. Only windows of the full length around a hash found in several records are hashed
   and counted. What is counted twice or more here is the result.

A window is known by two independent 64-bit hashes, so windows that differ are never
counted as one (at 10**12 windows the chance is under 10**-14).

Scale: texts are read twice, once for the winnowed hashes and the digests that tell
copies, once for the windows around hashes found in several texts. About 2 hashes per
100 code points are counted in the first pass, and the second follows what is shared.
Counts are partially aggregated (least and greatest record id of a hash), so a hash in a
third of all records is no hot key. A small set of repeated hashes is broadcast after its
size has been checked; a larger one is joined by shuffle. Copies of one text go through
as one record; ``shared_links`` never expands them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import checkpointed

from .common import hinted

MIN_LENGTH = 300
SALTS = 16
#: Places (4 bytes each) that may be broadcast together with the ids of their texts.
BROADCAST_PLACES = 8_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, _U)
        p[0] = 1
        both.append(np.cumprod(p, dtype=_U))
    return both[0], both[1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``k`` codes, from prefix sums modulo 2**64."""
    n = len(codes)
    if n < k:
        return np.empty(0, _U)
    power, inverse = _powers(1 << max(16, n.bit_length()))
    prefix = np.zeros(n + 1, _U)
    np.cumsum(_mix(codes.astype(_U) + _U(0x1F3D5B79)) * power[:n], dtype=_U, out=prefix[1:])
    return _mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the least hash of some ``w`` neighbours; all ties are kept, so the choice depends on content alone."""
    n = len(hashes)
    if n < w:
        return np.empty(0, np.int64)
    least, span = hashes, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - w + 1], least[w - span : w - span + n - w + 1])
    # The place p is chosen if some window that holds it has its hash as least, so look at the greatest of the leasts around p.
    pad = np.zeros(w - 1, _U)
    most, span = np.concatenate([pad, least, pad]), 1
    while span * 2 <= w:
        most = np.maximum(most[:-span], most[span:])
        span *= 2
    if span < w:
        most = np.maximum(most[:n], most[w - span : w - span + n])
    return np.flatnonzero(most[:n] == hashes)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def _second(codes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each window, over other values of the code points."""
    n = len(codes)
    power, inverse = _powers(1 << max(16, n.bit_length()))
    prefix = np.zeros(n + 1, _U)
    np.cumsum(_mix((codes.astype(_U) ^ _U(0x5BD1E995)) * _U(0xC2B2AE3D27D4EB4F)) * power[:n], dtype=_U, out=prefix[1:])
    return _mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])


def _records(documents: DataFrame, min_length: int) -> DataFrame:
    """Texts long enough to share a span, with their id."""
    return documents.where((F.length("text") >= min_length) & F.col("doc_id").isNotNull()).select("doc_id", "text")


def shared_windows(documents: DataFrame, min_length: int = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(``hash, check, prev, doc_id, start`` of windows that may be shared, ``doc_id, rep, n_chars`` of the texts that have copies).

    ``rep`` is the least id of the records of one text, told by 128-bit digest and length;
    windows are given for ``rep`` only. ``prev`` is the hash of the window one code point
    earlier; at the start of a text a value of the record's own. Every window that two
    different texts share is among the rows, beside some that they don't.
    """
    probe = max(1, 2 * min_length // 3)
    around = min_length - probe + 1
    texts = _records(documents, min_length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, found, places, ends = [], [], [], [], [0]
            for text in b.column("text").to_pylist():
                codes = _codes(text)
                hashes = window_hashes(codes, probe)
                at = winnowed(hashes, around)
                digests.append(blake2b(codes.tobytes(), digest_size=16).digest())
                sizes.append(len(codes))
                found.append(hashes[at])
                places.append(at.astype(np.int32))
                ends.append(ends[-1] + len(at))
            if sizes:
                ends_ = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends_, _long(np.concatenate(found))), pa.ListArray.from_arrays(ends_, pa.array(np.concatenate(places), pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "digest", "n_chars", "hashes", "places"])

    probes = checkpointed(texts.mapInArrow(scan, "doc_id bigint, digest binary, n_chars bigint, hashes array<bigint>, places array<int>"))
    reps = probes.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = checkpointed(probes.select("doc_id", "digest", "n_chars").join(hinted(checkpointed(reps)), ["digest", "n_chars"]).select("doc_id", "rep", "n_chars").distinct())
    copies = hinted(same.where("doc_id > rep").select("doc_id"))
    single = probes.join(copies, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("p")).select("doc_id", "p.hashes", "p.places")
    repeated = checkpointed(single.groupBy(F.col("hashes").alias("hash")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash"))
    places = checkpointed(single.join(hinted(repeated), single["hashes"] == repeated["hash"]).groupBy("doc_id").agg(F.collect_set("places").alias("places")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, at in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("places").to_pylist()):
                codes = _codes(text)
                hashes = window_hashes(codes, min_length)
                edge = np.zeros(len(hashes) + 1, np.int32)
                low = np.asarray(at, np.int64)
                np.add.at(edge, np.minimum(np.maximum(low - around + 1, 0), len(hashes)), 1)
                np.add.at(edge, np.minimum(low + 1, len(hashes)), -1)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                own = _mix(np.array([doc], np.int64).view(_U) ^ _U(0xA0761D6478BD642F))[0]
                out.append((hashes[start], _second(codes, min_length)[start], np.where(start > 0, hashes[start - 1], own), np.full(len(start), doc, np.int64), start.astype(np.int32)))
            if out:
                *long, start = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([*map(_long, long), pa.array(start, pa.int32())], names=["hash", "check", "prev", "doc_id", "start"])

    size = places.agg(F.sum(F.size("places") + 8)).first()[0] or 0
    held = texts.join(F.broadcast(places) if size <= BROADCAST_PLACES else places, "doc_id").select("doc_id", "text", "places")
    return held.mapInArrow(expand, "hash bigint, check bigint, prev bigint, doc_id bigint, start int"), same


def _salted(df: DataFrame, mine: str, other: str) -> DataFrame:
    """``df`` with a salt of its own rows as ``mine``, and once for every salt of the other side as ``other``."""
    return df.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(other))


def _linked(windows: DataFrame) -> DataFrame:
    """``rep_a < rep_b`` of each pair of different texts that share a window, once.

    A pair is taken at the first window of each span it shares: there the windows before
    differ or one text begins. Windows whose records all share the one before are skipped.
    """
    windows = checkpointed(windows)
    key = ["hash", "check"]
    heads = windows.groupBy(*key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("prev").alias("p"), F.max("prev").alias("q")).where("a < b and p <> q").select(*key)
    members = checkpointed(windows.join(hinted(checkpointed(heads)), key).select(*key, "prev", "doc_id").distinct())
    # The records of one window are split by salt on both sides, so the pairs of a common span are made by many tasks.
    left, right = _salted(members, "s", "t").withColumnsRenamed({"prev": "prev_a", "doc_id": "rep_a"}), _salted(members, "t", "s").withColumnsRenamed({"prev": "prev_b", "doc_id": "rep_b"})
    return left.join(right, [*key, "s", "t"]).where("rep_a < rep_b and prev_a <> prev_b").select("rep_a", "rep_b").distinct()


def shared_pairs(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id_a < doc_id_b``: each pair of records that share a span of at least ``min_length`` code points, once.

    ``documents`` has ``doc_id BIGINT`` (unique) and ``text``; other columns are ignored.
    Null or shorter texts and null ids take no part; a repeated row is its own copy and
    forms no pair. Spans within one record don't count. An empty table gives no pair.
    Copies are expanded into all their pairs, as the result asks for each; where texts
    have many, use ``shared_links``.
    """
    windows, same = shared_windows(documents, min_length)
    pairs, groups = _linked(windows), same.select("doc_id", "rep")
    # Each record stands for its copies; copies also form pairs among themselves.
    a, b = (groups.select(F.col("rep").alias(f"rep_{x}"), F.col("doc_id").alias(f"of_{x}")) for x in "ab")
    wide = pairs.join(hinted(a), "rep_a", "left").join(hinted(b), "rep_b", "left")
    x, y = F.coalesce("of_a", "rep_a"), F.coalesce("of_b", "rep_b")
    across = wide.select(F.least(x, y).alias("doc_id_a"), F.greatest(x, y).alias("doc_id_b"))
    one, two = _salted(groups, "s", "t").withColumnRenamed("doc_id", "doc_id_a"), _salted(groups, "t", "s").withColumnRenamed("doc_id", "doc_id_b")
    within = one.join(two, ["rep", "s", "t"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return across.unionByName(within)


def shared_links(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every record once: ``doc_id, class_id, n_copies, n_links``.

    ``class_id`` is the least id of the records of the same text, ``n_copies`` how many
    those are, and ``n_links`` the number of other records that share a span with it. Links
    between different texts are all counted, copies by their number, without being paired.
    Short, empty and null texts are a class of their own without links; null ids are left
    out; an id that comes twice is one record.
    """
    windows, same = shared_windows(documents, min_length)
    pairs = _linked(windows)
    sizes = same.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    links = both.join(hinted(sizes.withColumnRenamed("rep", "rep_b")), "rep_b", "left").groupBy(F.col("rep_a").alias("class_id")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("across"))
    ids = documents.select("doc_id").where("doc_id is not null").distinct()
    classed = ids.join(hinted(same.select("doc_id", "rep")), "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("class_id"))
    out = classed.join(hinted(sizes.withColumnRenamed("rep", "class_id")), "class_id", "left").join(links, "class_id", "left")
    n = F.coalesce("n", F.lit(1))
    return out.select("doc_id", "class_id", n.alias("n_copies"), (n - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))


def shared_spans(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Maximal intervals of each record that also stand in another: ``doc_id, span_start, span_end`` (end exclusive, in code points).

    Windows that repeat in another record are merged where they touch or overlap. A record
    with copies is one interval from end to end. Nulls and short texts as in ``shared_pairs``.
    """
    windows, same = shared_windows(documents, min_length)
    windows = checkpointed(windows)
    counted = windows.groupBy("hash", "check").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash", "check")
    hit = windows.join(counted, ["hash", "check"], "left_semi").select("doc_id", "start")
    order = Window.partitionBy("doc_id").orderBy("start")
    fresh = F.when(F.col("start") - F.lag("start").over(order) <= min_length, 0).otherwise(1)
    runs = hit.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("span_start"), (F.max("start") + min_length).alias("span_end")).drop("run")
    whole = same.select("doc_id", F.lit(0).alias("span_start"), F.col("n_chars").cast("int").alias("span_end"))
    return spans.join(hinted(same.select("doc_id")), "doc_id", "left_anti").unionByName(whole)


def shared_share(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Every record with ``n_chars, shared_chars, shared_share`` and its number of shared spans; 0 where nothing is shared."""
    spans = shared_spans(documents, min_length).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    share = F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0))
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_chars", zero("n_spans"), zero("shared_chars"), share.alias("shared_share"))
