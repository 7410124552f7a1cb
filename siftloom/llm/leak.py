"""Evaluation texts leaking into training text (problem 1).

Method: a BM25 inverted index of the test items with block-max pruning. Terms are pairs
of neighbouring tokens (words, or single Chinese characters). Every training text is
cut into overlapping passages, each passage is a query, and every item that scores at
or above the item's own threshold is retrieved; question and answer overlap are then
verified on the tokens.

The threshold loses nothing: it is the least score that any run of half the item can
have after two changed tokens (each spoils two terms), so a passage that holds such a
run scores at least that. Pruning goes from bound to score as in block-max WAND, for
all passages of a batch at once: the sum of each term's greatest impact against the
least threshold of all items, then the sum of its greatest impact in a block of items
against the least threshold in the block, then the scores themselves.

Scale: the texts are read and cut into tokens once, whatever the number of items, and
nothing of them is shuffled. The index comes in blocks of at most ``BLOCK_ITEMS`` items,
each a broadcast of bounded size; the driver builds one at a time and keeps none, and a
worker keeps at most ``KEPT_BLOCKS`` loaded. Shared stems are counted and joined to the
items in Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items an index block holds; with queries of up to about 100 tokens it stays under 20 MB.
BLOCK_ITEMS = 20_000
#: Blocks a worker keeps in memory; the others are loaded for each batch of texts.
KEPT_BLOCKS = 8
#: An n-gram of this many tokens that stands in so many items is part of a shared stem.
STEM_TOKENS, STEM_ITEMS = 4, 3
#: Unchanged tokens beyond shared stems with which any run counts: so many, and one in so many of all such tokens of the item.
#: With fewer a run counts if the text holds half of the item without the dropped tokens, and of the run's tokens beyond
#: stems as many are unchanged as changed, one at least. Below that a stem with a common word behind it would count.
OWN_TOKENS, OWN_PART = 3, 4
CHANGES = 2
K1, B = 1.2, 0.75
_CHUNK_CHARS = 2_000_000
FOUND = "doc_id bigint, item_id bigint, question_share double, answer_near boolean"

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&(?:[a-z]{2,8}|#\d{2,6});")
_UNSEEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_HAN = "㐀-䶿一-鿿豈-﫿"
_NARROW = re.compile("[a-z0-9]+")
_WIDE = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_IS_HAN = re.compile(f"[{_HAN}]")


def tokens(text: str | None) -> list[str]:
    """Lower-case words and single Chinese characters; markup, punctuation, blanks and unseen characters are dropped."""
    if not text:
        return []
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text) if text.isascii() or not _IS_HAN.search(text) else _MARKUP.sub("", text)
    return (_NARROW if text.isascii() else _WIDE).findall(text)


def with_stems(items: DataFrame) -> DataFrame:
    """``items`` with ``stem_at``: the token numbers at which an n-gram begins that stands in several queries. Null queries have none."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for q in b.column("query").to_pylist():
                t = tokens(q)
                for i in range(len(t) - STEM_TOKENS + 1):
                    for x, v in zip(out, (q, " ".join(t[i : i + STEM_TOKENS]), i)):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int32()))], names=["query", "gram", "at"])

    placed = items.select("query").where("query is not null").distinct().mapInArrow(grams, "query string, gram string, at int")
    shared = placed.select("query", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= STEM_ITEMS).select("gram")
    stems = placed.join(shared, "gram").groupBy("query").agg(F.collect_list("at").alias("stem_at"))
    return items.join(stems, "query", "left")


@dataclass
class Index:
    """Items of one block: their tokens, thresholds and the positional postings of their terms."""

    ids: list
    vocabulary: dict[str, int]
    words: list[np.ndarray]
    weights: list[np.ndarray]  # running weight of the tokens
    own: list[np.ndarray]  # tokens outside shared stems
    answers: list[list[list[str]]]
    golds: list[int]
    keys: np.ndarray  # sorted terms, as first token * size of vocabulary + second
    start: np.ndarray  # postings of a term: item, place, impact
    item: np.ndarray
    place: np.ndarray
    impact: np.ndarray
    threshold: np.ndarray
    need: np.ndarray  # terms on neighbouring diagonals that a case has at least
    step: int
    block: int
    term_most: np.ndarray
    b_start: np.ndarray  # blocks of a term, with its greatest impact there
    b_block: np.ndarray
    b_most: np.ndarray
    b_threshold: np.ndarray
    item_block: np.ndarray
    marks: np.ndarray  # hashed terms, to drop most others before the search


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def build_index(rows: list, block: int = 16) -> Index | None:
    """``rows`` are (item_id, query, choices, gold, stem_at). Items without a token are left out."""
    ids, words, weights, own, answers, golds = [], [], [], [], [], []
    vocabulary: dict[str, int] = {}
    for item_id, query, choices, gold, stem_at in rows:
        t = tokens(query)
        if not t or item_id is None:
            continue
        han = sum(bool(_IS_HAN.match(x)) for x in t) * 2 > len(t)
        mask = np.ones(len(t), bool)
        for i in stem_at or ():
            mask[i : i + STEM_TOKENS] = False
        ids.append(item_id)
        words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in t], np.int64))
        weights.append(np.concatenate([[0], np.cumsum([len(x) if han else 1 for x in t])]))
        own.append(mask)
        answers.append([tokens(c) for c in choices or []])
        golds.append(-1 if gold is None else int(gold))
    if not ids:
        return None
    size, n = len(vocabulary), len(ids)
    pairs = [w[:-1] * size + w[1:] for w in words]
    flat = np.concatenate(pairs) if n else np.empty(0, np.int64)
    item = np.repeat(np.arange(n), [len(p) for p in pairs])
    place = np.concatenate([np.arange(len(p)) for p in pairs])
    # BM25 impacts of a term in an item; a passage counts a term once.
    per_item = [Counter(p.tolist()) for p in pairs]
    df = Counter(t for c in per_item for t in c)
    mean = max(1.0, float(np.mean([len(p) for p in pairs])))
    impacts = []
    for c, p in zip(per_item, pairs):
        norm = K1 * (1 - B + B * len(p) / mean)
        impacts.append({t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()})
    threshold, need, longest = np.empty(n), np.empty(n, np.int64), 1
    for k, (p, w) in enumerate(zip(pairs, weights)):
        least, fewest = np.inf, 1 << 30
        for i in range(len(w) - 1):
            j = int(np.searchsorted(w, w[i] + w[-1] / 2 - 1e-9))
            if j >= len(w):
                break
            longest = max(longest, j - i)
            run = sorted({t: impacts[k][t] for t in p[i : j - 1].tolist()}.values())
            least = min(least, sum(run[: max(0, len(run) - 2 * CHANGES)]))
            fewest = min(fewest, j - 1 - i - 2 * CHANGES)
        threshold[k], need[k] = max(least - 1e-6, 1e-9), max(fewest, 1)
    order = np.lexsort((place, item, flat))
    keys, first = np.unique(flat[order], return_index=True)
    start = np.append(first, len(flat))
    item, place = item[order], place[order]
    impact = np.array([impacts[i][t] for i, t in zip(item.tolist(), flat[order].tolist())])
    term_of = np.repeat(np.arange(len(keys)), np.diff(start))
    term_most = np.zeros(len(keys))
    np.maximum.at(term_most, term_of, impact)
    # Blocks follow the thresholds, so that an item with a low one does not keep its neighbours open.
    rank = np.empty(n, np.int64)
    rank[np.argsort(threshold, kind="stable")] = np.arange(n)
    b_keys, inverse = np.unique(term_of * (n // block + 1) + rank[item] // block, return_inverse=True)
    b_most = np.zeros(len(b_keys))
    np.maximum.at(b_most, inverse, impact)
    b_term, b_block = np.divmod(b_keys, n // block + 1)
    b_threshold = np.full(n // block + 1, np.inf)
    np.minimum.at(b_threshold, rank // block, threshold)
    marks = np.zeros(1 << 20, bool)
    marks[_slot(keys)] = True
    return Index(
        ids, vocabulary, words, weights, own, answers, golds, keys, start, item, place, impact, threshold, need, longest + 2 * CHANGES, block,
        term_most, np.searchsorted(b_term, np.arange(len(keys) + 1)), b_block, b_most, b_threshold, rank // block, marks,
    )


def _spread(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each term all rows ``start[t] .. start[t + 1]``: (row number, which term it came from)."""
    n = start[terms + 1] - start[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[terms][of], of


def _sum_by(keys: np.ndarray, values: np.ndarray, range_: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their values; without a sort where the range of keys is small."""
    if range_ <= 4_000_000:
        sums = np.bincount(keys, values, range_)
        unique = np.flatnonzero(sums)
        return unique, sums[unique]
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, values, len(unique))


def _among(sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is missing."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def retrieve(ix: Index, stream: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidates of a batch of texts.

    ``stream`` holds the token numbers of the texts one after another (-1: not in any
    item), ``offsets`` where each begins. Returns text, item and the places (in the
    stream, in the item) of each shared term of the retrieved pairs.
    """
    none = (np.empty(0, np.int64),) * 4
    at = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0)) if len(stream) > 1 else np.empty(0, np.int64)
    if not len(at) or not len(ix.keys):
        return none
    key = stream[at] * len(ix.vocabulary) + stream[at + 1]
    maybe = np.flatnonzero(ix.marks[_slot(key)])
    at, key = at[maybe], key[maybe]
    term = np.minimum(np.searchsorted(ix.keys, key), len(ix.keys) - 1)
    hit = ix.keys[term] == key
    at, term = at[hit], term[hit]
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + 1 < offsets[text + 1]
    at, term, text = at[inside], term[inside], text[inside]
    if not len(at):
        return none
    # Cells of step tokens; a passage is two neighbouring cells of one text, so every run of a half lies in one passage.
    # An empty cell ends each text, so that the last passage of one text never reaches into the next.
    cells = (np.diff(offsets) // ix.step) + 2
    base = np.concatenate([[0], np.cumsum(cells)])
    cell, n_cells = base[text] + (at - offsets[text]) // ix.step, int(base[-1])
    # WAND: no item can reach its threshold where the greatest impacts together stay under the least.
    bound = np.bincount(cell, ix.term_most[term], n_cells)
    alive = bound + np.append(bound[1:], 0) >= ix.threshold.min()
    near = alive | np.append(False, alive[:-1])
    use = np.flatnonzero(near[cell])
    # Block-max: the same within each block of items.
    blocks = len(ix.b_threshold)
    row, of = _spread(ix.b_start, term[use])
    key, bound = _sum_by(cell[use][of] * blocks + ix.b_block[row], ix.b_most[row], n_cells * blocks)
    pair = np.unique(np.concatenate([key, key[key >= blocks] - blocks]))
    value = _look(key, bound, pair) + _look(key, bound, pair + blocks)
    pair = pair[value >= ix.b_threshold[pair % blocks]]
    if not len(pair):
        return none
    # Scores of the items in the blocks that are left. A term counts once a passage and item.
    near = np.zeros(n_cells + 1, bool)
    near[pair // blocks], near[pair // blocks + 1] = True, True
    use = use[near[cell[use]]]
    row, of = _spread(ix.start, term[use])
    of = use[of]
    row, of = np.tile(row, 2), np.tile(of, 2)
    passage = cell[of]
    passage[len(of) // 2 :] -= 1
    kept = _among(pair, passage * blocks + ix.item_block[ix.item[row]])
    row, of, passage = row[kept], of[kept], passage[kept]
    n = len(ix.ids)
    couple = passage * n + ix.item[row]
    once = np.unique(couple * len(ix.keys) + term[of], return_index=True)[1]
    found, score = _sum_by(couple[once], ix.impact[row[once]])
    found = found[score >= ix.threshold[found % n]]
    kept = _among(found, couple)
    row, of = row[kept], of[kept]
    return text[of], ix.item[row], at[of], ix.place[row]


def _reach(q: list[int], d: list[int], own: list[int], i: int, j: int, changes: int) -> tuple[int, int, int]:
    """Farthest (end in the item, end in the text, equal tokens outside stems) of a run from (i, j) with so many changed, added or dropped tokens."""
    first = i
    while i < len(q) and j < len(d) and q[i] == d[j]:
        i, j = i + 1, j + 1
    equal = own[i] - own[first]
    best = (i, j, equal)
    for n in range(1, changes + 1):  # n changes side by side
        for a in range(n + 1):
            for b in (n,) if a < n else range(n + 1):
                if i + a < len(q) and j + b < len(d) and q[i + a] == d[j + b]:
                    e, f, more = _reach(q, d, own, i + a, j + b, changes - n)
                    best = max(best, (e, f, equal + more))
    return best


def best_run(ix: Index, item: int, d: list[int], diagonals: list[int]) -> tuple[float, int, int]:
    """(share of the item, start and end in ``d``) of the longest run of the item in ``d`` along the diagonals given."""
    q, w = ix.words[item].tolist(), ix.weights[item]
    own = np.concatenate([[0], np.cumsum(ix.own[item])]).tolist()
    least = min(own[-1], max(OWN_TOKENS, -(-own[-1] // OWN_PART)))
    best = (0.0, 0, 0)
    for g in diagonals:
        for i in range(max(0, -g), min(len(q), len(d) - g)):
            j = i + g
            if q[i] != d[j] or (i and j and q[i - 1] == d[j - 1]):
                continue
            for changes in range(CHANGES, -1, -1):
                e, f, equal = _reach(q, d, own, i, j, changes)
                share = float(w[e] - w[i]) / float(w[-1])
                if share <= best[0]:
                    break
                held = w[e] - w[i] - max(0, (e - i) - (f - j))
                if equal >= least or (2 * equal >= max(2, own[e] - own[i]) and 2 * held >= w[-1]):
                    best = (share, j, f)
                    break
    return best


def _holds(part: list[str], whole: list[str]) -> bool:
    return bool(part) and any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))


def search(ix: Index, words: list[list[str]]) -> Iterator[tuple[int, int, float, bool]]:
    """Of texts given as their tokens: (text number, item number, share of the question, whether the right answer stands within a few lines of it)."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    get = ix.vocabulary.get
    stream = np.fromiter(map(get, chain.from_iterable(words), repeat(-1)), np.int64, int(offsets[-1]))
    text, item, at, place = retrieve(ix, stream, offsets)
    if not len(text):
        return
    # Terms of a case lie on few neighbouring diagonals: a changed token keeps the diagonal, an added or dropped one moves it by one.
    diagonal = at - offsets[text] - place
    lowest = int(diagonal.min())
    wide = int(diagonal.max()) - lowest + 1
    key = (text * len(ix.ids) + item) * wide + diagonal - lowest
    key = np.unique(key * (int(place.max()) + 1) + place) // (int(place.max()) + 1)
    lines, count = np.unique(key, return_counts=True)
    near = count.astype(np.int64)
    for s in range(1, CHANGES + 1):
        for way in (-s, s):
            k = np.searchsorted(lines, lines + way)
            ok = (k < len(lines)) & (lines[np.minimum(k, len(lines) - 1)] == lines + way) & (lines // wide == (lines + way) // wide)
            near += np.where(ok, count[np.minimum(k, len(lines) - 1)], 0)
    pair, line = np.divmod(lines, wide)
    keep = near >= ix.need[pair % len(ix.ids)]
    candidates: dict[int, list[int]] = defaultdict(list)
    for p, g in zip(pair[keep].tolist(), (line[keep] + lowest).tolist()):
        candidates[p].append(g)
    for p, diagonals in candidates.items():
        t, i = divmod(p, len(ix.ids))
        d = stream[offsets[t] : offsets[t + 1]].tolist()
        share, a, b = best_run(ix, i, d, diagonals)
        if share * ix.weights[i][-1] >= ix.weights[i][-1] / 2 - 1e-9:
            gold = ix.answers[i][ix.golds[i]] if 0 <= ix.golds[i] < len(ix.answers[i]) else []
            yield t, i, share, _holds(gold, words[t][max(0, a - 60) : b + 120])


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, item_id, question_share, answer_near`` of each text that holds an item's question or half of it in one run.

    ``documents`` has ``doc_id BIGINT, text``; ``eval_items`` has ``item_id BIGINT, query,
    choices ARRAY<STRING>, gold INT``; other columns are ignored. Null or empty texts and
    queries match nothing; items with a null id are left out. Texts are read whole. An
    item with an empty choice list or a gold out of range has ``answer_near`` false. A
    repeated item row adds nothing, a repeated text row repeats its pairs. Items whose
    half is so short that two changes leave no shared term are retrieved by any one term.
    """
    spark = documents.sparkSession
    # Of repeated rows of an item the first by content counts, so the answer is the same in every run.
    wanted = eval_items.select("item_id", "query", "choices", "gold").where("item_id is not null")
    first = F.min(F.struct(F.col("gold").isNull().alias("none"), "gold", "choices")).alias("first")
    wanted = with_stems(wanted.groupBy("item_id", "query").agg(first).select("item_id", "query", "first.choices", "first.gold"))
    blocks, rows = [], []

    def close() -> None:
        if (index := build_index(rows)) is not None:
            blocks.append(spark.sparkContext.broadcast(index))
        rows.clear()

    for r in wanted.select("item_id", "query", "choices", "gold", "stem_at").toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == BLOCK_ITEMS:
            close()
    close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            first = 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars < _CHUNK_CHARS):
                    chars += len(texts[last] or "")
                    last += 1
                words, found = [tokens(t) for t in texts[first:last]], []
                for k, block in enumerate(blocks):
                    ix = block.value
                    found += [(ids[first + t], ix.ids[i], s, a) for t, i, s, a in search(ix, words)]
                    if k >= KEPT_BLOCKS:
                        vars(block).pop("_value", None)  # it is loaded again from the worker's disk when next used
                first = last
                if found:
                    cols = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "question_share", "answer_near"])

    return documents.select("doc_id", "text").mapInArrow(run, FOUND) if blocks else spark.createDataFrame([], FOUND)


def item_report(eval_items: DataFrame, found: DataFrame) -> DataFrame:
    """Each item with the number of texts that hold it, and of those that hold its answer too: ``item_id, task_name, n_docs, n_with_answer``."""
    hits = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("answer_near"), F.col("doc_id"))).alias("n_with_answer"))
    items = eval_items.select("item_id", "task_name").dropDuplicates(["item_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return items.join(hits, "item_id", "left").select("item_id", "task_name", zero("n_docs"), zero("n_with_answer"))
