"""Repetition inside a single document (problem 3).

Method: short-circuit cascade. Each rule gives an upper bound of the share of repeated
content; a text whose bound is under the threshold is rejected. Cost and rejection of
each rule are estimated on a sample of texts, and the rules run in order of rejection
per cost, each only over what the ones before left. The exact measure comes last, so
the order never changes the result, only the time.

Content is repeated where a run of five words (ten characters in Chinese) has stood
before in the same text, apart from letter case; blanks, punctuation and line breaks
between the words don't matter, and those inside a repeated run count as part of it.

Scale: one pass over the texts, in Python over whole batches as arrays, no shuffle.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, CHARS = 5, 10
THRESHOLD = 0.3
#: Texts and code points of the sample on which the rules are ordered.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 1_000_000
_CHUNK_CHARS = 1_000_000
_U = np.uint64
#: All code points; those from which none is a letter or digit, or has another case.
_TABLE, _LETTERS, _CASED = 0x110000, 0x40000, 0x20000
_HAN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x2FA20), (0x30000, 0x323B0))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point (0 between words, 1 in a word, 2 a Chinese character) and its lower case."""
    kind, low = np.zeros(_TABLE, np.uint8), np.arange(_TABLE, dtype=np.uint32)
    kind[:_LETTERS] = np.fromiter((chr(c).isalnum() for c in range(_LETTERS)), np.uint8, _LETTERS)
    for c in np.flatnonzero(kind[:_CASED]).tolist():
        if len(x := chr(c).lower()) == 1:
            low[c] = ord(x)
    for a, b in _HAN:
        kind[a:b] = 2
    return kind, low


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, by prefix sums modulo 2**64."""
    n = 1 << max(16, len(values).bit_length())
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(_mix(values) * _powers(n, _BASE)[: len(values)], dtype=_U, out=prefix[1:])
    return _mix((prefix[end] - prefix[start]) * _powers(n, _INVERSE)[start] + (end - start).astype(_U))


class Batch:
    """The words of several texts, one after another, as arrays."""

    def __init__(self, texts: list[str]):
        kind, low = _tables()
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = "\n".join(texts) + "\n"
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4")
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.sizes = sizes
        k = kind[codes]
        before = np.concatenate([[0], k[:-1]])
        after = np.concatenate([k[1:], [0]])
        self.start = np.flatnonzero((k == 2) | ((k == 1) & (before != 1)))
        self.end = np.flatnonzero((k == 2) | ((k == 1) & (after != 1))) + 1
        self.han = (k[self.start] == 2).astype(np.int64)
        self.text = np.searchsorted(self.begin, self.start, "right") - 1
        self.word = _ranges(low[codes].astype(_U), self.start, self.end)
        self.first = np.searchsorted(self.start, self.begin)  # first word of each text, and the end

    def of(self, texts: np.ndarray) -> np.ndarray:
        """Word numbers of the texts given."""
        a, n = self.first[texts], self.first[texts + 1] - self.first[texts]
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, hash with the text mixed in) of the runs of ``k`` words among ``words``."""
        last = self.first[self.text[words] + 1]
        a = words[words + k <= last]
        return a, a + k, self._hash(a, a + k)

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(_ranges(self.word, a, b) ^ (self.text[a].astype(_U) * _U(0x9E3779B97F4A7C15)))

    def runs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``grams``, for runs of five words, or in Chinese of the fewest words with ten characters."""
        last = self.first[self.text[words] + 1]
        han = np.concatenate([[0], np.cumsum(self.han)])
        a = words[words + WORDS <= last]
        a = a[2 * (han[a + WORDS] - han[a]) <= WORDS]
        chars = np.concatenate([[0], np.cumsum(self.end - self.start)])
        stop = np.searchsorted(chars, chars[words] + CHARS)
        ok = stop <= last
        c, d = words[ok], stop[ok]
        chinese = 2 * (han[d] - han[c]) > d - c
        x, y = np.concatenate([a, c[chinese]]), np.concatenate([a + WORDS, d[chinese]])
        return x, y, self._hash(x, y)

    def covered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points of each text inside any of the runs ``a .. b`` of words."""
        n = int(self.begin[-1]) + 1
        edge = np.bincount(self.start[a], minlength=n) - np.bincount(self.end[b - 1], minlength=n)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        return inside[self.begin[1:]] - inside[self.begin[:-1]]


def _not_first_fast(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each key stood at an earlier place; may also say so of others, as slots are shared. No sort."""
    bits = max(12, int(len(key)).bit_length() + 2)
    slot = key >> _U(64 - bits)
    order = np.argsort(place, kind="stable") if np.any(np.diff(place) < 0) else np.arange(len(place))
    table = np.zeros(1 << bits, np.int64)
    back = order[::-1]
    table[slot[back]] = place[back]
    return table[slot] != place


def _not_first(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.lexsort((place, key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


# A word of a repeated run, or a pair or triple of its words, has stood before too, so each of these bounds the measure.
def _bound(k: int):
    def rule(b: Batch, texts: np.ndarray) -> np.ndarray:
        a, e, h = b.grams(b.of(texts), k)
        again = _not_first_fast(h, a)
        if k > 1:
            return b.covered(a[again], e[again])
        # Single words leave out the blanks between them, which a repeated run includes: two neighbours are covered as one.
        both = np.flatnonzero(again[:-1] & again[1:] & (a[1:] == a[:-1] + 1) & (b.text[a[1:]] == b.text[a[:-1]]))
        return b.covered(np.concatenate([a[again], a[both]]), np.concatenate([e[again], e[both + 1]]))

    return rule


def _bound_runs(b: Batch, texts: np.ndarray) -> np.ndarray:
    a, e, h = b.runs(b.of(texts))
    again = np.zeros(len(a), bool)
    for part in (e - a == WORDS, e - a != WORDS):
        again[part] = _not_first_fast(h[part], a[part])
    return b.covered(a[again], e[again])


def repeated_chars(b: Batch, texts: np.ndarray) -> np.ndarray:
    """The exact measure: code points in runs that have stood before, without each run's first occurrence."""
    a, e, h = b.runs(b.of(texts))
    again = _not_first(h, a)
    return b.covered(a[again], e[again])


RULES = {"words": _bound(1), "pairs": _bound(2), "triples": _bound(3), "hashed_runs": _bound_runs}


def order_rules(texts: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Rules by rejection per cost over a sample, each judged on the texts that those before it left.

    A rule is left out once it would cost more than the exact measure it saves.
    """
    b = Batch(texts)
    left = np.flatnonzero(b.sizes > 0)
    order: list[str] = []

    def tried(rule) -> tuple[np.ndarray, float]:
        began = time.perf_counter()
        kept = rule(b, left)[left] >= threshold * b.sizes[left]
        return kept, time.perf_counter() - began

    while len(left) and len(order) < len(RULES):
        exact = tried(repeated_chars)[1]
        runs = {name: tried(rule) for name, rule in RULES.items() if name not in order}
        worth = {n: (1 - kept.mean()) / cost for n, (kept, cost) in runs.items() if (1 - kept.mean()) * exact > cost}
        if not worth:
            break
        order.append(max(worth, key=worth.get))
        left = left[runs[order[-1]][0]]
    return order


def cascade(texts: list[str], order: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """Numbers of the texts whose share of repeated content is at least the threshold."""
    b = Batch(texts)
    left = np.flatnonzero(b.sizes > 0)
    for name in [*order, "exact"]:
        if not len(left):
            break
        most = repeated_chars(b, left) if name == "exact" else RULES[name](b, left)
        left = left[most[left] >= threshold * b.sizes[left]]
    return left


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars < _CHUNK_CHARS):
            chars += len(texts[last] or "")
            last += 1
        yield first, [t or "" for t in texts[first:last]]
        first = last


def repetitive(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of each text whose share of repeated content is at least ``threshold``.

    ``documents`` has ``doc_id BIGINT, text``; other columns are ignored. Null and empty
    texts repeat nothing. A repeated row is judged each time; a null id is kept as null.
    An empty table gives no row. Texts are read whole.
    """
    short = F.length("text") <= SAMPLE_CHARS // 20
    rows = documents.select("text").where(short).sample(0.05, seed=11).limit(SAMPLE_TEXTS).collect()
    sample, chars = [], 0
    for r in rows:
        if chars + len(r.text) <= SAMPLE_CHARS:
            sample.append(r.text)
            chars += len(r.text)
    order = order_rules(sample, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, part in _chunks(texts):
                found = cascade(part, order, threshold)
                if len(found):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(found + first))], names=["doc_id"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint")


_LINES, _SENTENCES, _PARAGRAPHS = re.compile(r"[\r\n]+"), re.compile(r"(?<=[.!?。！？])\s*|[\r\n]+"), re.compile(r"(?:\r?\n){2,}")


def _duplicate_share(text: str, cut: re.Pattern) -> float:
    """Share of the code points in parts that have stood before, apart from case and outer blanks."""
    seen, again = set(), 0
    for part in cut.split(text):
        key = part.strip().lower()
        if key:
            again += len(key) if key in seen else 0
            seen.add(key)
    return again / len(text)


def repetition(documents: DataFrame) -> DataFrame:
    """Every text with its share of repeated content, and of repeated lines, sentences and paragraphs alone.

    ``doc_id, n_chars, repeated_chars, repeated_share, line_share, sentence_share,
    paragraph_share``. Null and empty texts have 0 everywhere; rows as in ``repetitive``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, part in _chunks(texts):
                b = Batch(part)
                n = repeated_chars(b, np.arange(len(part)))
                share = n / np.maximum(b.sizes, 1)
                rest = [[_duplicate_share(t, cut) if t else 0.0 for t in part] for cut in (_LINES, _SENTENCES, _PARAGRAPHS)]
                cols = [ids.slice(first, len(part)), pa.array(b.sizes), pa.array(n), pa.array(share), *(pa.array(x, pa.float64()) for x in rest)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_chars", "repeated_chars", "repeated_share", "line_share", "sentence_share", "paragraph_share"]
    schema = "doc_id bigint, n_chars bigint, repeated_chars bigint, " + ", ".join(f"{c} double" for c in names[3:])
    return documents.select("doc_id", "text").mapInArrow(run, schema)
