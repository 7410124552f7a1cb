"""Byte-pair token counts of texts under a public vocabulary.

A text is cut into pieces by the vocabulary's split pattern. Each distinct piece
is a linked list of symbols; a priority queue yields the merge of lowest rank,
leftmost first, until none applies, and the surviving symbols are counted once.
Texts are then summed as piece frequency times surviving symbols, which is exact.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from functools import lru_cache

import regex

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The split pattern of the byte-level vocabularies, with the white space of Unicode written out.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = r"'(?:[sdmt]|ll|ve|re)| ?{L}+| ?{N}+| ?[^{WS}{LN}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
WIDE = regex.compile(_PIECE.format(L=r"\p{L}", N=r"\p{N}", LN=r"\p{L}\p{N}", WS=_WS))
# The same over ASCII, where the standard module is faster.
NARROW = re.compile(_PIECE.format(L="[A-Za-z]", N="[0-9]", LN="A-Za-z0-9", WS="\\t-\\r "))


def pieces(text: str) -> list[str]:
    return (NARROW if text.isascii() else WIDE).findall(text)


class Memo(dict):
    """Surviving symbols by piece. Emptied at ``most`` entries, so memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        super().__init__()
        self.ranks, self.most = ranks, most
        # Bytes x, y that stand side by side in no token are never merged across, so a piece may be cut there.
        self.joined = frozenset((t[i], t[i + 1]) for t in ranks for i in range(len(t) - 1))

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        raw = piece.encode("utf-8", "surrogatepass")
        if raw in self.ranks:
            n = 1
        elif len(raw) == len(piece) or len(piece) == 1:
            n = self._survivors(raw)
        else:
            n, start, joined = 0, 0, self.joined
            ends = [c.encode("utf-8", "surrogatepass") for c in piece]
            for i in range(1, len(piece)):
                if (ends[i - 1][-1], ends[i][0]) not in joined:
                    n += self[piece[start:i]]
                    start = i
            n += self[piece[start:]] if start else self._survivors(raw)
        self[piece] = n
        return n

    def _survivors(self, raw: bytes) -> int:
        ranks, n = self.ranks, len(raw)
        if n < 2:
            return n
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(raw[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop or not end[i]:
                continue  # one of the two symbols has changed since
            after[i], end[i], end[j] = after[j], stop, 0
            alive -= 1
            if (k := after[j]) < n:
                before[k] = i
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(raw[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return alive

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pieces(text))) if text else 0

    def weighted(self, counts: Counter) -> int:
        return sum(self[p] * n for p, n in counts.items())


@lru_cache(maxsize=4)
def memo(path: str) -> Memo:
    """One memo a worker and vocabulary."""
    with open(path, "rb") as f:
        return Memo({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})
