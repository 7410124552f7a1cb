"""Broken request and response pairs (problem 4).

Method: the clauses of each response are tagged as answer, refusal, echo, foreign or
unfinished by a conditional random field; what each tag covers decides the defect.

The data has no labels, so the field is fitted on rows whose tags are known by how they
were made. Every successful row gives some, whatever its length: its answer if it gives all
that was asked, the same cut off anywhere, its request given back whole, in part or changed,
its answer under a request of the other language or with letters exchanged, and a refusal
(its own, if it holds a phrase of ``SEEDS`` and no score, or one of ``DECLINES``). Which
places, changes and wordings are drawn by a hash of the row. No feature is a list of phrases
or of words of a language: the field sees layout, what of the request is given or missing,
how much of a clause stands in the request, how likely its letters are by the n-grams of all
requests in the language of the instructions and by those of all whole answers, and hashed
words. Words that labelled a refusal are left out of its features in about every other copy.

Scale: the rows are read four times to fit (see ``fit``) and once to judge. N-grams and
words are summed by a shuffle, of which 131,072 n-grams and the words of at least one row in
``KNOWN_ROWS`` reach the driver. Equal sequences of features are counted by a shuffle and
fitted once; each of the ``FIT_STEPS`` steps is a job over them, of which each task gives
the driver 180 kB. The weights and n-gram tables are 2 MB.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import DOMAINS
from siftloom.session import checkpointed

from .crf import Chunk, Crf, Part, flat_chunk, weight

#: Responses of more clauses are fitted in pieces of so many.
PIECE_CLAUSES = 20
#: A word is known if it stands in the requests or in the answers of one row of so many, at least.
KNOWN_ROWS = 4000
#: Sequences fitted at a time, and steps of the fit, each over all of them.
CHUNK, FIT_STEPS = 20_000, 60
#: Part of the answers, by language and by what is asked, with the least likely letters: not learned as answers, as they may be foreign.
TRIMMED = 0.05
LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECTS = "request_id bigint, defect string"

# Stand-ins for "no value", without marks and blanks.
NO_VALUE = {"", "none", "null", "nil", "na", "nan", "empty", "undefined", "noresponse", "noanswer", "novalue", "noreply", "无", "空", "暂无", "没有", "无回复", "无回答", "无响应"}
# Phrases by which a row without a score is taken as a refusal for training.
SEEDS = re.compile(r"\b(?:can(?:no|')t|cannot|unable|not able|decline|refuse|not possible)\b|无法|拒绝|没有办法|不能提供", re.I)
# Refusals that are trained on beside those of the table, each opening with each body.
DECLINES = {
    False: (["", "Sorry, ", "I apologize. ", "Unfortunately, ", "As an assistant, ", "Thanks for asking, but "],
            ["I can't give a score to this text.", "I won't evaluate this document.", "I must refuse to rate the passage.", "it is not something I am able to judge.", "I prefer not to assess it.",
             "you should ask a human expert for that rating.", "this request is beyond what I do.", "that is against the rules I follow.", "giving marks here might cause harm."]),
    True: (["", "抱歉，", "对不起，", "很遗憾，", "作为人工智能助手，", "谢谢提问，但是"],
           ["我不能给这篇文本打分。", "我无法评价这份内容。", "恕我不能完成评分。", "这个请求超出了我的能力。", "我不便作出判断。", "请另找专业人员评估。", "这违反了我遵守的规则。"]),
}
_SCORE = re.compile(r"(?<![\d.])\d(?:\.\d+)?\s*/\s*5(?!\d)|\bN/A\b|不适用", re.I)
_ITEM = re.compile(r"(?:\[\s*(\d{1,2})\s*\]|\n\W*(\d{1,2})\s*[.)、．])[^\n]*?((?<![\d.])\d(?:\.\d+)?\s*/\s*5(?!\d)|\bN/A\b|不适用)", re.I)
_LETTER = re.compile(r"[:：]\W*(?:\[\s*([A-O])\s*\]|([A-O])(?=[ \t]*(?:$|\n|[)*|.,，。(（-])))\s*([^\n|*]*)")
_BRACKETED = re.compile(r"\[[A-O]\]")
_CLAUSE = re.compile(r"[^\n.!?。！？；;]*(?:[.](?=\d)[^\n.!?。！？；;]*)*[\n.!?。！？；;]*")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[㐀-䶿一-鿿]")
_MARKS = re.compile(r"[\W_]+")
_WIDE = re.compile("[／０-９]")
_FULL = {ord(a): b for a, b in zip("／０１２３４５６７８９", "/0123456789")}
_NAMES = {k: tuple(n.lower() for n in both) for k, both in DOMAINS.items()}


_ASCII = bytes(range(128))
_ASCII_MARKS = bytes(c for c in _ASCII if not chr(c).isalnum())
_ASCII_LOWER = bytes.maketrans(_ASCII, _ASCII.lower())
_ASCII_WORDS = bytes.maketrans(_ASCII, bytes(c if chr(c).isalpha() else 32 for c in _ASCII.lower()))


def plain(text: str) -> str:
    """Lower case, letters and digits only."""
    if text.isascii():
        return text.encode().translate(_ASCII_LOWER, _ASCII_MARKS).decode()
    return _MARKS.sub("", text).lower()


def _words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    if text.isascii():
        return text.encode().translate(_ASCII_WORDS).decode().split()
    return [w.lower() for w in _WORD.findall(text)]


class Request:
    """What a request asks for, the language of its instructions, its text and its whole content."""

    def __init__(self, content: str | None):
        content = content or ""
        head, _, body = content.partition("\nText:") if "\nText:" in content else content.partition("\n文本：")
        tails = [body.rfind(mark) for mark in ("\nDomain Types:", "\n领域类型：", "\nOverall Score:", "\n总评分:", "\n总评分：")]
        tail = body[max(0, *tails) :] if max(tails) >= 0 else body[-200:]
        if (list_ := max(body.rfind("\nDomain Types:"), body.rfind("\n领域类型："))) >= 0 and body.count("_/5", list_) >= 2:
            tail = body[list_:]
        self.chinese = bool(_HAN.search(head or content[:80]))
        self.n_scores = 14 if tail.count("_/5") >= 2 else int(bool(re.search(r"_/5\s*$", tail)))
        self.domain = self.n_scores == 14 or bool(re.search(r"(?:Domain|领域)\s*[:：]\s*_\s*$", tail))
        self.content, self.text, self.asks = content, body[: len(body) - len(tail)].strip(), head + "\n" + tail
        self._windows: dict[int, np.ndarray] = {}

    def windows(self, n: int) -> np.ndarray:
        """Sorted hashes of the runs of ``n`` letters or digits of the content."""
        if n not in self._windows:
            self._windows[n] = np.sort(_windows(plain(self.content), n))
        return self._windows[n]

    def turned(self) -> Request:
        """A request of the other language that asks for the same, without a text."""
        out = Request(None)
        out.chinese, out.n_scores, out.domain = not self.chinese, self.n_scores, self.domain
        return out


def _domain(text: str) -> list[re.Match]:
    """Domain letters named in a text; a line that lists several names none."""
    found = []
    for m in _LETTER.finditer(text):
        end = text.find("\n", m.start(3))
        if len(_BRACKETED.findall(text, m.start(), end if end >= 0 else len(text))) <= 2:
            found.append(m)
    return found


def _may_score(text: str) -> bool:
    """False only where neither ``_SCORE`` nor ``_ITEM`` can match. ``_ITEM`` is for texts with a line feed put before them."""
    return "/" in text or "不适用" in text


def given(response: str, asked: Request) -> float:
    """Part of the ratings asked for that are given: 1 if all are, 0 if none."""
    return _given(response, asked.n_scores, asked.domain)


@lru_cache(maxsize=5000)
def _given(response: str, n_scores: int, asks_domain: bool) -> float:
    scores = domain = 0
    if n_scores and _may_score(response):
        scores = len({int(m[1] or m[2]) for m in _ITEM.finditer("\n" + response)} & set(range(1, 15))) if n_scores == 14 else int(bool(_SCORE.search(response)))
    end = len(response.rstrip())
    for m in _domain(response) if asks_domain else ():
        name = m[3].strip(" ]）)。.\"'`*").lower()
        # A name that breaks off inside is not given.
        if not (name and m.end() >= end and any(x.startswith(name) and x != name for x in _NAMES[m[1] or m[2]])):
            domain = 1
    wanted = n_scores + asks_domain
    return (scores + domain) / wanted if wanted else 1.0


# ---- letters ----------------------------------------------------------------------------------------------------

_BUCKETS = 16
_SCRIPTS = ["latin", "han", "other"]


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane its lower case where it is a letter (else 0), and its script as a number (0 for none)."""
    low, script = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low[c] = ord(x) if len(x := s.lower()) == 1 else c
            script[c] = 2 if _HAN.match(s) or 0xF900 <= c < 0xFB00 else 1 if c < 0x250 or 0x1E00 <= c < 0x1F00 else 3
    return low, script


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if codes.max() < 1 << 16:
        return codes.astype(np.int64)
    return np.where(codes < 1 << 16, codes, np.where((codes >= 0x20000) & (codes < 0x32400), 0x4E00, 0)).astype(np.int64)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram around each code point: pairs of Chinese characters, else triples of letters and blanks; script of each code point)."""
    low, script = _letters()
    codes = _codes(text)
    k, c = script[codes], np.concatenate([[0], low[codes], [0]]).astype(np.uint32)
    c = np.where(c == 0, np.uint32(32), c)
    pair = c[1:-1] * np.uint32(0x9E3779B1) + c[2:] * np.uint32(0x85EBCA77)
    key = np.where(k == 2, pair, pair + c[:-2] * np.uint32(0xC2B2AE3D))
    return ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - _BUCKETS), k


class Letters:
    """How likely the letters of a text are, in bits a letter, by counted n-grams."""

    def __init__(self, counts: np.ndarray):
        self.bits = -np.log2((counts + 0.05) / (counts.sum() + 0.05 * len(counts))).astype(np.float32)


# ---- features ---------------------------------------------------------------------------------------------------

_PLAIN_FEATURES = [
    "bias", "first", "last", "only", "score", "letter", "index", "colon", "stop", "dots", "short", "long", "all", "some", "none", "last_all", "last_missing", "cut", "score_all", "score_missing", "before_score",
    "prose_missing", "prose_none", "echo_0", "echo_1", "echo_2", "echo_3", "echo_prose", "much_echo", "no_letters",
]
_BINS = 14
_BINNED = ["own", "own_long", "answer", "answer_missing", "whole_own", "whole_answer_missing", "unknown", "whole_unknown", "strange", "whole_strange"]
_WORDS = 4096
_AT = {f: i for i, f in enumerate(_PLAIN_FEATURES)}
_BIN_AT = {f: len(_AT) + 2 * i * _BINS for i, f in enumerate(_BINNED)}
_WORD_AT = len(_AT) + 2 * len(_BINNED) * _BINS
N_FEATURES = _WORD_AT + _WORDS
_ALONE = [_AT[f] for f in ("bias", "score", "letter", "index", "colon", "stop", "dots", "short", "long")]
_STOPS = ".!?。！？"
_ECHO = [_AT[f"echo_{level}"] for level in range(4)]
#: Features of a step that come together again in many: of its clause and place, of its words, of the whole response.
_GROUPS = np.zeros(N_FEATURES, np.int8)
_GROUPS[_WORD_AT:] = 1
for _name in ("whole_own", "whole_strange", "whole_unknown", "whole_answer_missing"):
    _GROUPS[_BIN_AT[_name] : _BIN_AT[_name] + 2 * _BINS] = 2
_GROUPS[[_AT[_name] for _name in ("all", "some", "none", "much_echo")]] = 2


def _word_features(words: list[str]) -> list[int]:
    """Hashed words, and of Chinese ones pairs of characters."""
    if not all(map(str.isascii, words)):
        words = [w for word in words for w in ([word[i : i + 2] for i in range(len(word) - 1)] if _HAN.match(word) else [word])]
    return sorted(set(map(_word_feature, words)))


@lru_cache(maxsize=100_000)
def _word_feature(word: str) -> int:
    return _WORD_AT + _fold(word) % _WORDS


@lru_cache(maxsize=100_000)
def _fold(s: str) -> int:
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h ^ (h >> 13)


class Clause:
    """What a clause shows by itself under requests of one language; ``base`` are the features that it has wherever it stands."""

    __slots__ = ("text", "base", "missing", "score", "named", "cut", "letters", "size", "sums", "_words")

    def __init__(self, c: str, known: frozenset[int]):
        scores, end = _may_score(c), c.rstrip()
        self.text, self.letters, self.score, self.named = c, plain(c), scores and bool(_SCORE.search(c)), bool(_domain(c))
        self.size, bare = max(1, len(self.letters)), len(self.letters)
        self.cut = not self.score and not self.named and end[-1:].isalnum()
        found = (True, self.score, self.named, scores and bool(_ITEM.search("\n" + c)), ":" in c or "：" in c, end[-1:] in _STOPS, end.endswith(("...", "…")), bare < 8, bare > 60)
        self.base = list(compress(_ALONE, found))
        said = _words(c)
        latin = [w for w in said if len(w) > 1] if c.isascii() else [w for w in said if len(w) > 1 and not _HAN.match(w)]
        # Bits of the letters by both models, letters, those of another script, words, unknown ones: the first four follow.
        self.sums, self._words = (0, 0, 0, 0, len(latin), len(latin) - sum(map(known.__contains__, map(_fold, latin)))), None

    def weigh(self, sums: tuple[int, ...], levels: tuple[int, ...], side: int) -> None:
        """Adds the sums and their bins."""
        own, like, odd, unknown = levels
        self.sums = sums
        self.missing = _BIN_AT["answer_missing"] + side + like
        self.base += [_BIN_AT["own"] + side + own, _BIN_AT["answer"] + side + like, _BIN_AT["strange"] + side + odd] if sums[2] else [_AT["no_letters"]]
        if sums[4]:
            self.base.append(_BIN_AT["unknown"] + side + unknown)
        if sums[2] > 20:
            self.base.append(_BIN_AT["own_long"] + side + own)
        self.base = tuple(self.base)

    @property
    def words(self) -> tuple[int, ...]:
        if self._words is None:
            self._words = tuple(_word_features(_words(self.text)))
        return self._words


def _levels(sums: np.ndarray) -> list[tuple[int, ...]]:
    """Of each row of sums, bins of the bits a letter by both models, of the share of letters of another script, and of unknown words."""
    own, like, n, odd, words, unknown = sums.T
    most = np.maximum(n, 1)
    bins = (own / (1024 * most) - 6, like / (1024 * most) - 6, 13 * odd / most, 13 * unknown / np.maximum(words, 1))
    return list(zip(*(np.minimum(np.maximum(x, 0), _BINS - 1).astype(np.int64).tolist() for x in bins)))


_POWER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of ``_POWER``, and of its inverse."""
    of = lambda x: np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << bits) - 1, x, np.uint64)))
    return of(_POWER), of(pow(_POWER, -1, 1 << 64))


def _windows(text: str, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` code points of a text."""
    if len(text) < n:
        return np.zeros(0, np.uint64)
    a = _codes(text).astype(np.uint64)
    up, down = _powers(max(12, len(a).bit_length()))
    a *= up[: len(a)]
    sums = a.cumsum()
    x = sums[n - 1 :].copy()
    x[1:] -= sums[:-n]
    x *= down[: len(x)]
    return x


def _covered(parts: list[str], asked: Request, n: int) -> list[int]:
    """Of each part of a plain response, how many letters or digits lie in a run of ``n`` that stands in the request too."""
    y = asked.windows(n)
    x = _windows("".join(parts), n) if len(y) else y
    at = (y.take(y.searchsorted(x), mode="clip") == x).nonzero()[0] if len(x) else x
    if not len(at):
        return [0] * len(parts)
    inside = np.zeros(len(x) + n + 1, np.int64)
    inside[at + 1] += 1
    inside[at + n + 1] -= 1
    ends = (inside.cumsum() > 0).cumsum()[[0, *accumulate(map(len, parts))]].tolist()
    return [b - a for a, b in zip(ends, ends[1:])]


class Reader:
    """Turns a response into the features of its clauses. Built from counts over all requests and answers."""

    def __init__(self, own: dict[bool, Letters], answers: dict[bool, Letters], words: frozenset[int]):
        self.words = words
        self._own, self._like = (np.round(1024 * np.concatenate([x[False].bits, x[True].bits])).astype(np.int64) for x in (own, answers))
        self._seen: dict[bool, dict[str, Clause]] = {False: {}, True: {}}

    def _clauses(self, rows: list[tuple[str, Request, float]]) -> list[list[Clause]]:
        """The clauses of each response; those that come again are kept.

        A clause ends with a mark or with the response, so the n-grams of its letters are the same wherever it stands.
        """
        split = [[c for c in _CLAUSE.findall(r) if c and not c.isspace()] for r, _, _ in rows]
        for zh, known in self._seen.items():
            if len(known) >= 50_000:
                known.clear()
            new = list({c: None for some, (_, q, _) in zip(split, rows) if q.chinese == zh for c in some if c not in known})
            if not new:
                continue
            grams, script = _grams("\n".join(new))
            letter, side = script > 0, int(zh) << _BUCKETS
            begin = np.cumsum([0, *(len(c) + 1 for c in new)])[:-1]
            per = lambda x: np.add.reduceat(x, begin, dtype=np.int64).tolist()
            own, like = (per(np.where(letter, bits[side:][grams], 0)) for bits in (self._own, self._like))
            clauses = [Clause(c, self.words) for c in new]
            sums = [(*found, *c.sums[4:]) for c, *found in zip(clauses, own, like, per(letter), per(letter & (script != (2 if zh else 1))))]
            for c, mine, levels in zip(clauses, sums, _levels(np.array(sums))):
                c.weigh(mine, levels, int(zh) * _BINS)
            known.update(zip(new, clauses))
        return [[self._seen[q.chinese][c] for c in some] for some, (_, q, _) in zip(split, rows)]

    def features(self, rows: list[tuple[str, Request, float]]) -> list[tuple[list[list[int]], list[int]]]:
        """Of each (response, request, part given): features of each clause, letters and digits of each."""
        if not rows:
            return []
        read = self._clauses(rows)
        begin = np.cumsum([0, *(len(some) + 1 for some in read)])[:-1]
        none = (0,) * 6
        whole = np.add.reduceat(np.array([x for some in read for x in (none, *(c.sums for c in some))]), begin)
        return [self._features(*row, *more) for row, *more in zip(rows, read, _levels(whole))]

    def _features(self, response: str, asked: Request, part: float, clauses: list[Clause], levels: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
        # Bins of Chinese requests are features of their own: pairs of characters are rarer than triples of letters.
        missing, side, sizes = part < 1, asked.chinese * _BINS, [c.size for c in clauses]
        own, like, odd, unknown = levels
        whole = [_BIN_AT["whole_own"] + side + own, _BIN_AT["whole_strange"] + side + odd, _BIN_AT["whole_unknown"] + side + unknown, _AT["all" if part >= 1 else "some" if part > 0 else "none"]]
        echo: list[float] = []
        if missing:
            whole.append(_BIN_AT["whole_answer_missing"] + side + like)
            held = _covered([c.letters for c in clauses], asked, 8 if asked.chinese or not response.isascii() and _HAN.search(response) else 15)
            echo = [h / len(c.letters) if h else 0.0 for h, c in zip(held, clauses)]
            if sum(e * s for e, s in zip(echo, sizes)) >= 0.75 * sum(sizes):
                whole.append(_AT["much_echo"])
        found, later, last = [], False, len(clauses) - 1
        of_score = _AT["score_missing" if missing else "score_all"]
        for i in range(last, -1, -1):
            c, more = clauses[i], []
            if i == 0:
                more.append(_AT["first"])
            if i == last:
                more += [_AT["last"], _AT["last_missing" if missing else "last_all"]]
                if c.cut:
                    more.append(_AT["cut"])
                if i == 0:
                    more.append(_AT["only"])
            if c.score:
                more.append(of_score)
            if later:
                more.append(_AT["before_score"])
            if missing:
                e = echo[i]
                level = 0 if e < 0.2 else 1 if e < 0.5 else 2 if e < 0.9 else 3
                more += [_ECHO[level], c.missing]
                if not c.score and not c.named:
                    more.append(_AT["prose_missing"])
                    if part == 0:
                        more.append(_AT["prose_none"])
                    if level >= 2:
                        more.append(_AT["echo_prose"])
                    more += c.words
            found.append([*c.base, *more, *whole])
            later = later or c.score
        return found[::-1], sizes


def prepared(response: str | None) -> str | None:
    """The response in half-width digits; none for an empty one."""
    if response is None or plain(response) in NO_VALUE:
        return None
    return response.translate(_FULL) if not response.isascii() and _WIDE.search(response) else response


def decide(tags: np.ndarray, sizes: list[int]) -> str | None:
    """The defect of a pair from what its tags cover."""
    cover = np.bincount(tags, sizes, len(LABELS))
    whole = sum(sizes)
    # An echo says nothing about the language of the answer itself.
    if cover[FOREIGN] >= 0.5 * (whole - cover[ECHO]) and cover[FOREIGN] > 0 and cover[ECHO] < 0.5 * whole:
        return "other_language"
    if cover[REFUSAL] > 0 and cover[REFUSAL] >= cover[ECHO] / 4 and cover[REFUSAL] >= 0.2 * (whole - cover[ECHO]):
        return "refusal"
    if cover[ECHO] >= 0.5 * whole:
        return "copies_question"
    return "truncated" if cover[UNFINISHED] > 0 else None


# ---- fitting ----------------------------------------------------------------------------------------------------


def _exchanged(text: str, rng: np.random.Generator) -> str:
    """The Latin letters of a text exchanged, vowels among vowels, by one draw, or moved to another script."""
    if rng.random() < 0.25:
        first = int(rng.choice([0x3B1, 0x430, 0x5D0, 0x627, 0xAC00, 0x3042, 0x905]))
        return text.translate({a + i: first + i for a in (65, 97) for i in range(26)})
    table, rate = {}, rng.uniform(0.4, 1.0)
    for group in ("aeiou", "bcdfghjklmnpqrstvwxyz"):
        some = [c for c in group if rng.random() < rate]
        table |= dict(zip(some, rng.permutation(some)))
    table |= {a.upper(): b.upper() for a, b in table.items()}
    return text.translate(str.maketrans(table))


def _given_back(asked: Request, rng: np.random.Generator) -> str:
    """A request or its text, whole, from its beginning, or with words dropped and exchanged."""
    text = asked.content if rng.random() < 0.3 or not asked.text else asked.text
    if rng.random() < 0.5:
        text = text[: max(20, int(len(text) * rng.uniform(0.3, 1.0)))]
    if rng.random() < 0.4:
        words = re.split(r"(\s+)", text) if not _HAN.search(text) else list(text)
        rate = rng.uniform(0.01, 0.08)
        text = "".join(words[rng.integers(len(words))] if rng.random() < rate else w for w in words)
    return text.lower() if rng.random() < 0.2 else text


Rows = list[tuple[str, Request]]


def _kind(q: Request) -> int:
    return 4 * q.n_scores + 2 * q.domain + q.chinese


class Counts:
    """Numbers by key, summed over rows: n-grams of both languages below ``WORD``, rows that hold a word from there on."""

    WORD = 1 << (_BUCKETS + 1)

    def __init__(self):
        self._grams, self._words = np.zeros(self.WORD, np.int64), Counter()

    def add(self, texts: dict[bool, list[str]], words: list[set[str]]) -> None:
        for zh, some in texts.items():
            at, k = _grams("\n".join(some))
            self._grams[int(zh) << _BUCKETS :][: 1 << _BUCKETS] += np.bincount(at[k > 0], minlength=1 << _BUCKETS)
        for w in words:
            self._words.update(w)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, numbers) counted since the last call."""
        at, words = np.flatnonzero(self._grams), self._words
        out = np.append(at, np.array([self.WORD + _fold(w) for w in words], np.int64)), np.append(self._grams[at], np.array(list(words.values()), np.int64))
        self.__init__()
        return out

    @property
    def large(self) -> bool:
        return len(self._words) > 500_000


def _words_of(texts: list[str]) -> set[str]:
    return set(_words("\n".join(texts)))


def count_requests(rows: Rows, into: Counts) -> None:
    """Lines of the requests that are in the language of the instructions."""
    lines = [[x for x in (q.asks + "\n" + q.text).split("\n") if (not x.isascii() and bool(_HAN.search(x))) == q.chinese] for _, q in rows]
    into.add({zh: [x for some, (_, q) in zip(lines, rows) if q.chinese == zh for x in some] for zh in (False, True)}, [_words_of(some) for some, (_, q) in zip(lines, rows) if not q.chinese])


class Judge:
    """Which answers are learned as such: complete ones whose letters are not among the least likely."""

    def __init__(self, own: dict[bool, Letters]):
        self.own, self.most = own, {}

    def bits(self, rows: Rows) -> list[int]:
        """Of each row its bits a letter in thousandths; -1 where the answer isn't complete."""
        out, at = [-1] * len(rows), [i for i, (r, q) in enumerate(rows) if given(r, q) >= 1]
        grams, script = _grams("\n".join(rows[i][0] for i in at))
        letter, end = script > 0, -1
        for i in at:
            r, q = rows[i]
            here = slice(end + 1, end := end + 1 + len(r))
            bits = self.own[q.chinese].bits[grams[here][letter[here]]]
            out[i] = round(1000 * float(bits.mean())) if len(bits) else 0
        return out

    def count(self, rows: Rows) -> Counter:
        return Counter((_kind(q) << 20) + x for x, (_, q) in zip(self.bits(rows), rows) if x >= 0)

    def trim(self, counts: dict[int, int]) -> Judge:
        """Sets the bits up to which answers are kept, from the numbers of all rows."""
        for kind in {k >> 20 for k in counts}:
            side = sorted((k & 0xFFFFF, n) for k, n in counts.items() if k >> 20 == kind)
            left = (n := sum(n for _, n in side)) - int(-(-n * TRIMMED // 1))
            for x, n in side:
                if left > 0:
                    self.most[kind] = x
                left -= n
        return self

    def kept(self, rows: Rows) -> list[bool]:
        return [0 <= x <= self.most.get(_kind(q), -1) for x, (_, q) in zip(self.bits(rows), rows)]


def count_answers(rows: Rows, judge: Judge, into: Counts) -> None:
    kept = [row for row, yes in zip(rows, judge.kept(rows)) if yes]
    into.add({zh: [r for r, q in kept if q.chinese == zh] for zh in (False, True)}, [_words_of([r]) for r, q in kept if not q.chinese])


def _letters_of(keys: np.ndarray, n: np.ndarray) -> dict[bool, Letters]:
    every = np.zeros(Counts.WORD, np.int64)
    grams = keys < Counts.WORD
    every[keys[grams]] = n[grams]
    return {zh: Letters(every[int(zh) << _BUCKETS :][: 1 << _BUCKETS]) for zh in (False, True)}


@lru_cache(maxsize=1)
def _cues() -> frozenset[int]:
    """Features of the words by which the written refusals are told."""
    said = [" ".join(SEEDS.findall(s)) for side in DECLINES.values() for group in side for s in group]
    return frozenset(f for s in said for f in _word_features([w.lower() for w in _WORD.findall(s)]))


def _cut_labels(x: list, _: np.random.Generator) -> list[int]:
    return [ANSWER] * (len(x) - 1) + [UNFINISHED]


def _refusal_labels(x: list, rng: np.random.Generator) -> list[int]:
    y = [ANSWER if _AT["letter"] in f else ECHO if _AT["echo_2"] in f or _AT["echo_3"] in f else REFUSAL for f in x]
    if rng.random() < 0.5:  # the same without the words that labelled it, and without some others
        x[:] = [[f for f in s if f < _WORD_AT or (f not in _cues() and rng.random() < 0.5)] for s in x]
    return y


def _made(r: str, q: Request, kept: bool, rng: np.random.Generator) -> Iterator[tuple[str, Request, int | Callable]]:
    """(response, request, label or labelling) of the rows made from one row: its answer and every defect it can show."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    title = r.split("\n", 1)[0] if kept else ""
    if kept:
        yield r, q, ANSWER
        # The same answer with a quotation before it is an answer still.
        if q.text and rng.random() < 0.3:
            yield f'"{q.text[: int(rng.integers(20, 400))]}"\n{r}', q, ANSWER
        if rng.random() < 0.1:
            yield f'"{" ".join(pick(list(DOMAINS.values()))[not q.chinese] for _ in range(int(rng.integers(3, 9))))}"\n{r}', q, ANSWER
        # What breaks off after all was given leaves an answer.
        if rng.random() < 0.2:
            more = pick(q.asks.split("\n")) if rng.random() < 0.5 else r
            yield r + "\n" + more[: int(rng.integers(5, 40))].rstrip() + pick(["", "…", "..."]), q, ANSWER
        if rng.random() < 0.1:
            yield pick(DECLINES[q.chinese][1]) + "\n" + r, q, ANSWER
        # Short answers are cut at several places, as so little of them is left.
        stops = [m.start() for m in re.finditer(r"\n|(?<=[.。|])", r[:-1])]
        for _ in range(4 if len(r) < 60 else 1):
            at = pick(stops) if stops and rng.random() < 0.3 else stops[-1] if stops and rng.random() < 0.1 else int(rng.integers(1, max(2, len(r))))
            cut = r[:at].rstrip() + ("…" if rng.random() < 0.1 else "")
            if given(cut, q) < 1:
                yield cut, q, _cut_labels
        # Under a request of the other language, or with letters exchanged.
        if rng.random() < 0.5:
            yield r, q.turned(), FOREIGN
        elif not q.chinese:
            for _ in range(3 if len(r) < 60 else 1):
                yield _exchanged(r, rng), q if rng.random() < 0.6 else q.turned(), FOREIGN
    back = _given_back(q, rng)
    if given(back, q) == 0:
        yield pick(["", "", "Text: ", "Here is the text:\n\n", "文本：", "以下是原文：\n"]) + back, q, ECHO
    said = [pick(DECLINES[q.chinese][0]) + pick(DECLINES[q.chinese][1])] if rng.random() < 0.5 else []
    if SEEDS.search(r) and not _SCORE.search(r) and given(r, q) < 0.2:
        said.append(r)
    for x in said * 2:
        if not _domain(x) and rng.random() < 0.3:
            letter = pick(list(DOMAINS))
            x = (title if _domain(title) else f"{'领域类型：' if q.chinese else 'Domain Type: '}[{letter}]{DOMAINS[letter][q.chinese]}") + "\n" + x
        if q.text and rng.random() < 0.3:
            x += pick(["\n", " "]) + pick(["(", "（", '"', "Text: "]) + q.text[: int(rng.integers(15, 80))] + pick([")", "）", '"', ""])
        yield x, q, _refusal_labels


def training(rows: Rows, judge: Judge, reader: Reader, seed: int = 5) -> Iterator[tuple[list, list]]:
    """(features, labels) of the rows made from each row. They depend on the row alone, not on its neighbours."""
    todo: list = []
    for (r, q), kept in zip(rows, judge.kept(rows)):
        rng = np.random.Generator(np.random.PCG64([seed, crc32(r.encode("utf-8", "surrogatepass")), crc32(q.content.encode("utf-8", "surrogatepass"))]))
        for response, asked, label in _made(r, q, kept, rng):
            if (response := prepared(response)) is not None:
                todo.append((response, asked, label, rng))
    for first in range(0, len(todo), 500):
        some = todo[first : first + 500]
        for (x, _), (*_, label, rng) in zip(reader.features([(r, q, given(r, q)) for r, q, *_ in some]), some):
            y = label(x, rng) if callable(label) else [label] * len(x)
            for k in range(0, len(x), PIECE_CLAUSES):
                yield x[k : k + PIECE_CLAUSES], y[k : k + PIECE_CLAUSES]


class Field:
    """The fitted field with its reader."""

    def __init__(self, reader: Reader, crf: Crf):
        self.reader, self.crf = reader, crf

    def judge(self, responses: list[str | None], contents: list[str | None]) -> list[tuple[np.ndarray, list[int], float] | None]:
        """(tags, sizes, part given) of each response; none for an empty one."""
        out: list = [None] * len(responses)
        rows, at = [], []
        for i, (r, c) in enumerate(zip(responses, contents)):
            if (r := prepared(r)) is not None:
                asked = Request(c)
                rows.append((r, asked, given(r, asked)))
                at.append(i)
        read = self.reader.features(rows)
        for i, (_, asked, part), (_, sizes), tags in zip(at, rows, read, self.crf.tag([x for x, _ in read])):
            # Where nothing is asked, nothing can be missing.
            out[i] = (tags if asked.n_scores or asked.domain else np.zeros_like(tags), sizes, part)
        return out


def _ready(rows: Iterable[tuple[str | None, str | None]]) -> Rows:
    return [(r, Request(c)) for response, c in rows if (r := prepared(response)) is not None]


def _reader(own: dict[bool, Letters], requests: tuple[np.ndarray, np.ndarray], answers: tuple[np.ndarray, np.ndarray], n_rows: int) -> Reader:
    least = max(1, -(-n_rows // KNOWN_ROWS))
    words = [k[(k >= Counts.WORD) & (n >= least)] - Counts.WORD for k, n in (requests, answers)]
    return Reader(own, _letters_of(*answers), frozenset(np.concatenate(words).tolist()))


def fit_rows(rows: list[tuple[str | None, str | None]], seed: int = 5) -> Field:
    """A field fitted on (response, request) rows in memory, as ``fit`` does it on a table."""
    ready, counts = _ready(rows), Counts()
    count_requests(ready, counts)
    requests = counts.flush()
    judge = Judge(_letters_of(*requests))
    judge.trim(judge.count(ready))
    count_answers(ready, judge, counts)
    reader = _reader(judge.own, requests, counts.flush(), len(rows))
    made = list(training(ready, judge, reader, seed)) if judge.most else []
    for seen in reader._seen.values():
        seen.clear()
    return Field(reader, Crf(N_FEATURES, len(LABELS)).fit([x for x, _ in made], [y for _, y in made], FIT_STEPS))


def user_content(request: Column) -> Column:
    """Content of the last message of role ``user`` in a request struct; null if there is none."""
    return F.try_element_at(F.filter(request["messages"], lambda m: m["role"] == "user"), F.lit(-1))["content"]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for b in batches:
        for first in range(0, b.num_rows, 1000):
            yield _ready(zip(*(b.column(c)[first : first + 1000].to_pylist() for c in ("gpt_response", "content"))))


def _sums(rows: DataFrame, count: Callable[[Iterator[Rows]], Iterator[tuple]], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers) that ``count`` gives for parts of the rows, summed; words of fewer than ``least`` rows left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in count(_batches(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    found = rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("key") < Counts.WORD) | (F.col("n") >= least)).toArrow()
    return tuple(found.column(c).to_numpy() for c in ("key", "n"))


def _counted(add: Callable[[Rows, Counts], None]) -> Callable[[Iterator[Rows]], Iterator[tuple]]:
    def count(parts: Iterator[Rows]) -> Iterator[tuple]:
        counts = Counts()
        for rows in parts:
            add(rows, counts)
            if counts.large:
                yield counts.flush()
        yield counts.flush()

    return count


def _packed(x: list, y: list) -> bytes:
    return np.array(array("H", [len(x), *map(len, x), *y, *chain.from_iterable(x)]), "<u2").tobytes()


def _unpacked(key: bytes) -> tuple[list, list]:
    v = np.frombuffer(key, "<u2").tolist()
    n, x, at = v[0], [], 1 + 2 * v[0]
    for size in v[1 : 1 + n]:
        x.append(v[at : at + size])
        at += size
    return x, v[1 + n : 1 + 2 * n]


def _stored(c: Chunk) -> bytes:
    return pickle.dumps((list(map(tuple, c.parts)), *c[1:]))


def _loaded(data: bytes) -> Chunk:
    parts, *rest = pickle.loads(data)
    return Chunk([Part(*p) for p in parts], *rest)


def _flat_of(keys: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of packed sequences, one after another: steps of each, features and label of each step, the features."""
    v = np.frombuffer(b"".join(keys), "<u2").astype(np.int64)
    begin = np.cumsum([0, *map(len, keys)])[:-1] // 2
    lengths = v[begin]
    within = np.arange(int(lengths.sum())) + np.repeat(begin + 1 - (np.cumsum(lengths) - lengths), lengths)
    labels = within + np.repeat(lengths, lengths)
    features = np.ones(len(v), bool)
    for head in (begin, within, labels):
        features[head] = False
    return lengths, v[within], v[labels], v[features]


def _chunks(rows: DataFrame, judge: Judge, reader: Reader) -> DataFrame:
    """The rows made from all rows, as a table of pickled chunks; equal sequences are one."""
    shared = rows.sparkSession.sparkContext.broadcast((judge, reader))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            keys = [_packed(x, y) for x, y in training(part, *shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(keys: list[bytes], times: list[int]) -> pa.RecordBatch:
            c = flat_chunk(*_flat_of(keys), np.array([weight(n) for n in times]), _GROUPS)
            return pa.RecordBatch.from_arrays([pa.array([_stored(c)], pa.binary())], names=["chunk"])

        keys, times = [], []
        for b in batches:
            keys += b.column("key").to_pylist()
            times += b.column("n").to_pylist()
            while len(keys) >= CHUNK:
                yield whole(keys[:CHUNK], times[:CHUNK])
                del keys[:CHUNK], times[:CHUNK]
        if keys:
            yield whole(keys, times)

    each = rows.mapInArrow(make, "key binary").groupBy("key").agg(F.count("*").alias("n"))
    return checkpointed(each.sortWithinPartitions("key").mapInArrow(pack, "chunk binary"))


def _slope(chunks: DataFrame) -> Callable[[Crf], np.ndarray]:
    def slope(crf: Crf) -> np.ndarray:
        shared = chunks.sparkSession.sparkContext.broadcast(crf)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = 0.0
            for b in batches:
                for c in b.column("chunk").to_pylist():
                    found = found + shared.value.slope(_loaded(c))
            if np.ndim(found):
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["slope"])

        found = chunks.mapInArrow(run, "slope binary").collect()
        shared.destroy()
        return np.sum([np.frombuffer(r.slope) for r in found], axis=0) if found else np.zeros(1)

    return slope


def fit(responses: DataFrame) -> Field:
    """A field fitted on all successful rows; the same rows give the same field, but for the rounding of sums.

    Reads the rows four times: n-grams and words of the requests, the letters of each
    complete answer, n-grams and words of the answers kept, and the rows made. Every
    step of the fit is one job over the chunks of these.
    """
    rows = responses.where("status = 'success' and gpt_response is not null").select("gpt_response", user_content(F.col("request_json")).alias("content"))
    n_rows = rows.count()
    least = max(1, -(-n_rows // KNOWN_ROWS))
    requests = _sums(rows, _counted(count_requests), least)
    judge = Judge(_letters_of(*requests))

    def letters(parts: Iterator[Rows]) -> Iterator[tuple]:
        for counts in map(judge.count, parts):
            yield list(counts), list(counts.values())

    judge.trim(dict(zip(*(x.tolist() for x in _sums(rows, letters)))))
    reader = _reader(judge.own, requests, _sums(rows, _counted(lambda part, into: count_answers(part, judge, into)), least), n_rows)
    crf = Crf(N_FEATURES, len(LABELS))
    return Field(reader, crf.climb(_slope(_chunks(rows, judge, reader)), FIT_STEPS) if judge.most else crf)


def _judged(responses: DataFrame, field: Field, schema: str, shape) -> DataFrame:
    shared = responses.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("request_id").to_pylist()
            for first in range(0, len(ids), 500):
                part = slice(first, first + 500)
                judged = shared.value.judge(b.column("gpt_response")[part].to_pylist(), b.column("content")[part].to_pylist())
                if (out := shape(ids[part], judged)) is not None:
                    yield out

    return responses.where("status = 'success'").select("request_id", "gpt_response", user_content(F.col("request_json")).alias("content")).mapInArrow(run, schema)


def defects(responses: DataFrame, field: Field | None = None) -> DataFrame:
    """``request_id, defect`` of each successful row whose response is no usable answer; one defect a row.

    ``responses`` has ``request_id BIGINT, request_json STRUCT<messages ARRAY<STRUCT<role,
    content>>, ...>, status, gpt_response``; other columns are ignored. A null or blank
    response, or a stand-in for no value, is ``empty``. Rows of another or null status are
    left out, repeated rows judged each time. Where a request asks for no rating, or there is
    none, whatever is not empty counts as answer. An empty table gives no row. Of a table without any complete
    answer nothing can be learned, and only ``empty`` is told.
    """

    def shape(ids, judged):
        found = [(i, "empty" if j is None else decide(j[0], j[1])) for i, j in zip(ids, judged)]
        found = [f for f in found if f[1]]
        if found:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string()))], names=["request_id", "defect"])

    return _judged(responses, field or fit(responses), DEFECTS, shape)


def coverage(responses: DataFrame, field: Field | None = None) -> DataFrame:
    """Share of each successful response that each tag covers: ``request_id, n_clauses, answer, refusal, echo, foreign, unfinished, complete``."""
    names = ["request_id", "n_clauses", *LABELS, "complete"]

    def shape(ids, judged):
        out = []
        for i, j in zip(ids, judged):
            tags, sizes, part = j if j else ([], [], 0.0)
            cover = np.bincount(tags, sizes, len(LABELS)) if len(tags) else np.zeros(len(LABELS))
            out.append((i, len(tags), *(cover / max(1.0, cover.sum())).tolist(), part >= 1))
        types = [pa.int64(), pa.int32(), *[pa.float64()] * 5, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names) if out else None

    schema = "request_id bigint, n_clauses int, " + ", ".join(f"{x} double" for x in LABELS) + ", complete boolean"
    return _judged(responses, field or fit(responses), schema, shape)
