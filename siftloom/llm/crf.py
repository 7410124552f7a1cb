"""A linear-chain conditional random field over a few labels, on sparse indicator features.

A sequence is a list of steps, a step the numbers of the features that hold there (at least one).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from typing import NamedTuple

import numpy as np

Sequence_ = list[list[int]]


def _flat(rows: list[Sequence_]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all steps one after another, and where each step begins."""
    steps = [s for r in rows for s in r]
    sizes = np.fromiter(map(len, steps), np.int64, len(steps))
    at = np.fromiter(chain.from_iterable(steps), np.int64, int(sizes.sum()))
    return at, np.cumsum(sizes) - sizes


class Part(NamedTuple):
    """What steps have of one group of features, equal ones once."""

    at: np.ndarray  # features of all distinct ones, one after another
    start: np.ndarray  # where each begins
    number: np.ndarray  # of each distinct step; one beyond the last for none


class Chunk(NamedTuple):
    """Labelled sequences, longest first, with their steps position by position; equal steps have one number."""

    parts: list[Part]
    steps: np.ndarray  # number of the distinct step at each place
    labels: np.ndarray
    weights: np.ndarray  # of each sequence
    active: np.ndarray  # sequences that have a first, second, ... step


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.int32)


def chunk(rows: list[Sequence_], labels: list[list[int]], weights: list[float], groups: np.ndarray | None = None) -> Chunk:
    """``rows``, none of them empty, as a chunk; ``groups`` as in ``flat_chunk``."""
    at, start = _flat(rows)
    return flat_chunk(np.array([len(r) for r in rows]), np.diff(np.append(start, len(at))), np.concatenate(labels), at, np.array(weights, np.float64), groups)


def flat_chunk(lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray, at: np.ndarray, weights: np.ndarray, groups: np.ndarray | None = None) -> Chunk:
    """Sequences one after another as a chunk: steps and weight of each, features and label of each step, the features.

    What is equal of the features of a group (``groups`` by feature) is summed once for all steps that have it.
    """
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    position = np.arange(len(sizes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    places = np.lexsort((np.repeat(rank, lengths), position))
    at, step = at.astype(np.int32), np.repeat(np.arange(len(sizes)), sizes)
    group = groups[at] if groups is not None else np.zeros(len(at), np.int8)
    parts, numbers, both = [], [], np.zeros(len(sizes), np.int64)
    for g in range(int(group.max()) + 1):
        here = group == g
        data, number = at[here].tobytes(), {}
        ends = (4 * np.cumsum(np.bincount(step[here], minlength=len(sizes)))).tolist()
        found = [number.setdefault(data[a:b], len(number)) if a < b else -1 for a, b in zip([0, *ends], ends)]
        begin = np.cumsum([0, *map(len, number)])[:-1] // 4
        parts.append((_small(np.frombuffer(b"".join(number), np.int32)), begin.astype(np.int32)))
        numbers.append(np.array(found) % (len(number) + 1))
        _, both = np.unique(both * (len(number) + 1) + numbers[-1], return_inverse=True)
    _, first = np.unique(both, return_index=True)
    return Chunk([Part(*p, _small(n[first])) for p, n in zip(parts, numbers)], both[places].astype(np.int32), labels[places].astype(np.int8), weights[order], np.bincount(position))


def weight(times: int) -> float:
    """Equal sequences count by the root of their number, so that the common ones don't drown the rest."""
    return float(np.sqrt(times))


class Crf:
    """Weights of features per label, of label pairs, and of the first label."""

    def __init__(self, n_features: int, n_labels: int):
        self.w = np.zeros((n_features, n_labels), np.float32)
        self.t = np.zeros((n_labels, n_labels))
        self.s = np.zeros(n_labels)

    def fit(self, rows: list[Sequence_], labels: list[list[int]], steps: int = 80) -> Crf:
        """``climb`` over sequences in memory. Equal ones are taken once, by ``weight`` of their number."""
        times: dict[tuple, list] = {}
        for i, (r, y) in enumerate(zip(rows, labels)):
            if len(r):
                times.setdefault((tuple(map(tuple, r)), tuple(y)), [i, 0])[1] += 1
        if not times:
            return self
        one = chunk([rows[i] for i, _ in times.values()], [labels[i] for i, _ in times.values()], [weight(n) for _, n in times.values()])
        return self.climb(lambda crf: crf.slope(one), steps)

    def slope(self, c: Chunk) -> np.ndarray:
        """What a chunk adds to the gradient of the likelihood, for features, pairs and first labels, and the sum of its weights."""
        n_features, k = self.w.shape
        # Labels are rows here, places columns. Only what the first label differs by matters, and slopes sum to 0 over the labels.
        w, steps = np.ascontiguousarray(self.w.T), c.steps.astype(np.int64)
        w, n_steps = w[1:] - w[0], len(c.parts[0].number)
        e, parts = np.zeros((k, n_steps)), [Part(p.at.astype(np.int64), p.start, p.number.astype(np.int64)) for p in c.parts]
        for at, start, number in parts:
            for x, mine in zip(e[1:], w):
                x += np.append(np.add.reduceat(mine[at], start) if len(at) else (), 0.0)[number]
        e, pair = np.exp(e - e.max(0)), np.exp(self.t - self.t.max())
        end = np.cumsum(c.active)
        here = [e.take(steps[z - m : z], 1) for z, m in zip(end, c.active)]
        # Forward and backward sums are scaled to 1 at each step, which the shares below don't see.
        a = [here[0] * np.exp(self.s - self.s.max())[:, None]]
        a[0] /= a[0].sum(0)
        for x, m in zip(here[1:], c.active[1:]):
            a.append((pair.T @ a[-1][:, :m]) * x)
            a[-1] /= a[-1].sum(0)
        left, both, b = np.empty((k, len(c.steps))), np.zeros((k, k)), np.ones_like(a[-1])
        for i in range(len(a) - 1, -1, -1):
            m, z = c.active[i], end[i]
            p = a[i] * b
            p *= c.weights[:m] / p.sum(0)
            y = c.labels[z - m : z]
            np.negative(p, out=left[:, z - m : z])
            left[y, np.arange(z - m, z)] += c.weights[:m]
            if i:
                v, before = here[i] * b, a[i - 1][:, :m]
                both -= pair * (before @ (v * (c.weights[:m] / ((pair.T @ before) * v).sum(0))).T)
                y0 = c.labels[z - m - c.active[i - 1] :][:m].astype(np.int64)
                both += np.bincount(y0 * k + y, c.weights[:m], k * k).reshape(k, k)
                b = np.ones_like(a[i - 1])
                back = pair @ v
                b[:, :m] = back / back.max(0)
        slopes, w = [np.bincount(steps, x, n_steps) for x in left[1:]], np.zeros((k, n_features))
        for at, start, number in parts:
            owner = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
            for sums, x in zip(w[1:], slopes):
                sums += np.bincount(at, np.bincount(number, x, len(start) + 1)[owner], n_features)
        w[0] = -w[1:].sum(0)
        return np.concatenate([w.T.ravel(), both.ravel(), left[:, : c.active[0]].sum(1), [c.weights.sum()]])

    def climb(self, slope: Callable[[Crf], np.ndarray], steps: int, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Maximum likelihood by full gradients with adaptive steps; ``slope`` sums those of all chunks under the weights it is given.

        Label pairs decay faster, so that a pair the rows happen to lack is not ruled out.
        """
        w = self.w.astype(np.float64)
        values = (w, self.t, self.s)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in values]
        for step in range(1, steps + 1):
            now = Crf(*w.shape)
            now.w, now.t, now.s = values
            g = slope(now)
            if not g[-1]:
                return self
            sums = np.split(g[:-1] / g[-1], np.cumsum([w.size, self.t.size]))
            grads = [sums[0].reshape(w.shape) - decay * w, sums[1].reshape(self.t.shape) - 100 * decay * self.t, sums[2]]
            for value, g, (m, v) in zip(values, grads, moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.w = w.astype(np.float32)
        return self

    def tag(self, rows: list[Sequence_]) -> list[np.ndarray]:
        """Most likely labels of each sequence (Viterbi), for all sequences at once, longest first."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
        if not order:
            return out
        lengths = np.array([len(rows[i]) for i in order])
        start = np.cumsum(lengths) - lengths
        at, begin = _flat([rows[i] for i in order])
        e = np.add.reduceat(self.w[at], begin, axis=0)
        best, back = e[start] + self.s, []
        for step in range(1, int(lengths[0])):
            n = int((lengths > step).sum())
            score = best[:n, :, None] + self.t
            back.append(score.argmax(1).astype(np.int8))
            best[:n] = score.max(1) + e[start[:n] + step]
        last = best.argmax(1)
        paths = np.empty(int(lengths.sum()), np.int64)
        now = last.copy()
        for step in range(int(lengths[0]) - 1, -1, -1):
            n = int((lengths > step).sum())
            ends = lengths[:n] == step + 1
            now[:n][ends] = last[:n][ends]
            paths[start[:n] + step] = now[:n]
            if step:
                now[:n] = back[step - 1][np.arange(n), now[:n]]
        for i, a, n in zip(order, start, lengths):
            out[i] = paths[a : a + n]
        return out
