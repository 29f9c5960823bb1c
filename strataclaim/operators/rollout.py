"""Rollouts of one graph as arrays: the same numbers as ``graph.joined_rollouts``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strataclaim.operators import noise
from strataclaim.operators.graph import DECAY, NOISE, START_NOISE

#: Hashes of a block, which should stay in a core's cache; numbers of noise that are held at once.
BLOCK, HELD = 2**14, 2**22


def _clamp(x: np.ndarray) -> np.ndarray:
    """Within 0 and 1, a NaN being the larger as in SQL."""
    return np.fmax(0.0, np.fmin(1.0, x))


class Rollouts:
    """Nodes with one or more ``starts`` of belief, and pairs of them with the weight and number of their edges."""

    def __init__(self, node: pa.Array, starts: list[np.ndarray], source: np.ndarray, target: np.ndarray, weight: np.ndarray, number: np.ndarray, steps: int, seed: int):
        self.node, self.starts, self.steps, self.seed = node, starts, steps, seed
        self.names = list(noise.by_length(node))
        length, place = np.empty(len(node), np.int64), np.empty(len(node), np.int64)
        for n, at, _ in self.names:
            length[at], place[at] = n, np.arange(len(at))
        order = np.lexsort((target, source, length[target]))
        self.source, self.target, self.weight = source[order].astype(np.int64), target[order].astype(np.int64), weight[order]
        self.scale = NOISE * number[order]
        self.groups, own = [], length[self.target]
        for n, _, parts in self.names:
            a, b = np.searchsorted(own, [n, n + 1])
            if a < b:
                self.groups.append((n, a, b, parts[:, place[self.target[a:b]]]))
        self.at_once = max(1, min(steps, HELD // max(1, len(order))))

    def _hashed(self, seeds: np.ndarray) -> np.ndarray:
        """Hashes of all nodes, a row for each seed."""
        out = np.empty((len(seeds), len(self.node)), np.uint64)
        for n, at, parts in self.names:
            out[:, at] = noise.hash_text(np.repeat(seeds[:, None], len(at), 1), n, parts)
        return out

    def _noise(self, sim: int, steps: range) -> np.ndarray:
        """The noise of all pairs, a row for each of ``steps``."""
        first = self._hashed(np.concatenate([noise.seeds(self.seed + 1, k, sim, s) for k in (1, 2) for s in steps]))
        out, wide = np.empty((len(steps), len(self.source))), max(1, BLOCK // len(first))
        for n, begin, end, parts in self.groups:
            for a in range(begin, end, wide):
                b = min(a + wide, end)
                h = noise.hash_text(first[:, self.source[a:b]], n, parts[:, a - begin : b - begin])
                out[:, a:b] = noise.normal(h[: len(steps)], h[len(steps) :])
        out *= self.scale
        return out

    def run(self, sim: int) -> list[np.ndarray]:
        """Final beliefs of one simulation, for each of the starts."""
        h = self._hashed(np.concatenate([noise.seeds(self.seed, k, sim) for k in (1, 2)]))
        jitter = START_NOISE * noise.normal(h[0], h[1])
        states = [_clamp(x + jitter) for x in self.starts]
        for s in range(self.steps):
            if s % self.at_once == 0:
                pushes = self._noise(sim, range(s, min(s + self.at_once, self.steps)))
            for k, b in enumerate(states):
                pull = np.abs(b - 0.5) * 2.0
                push = np.bincount(self.target, pull[self.source] * self.weight + pushes[s % self.at_once], len(b))
                states[k] = _clamp(b + push + (0.5 - b) * (1 - DECAY))
        return states
