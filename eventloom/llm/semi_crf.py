"""A semi-Markov conditional random field in numpy: whole segments are scored, not tokens.

A sequence of tokens is cut into segments; a segment is one token outside of any entity
(type 0) or up to ``LONGEST`` tokens of one entity type. A segmentation's score is the
sum of its segments' feature weights and of weights for neighbouring types. Dynamic
programs over (position, type) give the partition sum, segment marginals and the best
segmentation; a batch of sequences is worked on at once, padded on the left with
outside tokens that score nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

#: Tokens of an entity at most: the bound of the dynamic program.
LONGEST = 16
#: Buckets of hashed features, and features of a candidate segment and of an outside token.
SPACE, SEGMENT_FEATURES, TOKEN_FEATURES = 4096, 11, 3
_NEVER = -1e9


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SPACE


@dataclass
class Lattice:
    """One sequence: features of its tokens and of its candidate segments (first token, number of tokens)."""

    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    segments: np.ndarray
    #: What is known, in training: (first token, number of tokens, type from 1).
    gold: list[tuple[int, int, int]] = field(default_factory=list)


def _sum(x: np.ndarray, axis) -> np.ndarray:
    """log of the sum of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class SemiCrf:
    def __init__(self, types: int) -> None:
        self.types = types
        self.entity = np.zeros((types, SPACE))
        self.outside = np.zeros(SPACE)
        self.next = np.zeros((types + 1, types + 1))

    def scores(self, batch: list[Lattice]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(outside scores by token, segment scores by start, length and type, pads)."""
        width = max(len(x.tokens) for x in batch)
        outside = np.zeros((len(batch), width))
        entity = np.full((len(batch), width, LONGEST, self.types), _NEVER)
        pads = [width - len(x.tokens) for x in batch]
        for b, (x, pad) in enumerate(zip(batch, pads)):
            outside[b, pad:] = self.outside[x.tokens].sum(axis=1)
            if len(x.starts):
                entity[b, x.starts + pad, x.lengths - 1] = self.entity[:, x.segments].sum(axis=2).T
        return outside, entity, pads

    def forward(self, outside, entity, fold=_sum):
        """(reach, into): log sums over what ends at a position in a type, and over what may be followed by a type there."""
        n, width = outside.shape
        reach = np.full((n, width + 1, self.types + 1), _NEVER)
        reach[:, 0, 0] = 0
        into = np.full_like(reach, _NEVER)
        for j in range(width + 1):
            if j:
                reach[:, j, 0] = into[:, j - 1, 0] + outside[:, j - 1]
                back = np.arange(1, min(LONGEST, j) + 1)
                reach[:, j, 1:] = fold(into[:, j - back, 1:] + entity[:, j - back, back - 1], 1)
            into[:, j] = fold(reach[:, j, :, None] + self.next, 1)
        return reach, into

    def backward(self, outside, entity):
        """(leave, rest): log sums over what starts at a position with a type, and over all that follows a type there."""
        n, width = outside.shape
        leave = np.full((n, width + 1, self.types + 1), _NEVER)
        rest = np.zeros((n, width + 1, self.types + 1))
        for i in range(width - 1, -1, -1):
            leave[:, i, 0] = outside[:, i] + rest[:, i + 1, 0]
            ahead = np.arange(1, min(LONGEST, width - i) + 1)
            leave[:, i, 1:] = _sum(entity[:, i, ahead - 1] + rest[:, i + ahead, 1:], 1)
            rest[:, i] = _sum(leave[:, i, None, :] + self.next, 2)
        return leave, rest

    def marginals(self, outside, entity):
        """(log partition sums, segment probabilities by start, length and type, outside probabilities, of neighbouring types)."""
        reach, into = self.forward(outside, entity)
        leave, rest = self.backward(outside, entity)
        total = rest[:, 0, 0]
        n, width = outside.shape
        seg = np.zeros_like(entity)
        for length in range(1, min(LONGEST, width) + 1):
            starts = np.arange(width - length + 1)
            seg[:, starts, length - 1] = into[:, starts, 1:] + entity[:, starts, length - 1] + rest[:, starts + length, 1:]
        seg = np.exp(np.minimum(seg - total[:, None, None, None], 0)) * (entity > _NEVER / 2)
        out = np.exp(into[:, :-1, 0] + outside + rest[:, 1:, 0] - total[:, None])
        pairs = np.exp(np.minimum(reach[:, :-1, :, None] + self.next + leave[:, :-1, None, :] - total[:, None, None, None], 0)).sum(axis=1)
        return total, seg, out, pairs

    def slope(self, batch: list[Lattice]) -> list[np.ndarray]:
        """Gradient of the mean log likelihood: observed less expected features."""
        outside, entity, pads = self.scores(batch)
        _, seg, out, pairs = self.marginals(outside, entity)
        g_entity, g_outside = np.zeros_like(self.entity), np.zeros(SPACE)
        g_next = -pairs.sum(axis=0)
        for b, (x, pad) in enumerate(zip(batch, pads)):
            alone = np.ones(len(x.tokens))
            kinds = np.zeros(len(x.tokens) + pad, np.int64)
            known = {(i, n): k for i, n, k in x.gold}
            p = -seg[b, x.starts + pad, x.lengths - 1]
            for s, key in enumerate(zip(x.starts.tolist(), x.lengths.tolist())):
                if key in known:
                    p[s, known[key] - 1] += 1
            for k in range(self.types):
                np.add.at(g_entity[k], x.segments, p[:, k : k + 1])
            order, at = [], 0
            for i, n, k in sorted(x.gold):
                order += [0] * (i + pad - at) + [k]
                at = i + pad + n
                alone[i : i + n] = 0
            order += [0] * (len(kinds) - at)
            np.add.at(g_next, ([0, *order[:-1]], order), 1)
            np.add.at(g_outside, x.tokens, (alone - out[b, pad:])[:, None])
        g_next[0, 0] = 0  # so that padding scores nothing
        return [g / len(batch) for g in (g_entity, g_outside, g_next)]

    def train(self, lattices: list[Lattice], steps: int = 400, batch: int = 32, rate: float = 0.15, decay: float = 1e-5, seed: int = 3) -> None:
        """Stochastic gradients with per-weight step sizes."""
        if not lattices:
            return
        rng = np.random.default_rng(seed)
        weights = [self.entity, self.outside, self.next]
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            chosen = [lattices[i] for i in rng.integers(0, len(lattices), min(batch, len(lattices)))]
            for w, m, v, g in zip(weights, mean, square, self.slope(chosen)):
                g = g - decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.next[0, 0] = 0

    def decode(self, batch: list[Lattice]) -> list[list[tuple[int, int, int, float]]]:
        """The entities of each sequence's best segmentation: (first token, number of tokens, type, marginal probability)."""
        outside, entity, pads = self.scores(batch)
        _, seg, _, _ = self.marginals(outside, entity)
        reach, into = self.forward(outside, entity, lambda x, axis: x.max(axis=axis))
        found = []
        for b, pad in enumerate(pads):
            at, kind, here = outside.shape[1], int(reach[b, -1].argmax()), []
            while at > 0:
                if kind == 0:
                    at -= 1
                else:
                    back = np.arange(1, min(LONGEST, at) + 1)
                    n = int((into[b, at - back, kind] + entity[b, at - back, back - 1, kind - 1]).argmax()) + 1
                    at -= n
                    here.append((at - pad, n, kind, float(seg[b, at, n - 1, kind - 1])))
                kind = int((reach[b, at] + self.next[:, kind]).argmax())
            found.append(here[::-1])
        return found
