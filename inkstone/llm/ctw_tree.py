"""Context-tree weighting over bytes, in numpy, for the contexts of one bucket.

A gram is the symbol and the bytes before it in one number: nearest byte first, then farther ones, the
symbol last. Each symbol is eight binary decisions, and each decision has its own tree of contexts. A node
estimates by Krichevsky-Trofimov and weighs its estimate against those of its longer contexts.
"""

from __future__ import annotations

import numpy as np

#: No byte of UTF-8: it stands before a text and ends it.
EDGE = 255
HALF = np.log(0.5)
LGAMMA_HALF = 0.5 * np.log(np.pi)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift by eight."""
    x = np.asarray(x, dtype=np.float64)
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    z = x + 8
    inverse = 1 / (z * z)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability of a sequence with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - 2 * LGAMMA_HALF - lgamma(zeros + ones + 1.0)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all texts in a row, number of grams of each). Every text ends in EDGE."""
    edge = bytes([EDGE]) * depth
    stream = np.frombuffer(edge + edge.join(texts) + edge, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = depth + np.cumsum(sizes + depth) - (sizes + depth)
    wide = stream.astype(np.uint64)
    n = len(stream) - depth
    key = wide[depth:].copy()
    for back in range(1, depth + 1):
        key |= wide[depth - back : depth - back + n] << np.uint64(8 * (depth + 1 - back))
    inside = np.zeros(n + 1, dtype=np.int32)
    np.add.at(inside, starts - depth, 1)
    np.add.at(inside, starts - depth + sizes + 1, -1)
    return key[np.cumsum(inside[:-1]) > 0], sizes + 1


def bucket_of(key: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Bucket of a gram: by its two nearest bytes, so that deeper trees lie whole in one bucket."""
    near = (key >> np.uint64(8 * (depth - 1))).astype(np.uint64)
    return (((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class Level:
    """The binary nodes of all contexts of one length."""

    def __init__(self, key: np.ndarray, counts: np.ndarray, depth: int, length: int):
        short = ((key >> np.uint64(8 * (depth - length) + 8)) << np.uint64(8)) | (key & np.uint64(255))
        self.grams, self.of = np.unique(short, return_inverse=True)
        have = np.bincount(self.of, weights=counts, minlength=len(self.grams))
        self.nodes, self.place, self.zeros, self.ones = [], [], [], []
        for bit in range(8):
            node = self.grams >> np.uint64(8 - bit)
            new = np.append(True, node[1:] != node[:-1])
            at = np.flatnonzero(new)
            total = np.add.reduceat(have, at)
            one = np.add.reduceat(have * ((self.grams >> np.uint64(7 - bit)) & np.uint64(1)), at)
            self.nodes.append(node[at])
            self.place.append(np.cumsum(new) - 1)
            self.ones.append(one)
            self.zeros.append(total - one)
        self.kt = [log_kt(z, o) for z, o in zip(self.zeros, self.ones)]
        self.weighted = list(self.kt)

    def weigh(self, deeper: Level) -> None:
        """Mix each estimate half and half with the product of those of the longer contexts."""
        for bit in range(8):
            child = deeper.nodes[bit]
            parent = ((child >> np.uint64(bit + 8)) << np.uint64(bit)) | (child & np.uint64((1 << bit) - 1))
            at = np.searchsorted(self.nodes[bit], parent)
            product = np.bincount(at, weights=deeper.weighted[bit], minlength=len(self.nodes[bit]))
            self.weighted[bit] = HALF + np.logaddexp(self.kt[bit], product)


class Tree:
    """The contexts of length two and more of one bucket; ``key`` is sorted and distinct."""

    def __init__(self, key: np.ndarray, counts: np.ndarray, depth: int):
        self.key, self.depth = key, depth
        self.levels = {n: Level(key, counts, depth, n) for n in range(2, depth + 1)}
        for n in range(depth - 1, 1, -1):
            self.levels[n].weigh(self.levels[n + 1])

    def top(self) -> tuple[np.ndarray, ...]:
        """(nearest byte, node, zeros, ones, log weighted) sums over the contexts of length two; nodes from 1 to 255."""
        level = self.levels[2]
        rows = []
        for bit in range(8):
            near = (level.nodes[bit] >> np.uint64(bit + 8)).astype(np.int64)
            node = (1 << bit) | (level.nodes[bit] & np.uint64((1 << bit) - 1)).astype(np.int64)
            flat, at = np.unique(near * 256 + node, return_inverse=True)
            sums = [np.bincount(at, weights=x[bit]) for x in (level.zeros, level.ones, level.weighted)]
            rows.append((flat // 256, flat % 256, *sums))
        return tuple(np.concatenate(x) for x in zip(*rows))

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of the symbol of each gram after its context."""
        symbol = (self.key & np.uint64(255)).astype(np.int64)
        near = (self.key >> np.uint64(8 * self.depth)).astype(np.int64)
        out = np.zeros(len(self.key))
        for bit in range(8):
            one = ((symbol >> (7 - bit)) & 1).astype(bool)
            guess = np.full(len(self.key), 0.5)
            seen = np.zeros(len(self.key), dtype=bool)
            for n in range(self.depth, 1, -1):
                level = self.levels[n]
                at = level.place[bit][level.of]
                zeros, ones = level.zeros[bit][at], level.ones[bit][at]
                total = zeros + ones
                own = (np.where(one, ones, zeros) + 0.5) / (total + 1)
                share = np.exp(np.minimum(0, HALF + level.kt[bit] - level.weighted[bit]))[at]
                guess = np.where(seen, share * own + (1 - share) * guess, own)
                seen |= total > 0
            node = (1 << bit) | (symbol >> (8 - bit))
            out += np.log10(top.mix(near, node, one, guess, seen))
        return out


class Top:
    """The contexts of length none and one: at most 256 x 255 nodes, from the sums over all buckets."""

    def __init__(self, near, node, zeros, ones, weighted):
        count = np.zeros((2, 256, 256))
        product = np.zeros((256, 256))
        np.add.at(count[0], (near, node), zeros)
        np.add.at(count[1], (near, node), ones)
        np.add.at(product, (near, node), weighted)
        self.count1 = count
        kt1 = log_kt(count[0], count[1])
        weighted1 = HALF + np.logaddexp(kt1, product)
        self.share1 = np.exp(np.minimum(0, HALF + kt1 - weighted1))
        self.count0 = count.sum(axis=1)
        kt0 = log_kt(self.count0[0], self.count0[1])
        self.share0 = np.exp(np.minimum(0, HALF + kt0 - (HALF + np.logaddexp(kt0, weighted1.sum(axis=0)))))

    def mix(self, near, node, one, guess, seen):
        """Probability of the bits, given that of the longer contexts where those were seen in training."""
        zeros, ones = self.count1[0][near, node], self.count1[1][near, node]
        own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
        share = self.share1[near, node]
        guess = np.where(seen, share * own + (1 - share) * guess, own)
        seen = seen | (zeros + ones > 0)
        zeros, ones = self.count0[0][node], self.count0[1][node]
        own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
        share = self.share0[node]
        return np.where(seen, share * own + (1 - share) * guess, own)
