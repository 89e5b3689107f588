"""Prefix-free parsing: token streams as overlapping chunks whose ends depend on the content alone.

A stream is the words of a text with a mark between pieces, and ``OVERLAP`` end marks behind it. A window of
``OVERLAP`` tokens with a hash divisible by the modulus is a trigger. A chunk starts at a trigger (or the start of the
stream) and ends with the next trigger's last token, so neighbours share exactly one window, no chunk is a proper
prefix of another, and the same passage gives the same chunks in every text. A run of up to ``OVERLAP`` + 1 tokens
belongs to the one chunk in which it starts before the shared window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

OVERLAP = 3
#: Tokens that no word can be: the border of two pieces, and the end of a text.
BORDER, END = b"\n", b"\r"
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
_TABLE, _SECOND = np.random.default_rng(2024).integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of tokens that are hashed together.
PIECE = 1 << 15
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            grown, step = np.ones(1, dtype=np.uint64), base
            while len(grown) < size:
                grown = np.concatenate([grown, grown * np.uint64(step)])
                step = step * step % 2**64
            _POWERS[k] = grown
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(text: str) -> bytes:
    """The tokens of a text, joined by single spaces: lower-cased words and borders, then the end marks."""
    tokens = text.encode().lower().translate(_BREAKS).replace(b"\xff", b" \xff ").split()
    if not tokens:
        return b""
    return b" ".join(tokens).replace(b"\xff", BORDER) + (b" " + END) * OVERLAP


class Tokens:
    """Places and hashes of the tokens of streams or chunks joined by single spaces."""

    def __init__(self, data: bytes):
        self.data = data
        self.raw = raw = np.frombuffer(data, dtype=np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.start = np.append(0, gaps + 1)
        self.end = np.append(gaps, len(raw))
        self.hash = self.hashed(_TABLE)
        first = raw[self.start]
        single = self.end - self.start == 1
        self.stop = single & (first == END[0])
        self.word = ~(self.stop | (single & (first == BORDER[0])))

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self, table: np.ndarray) -> np.ndarray:
        """A hash of every token, from differences of one running sum over the bytes."""
        out = np.empty(len(self), dtype=np.uint64)
        # in pieces that stay in a core's cache; a hash does not depend on where its token stands
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, len(self.raw), PIECE))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(self)]):
            at, end = self.start[a:b], self.end[a:b]
            raw = self.raw[at[0] : end[-1]]
            power, inverse = _powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum(table[raw] * power[: len(raw)], out=total[1:])
            at, end = at - at[0], end - at[0]
            out[a:b] = (total[end] - total[at]) * inverse[at]
        return mixed(out)

    def second(self) -> np.ndarray:
        """Hashes independent of ``hash``; tokens equal in both are taken for equal."""
        return self.hashed(_SECOND)


def chunks(streams: list[bytes], modulus: int) -> Iterator[tuple[int, bytes]]:
    """(number of the stream, chunk) for every chunk of non-empty streams."""
    if not streams:
        return
    t = Tokens(b" ".join(streams))
    n = len(t)
    window = mixed(t.hash[: n - 2] + mixed(t.hash[1 : n - 1] + mixed(t.hash[2:])))
    # the last end mark of a stream is followed by the start of the next one
    closing = t.stop & np.append(~t.stop[1:], True)
    start = np.append(0, np.flatnonzero(closing)[:-1] + 1)
    owner = np.cumsum(np.append(0, closing[:-1]))
    inside = ~t.stop[: n - 2] & (window % np.uint64(modulus) == 0)
    inside[start] = True
    at = np.flatnonzero(inside)
    # a chunk ends with the window of the next one, or with the end of its stream
    last = np.flatnonzero(closing)[owner[at]]
    following = np.append(at[1:], n)
    stop = np.where(following <= last, following + OVERLAP - 1, last)
    for k, a, b in zip(owner[at].tolist(), t.start[at].tolist(), t.end[stop].tolist()):
        yield k, t.data[a:b]
