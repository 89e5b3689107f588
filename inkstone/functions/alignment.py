"""Alignment and distance of two character sequences, kernels that stay in Python."""

from __future__ import annotations

import numpy as np


def local_alignment(a: list[str], b: list[str], match=4, mismatch=-1, skip_b=-0.6, skip_a=-2):
    """Best-scoring chunk of two texts as (a_start, a_end, b_start, b_end, score, matched), or None.

    Scores are in quarters of a match. The start and the match count are carried
    along with the score, so no table is kept and nothing is traced back.
    """
    best = (0.0, 0, 0, 0, 0, 0)
    # a cell is (score, a_start, b_start, matched)
    above = [(0.0, 0, j, 0) for j in range(len(b) + 1)]
    for i, ca in enumerate(a, 1):
        left = (0.0, i, 0, 0)
        row = [left]
        for j, cb in enumerate(b, 1):
            same = ca == cb
            d, u = above[j - 1], above[j]
            s_d = d[0] + (match if same else mismatch)
            s_l, s_u = left[0] + skip_b, u[0] + skip_a
            top = max(s_d, s_l, s_u)
            if top <= 0:
                left = (0.0, i, j, 0)
            elif s_d >= top - 1e-9:
                left = (s_d, d[1], d[2], d[3] + same)
            elif s_l >= top - 1e-9:
                left = (s_l, left[1], left[2], left[3])
            else:
                left = (s_u, u[1], u[2], u[3])
            row.append(left)
            if left[0] > best[0]:
                best = (left[0], left[1], i, left[2], j, left[3])
        above = row
    if best[0] <= 0:
        return None
    score, a0, a1, b0, b1, matched = best
    return a0, a1, b0, b1, score / match, matched


def local_alignments(
    a: list[str], b: list[str], match: float = 4, mismatch: float = -1, skip_b: float = -0.6, skip_a: float = -2
) -> dict[str, np.ndarray]:
    """What :func:`local_alignment` finds for each pair, cell by cell over all pairs at once; a score of zero is none.

    Pairs are taken from the longest left text down, so that each row of cells is computed for those that have it. Behind a
    shorter right text no cell beats the best one, since nothing matches there.
    """
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    order = np.argsort(-la, kind="stable")
    wide = int(lb.max(initial=0))
    left, right = _codes(a, la)[order].T.copy(), _codes(b, lb)[order].T.copy()
    left_sizes = -la[order]
    # a chunk's start in both texts and its matches travel in one number: 22, 22 and 20 bits
    best, best_path, best_end = np.zeros(len(a)), np.zeros(len(a), np.int64), np.zeros((2, len(a)), np.int64)
    score, path = np.zeros((wide + 1, len(a))), np.zeros((wide + 1, len(a)), np.int64)
    path[:] = np.arange(wide + 1)[:, None] << 20
    for i in range(1, len(left) + 1):
        n = int(np.searchsorted(left_sizes, -i, side="right"))
        before, before_path = np.zeros(n), np.full(n, i << 42, np.int64)
        corner, corner_path = score[0, :n].copy(), path[0, :n].copy()
        score[0, :n], path[0, :n] = before, before_path
        for j in range(1, wide + 1):
            same = left[i - 1, :n] == right[j - 1, :n]
            above, above_path = score[j, :n].copy(), path[j, :n].copy()
            s_d, s_l, s_u = corner + np.where(same, match, mismatch), before + skip_b, above + skip_a
            near = np.maximum(np.maximum(s_d, s_l), s_u)
            empty = near <= 0
            near -= 1e-9
            d, l = s_d >= near, s_l >= near
            before = np.where(d, s_d, np.where(l, s_l, s_u))
            before_path = np.where(d, corner_path + same, np.where(l, before_path, above_path))
            before[empty] = 0.0
            before_path[empty] = (i << 42) + (j << 20)
            score[j, :n], path[j, :n] = before, before_path
            better = before > best[:n]
            if better.any():
                at = np.flatnonzero(better)
                best[at], best_path[at], best_end[0, at], best_end[1, at] = before[at], before_path[at], i, j
            corner, corner_path = above, above_path
    back = np.empty(len(a), np.int64)
    back[order] = np.arange(len(a))
    best, best_path, best_end = best[back], best_path[back], best_end[:, back]
    return {
        "f_start": best_path >> 42, "f_end": best_end[0], "c_start": (best_path >> 20) & 0x3FFFFF, "c_end": best_end[1],
        "score": best / match, "matched": best_path & 0xFFFFF,
    }


#: Pairs whose texts' characters are counted in one table.
COUNTED = 1024


def shared_characters(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Size of the multiset intersection of the characters of each pair of texts; no text shares nothing."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), COUNTED):
        known: dict[str, int] = {}
        left, right = (np.array([known.setdefault(t or "", len(known)) for t in side[at : at + COUNTED]], np.int64) for side in (a, b))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        letters, place = np.unique(np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.int32), return_inverse=True)
        if not len(letters):
            continue
        bag = np.bincount(np.repeat(np.arange(len(known)), sizes) * len(letters) + place, minlength=len(known) * len(letters))
        bag = bag.reshape(len(known), -1).astype(np.int32)
        step = max(1, (1 << 20) // len(letters))
        for k in range(0, len(left), step):
            shared = np.minimum(bag[left[k : k + step]], bag[right[k : k + step]]).sum(axis=1)
            out[at + k : at + k + len(shared)] = shared
    return out


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Code points of the texts, a row each, filled up with a number that no text holds."""
    out = np.full((len(texts), int(sizes.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def global_agreement(a: str, b: str, match=2, mismatch=-1, gap=-1) -> tuple[str, str]:
    """(agreeing, differing) characters of ``a`` where the end-to-end alignment pairs it with ``b``."""
    # a cell is (score, agreeing, differing); ties prefer the pair, then skipping in a
    above = [(j * gap, "", "") for j in range(len(b) + 1)]
    for i, ca in enumerate(a, 1):
        left = (i * gap, "", "")
        row = [left]
        for j, cb in enumerate(b, 1):
            d, u = above[j - 1], above[j]
            s_d, s_u, s_l = d[0] + (match if ca == cb else mismatch), u[0] + gap, left[0] + gap
            if s_d >= s_u and s_d >= s_l:
                left = (s_d, d[1] + ca, d[2]) if ca == cb else (s_d, d[1], d[2] + ca)
            elif s_u >= s_l:
                left = (s_u, u[1], u[2])
            else:
                left = (s_l, left[1], left[2])
            row.append(left)
        above = row
    return above[-1][1], above[-1][2]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a whole column of cells in one number (Myers, Hyyrö).

    Bit i of ``up`` and ``down`` tells whether a cell is one above or one below the cell before it in the column.
    """
    if len(a) < len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = full, 0
    for c in b:
        same = places.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        right_up = down | (full & ~(horizontal | up))
        right_down = (up & horizontal) << 1 & full
        right_up = (right_up << 1 | 1) & full
        up = right_down | (full & ~(vertical | right_up))
        down = right_up & vertical
    return len(b) + up.bit_count() - down.bit_count()
