"""Common subsequences of two sequences."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Bits of state that a longest common subsequence keeps at once; beyond, the problem is halved.
MOST_BITS = 40_000_000


def longest_chain(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        if p:
            back[k] = at[p - 1]
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _rows(a: list[int], b: list[int]):
    """One row of bits for each element of ``a``: bit j is 0 where the common length grows at j. One addition moves a whole row."""
    where: dict[int, int] = {}
    for j, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    free = full
    for v in a:
        hit = free & where.get(v, 0)
        free = ((free + hit) | (free - hit)) & full
        yield free


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Common lengths of ``a`` with every beginning of ``b``."""
    free = (1 << len(b)) - 1
    for free in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(free.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(place in ``a``, place in ``b``) of a longest common subsequence, in order.

    Equal ends are cut off first. Large problems are halved at the middle of
    ``a``, so memory is bounded by MOST_BITS bits besides the sequences.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        x, y = a[i:m], b[j:n]
        if len(x) > 1 and len(x) * len(y) > MOST_BITS:
            half = len(x) // 2
            first, rest = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])
            cut = int((first + rest[::-1]).argmax())
            todo += [(i, i + half, j, j + cut), (i + half, m, j + cut, n)]
            continue
        rows = list(_rows(x, y))
        p, q = len(x), len(y)
        while p and q:
            if rows[p - 1] >> (q - 1) & 1:
                q -= 1
            elif p > 1 and not rows[p - 2] >> (q - 1) & 1:
                p -= 1
            else:
                p, q = p - 1, q - 1
                out.append((i + p, j + q))
    return sorted(out)


def common_places(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence of ``a`` and ``b``."""
    return {i for i, _ in common_pairs(a, b)}


def patience_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(place in ``a``, place in ``b``) of the lines that patience diff aligns, in order.

    Equal ends of a range are aligned; of the lines that occur once in either
    side of what is between, the longest chain in order is aligned, and the
    ranges between its links are treated alike. A range without such lines is
    aligned by a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        mine, theirs = _once(a, i, m), _once(b, j, n)
        links = [(p, theirs[v]) for v, p in mine.items() if p >= 0 and theirs.get(v, -1) >= 0]
        if links:
            p, q = i, j
            for k in longest_chain([y for _, y in links]):
                x, y = links[k]
                todo.append((p, x, q, y))
                out.append((x, y))
                p, q = x + 1, y + 1
            todo.append((p, m, q, n))
        elif not mine.keys().isdisjoint(theirs):
            out += [(i + x, j + y) for x, y in common_pairs(a[i:m], b[j:n])]
    return sorted(out)


def _once(x: list[int], first: int, end: int) -> dict[int, int]:
    """The place of each value in a range, in order; -1 if it has several."""
    out: dict[int, int] = {}
    for k in range(first, end):
        out[x[k]] = -1 if x[k] in out else k
    return out
