"""Shortest edit scripts of two lists of lines, in memory that grows with the lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

#: Pairs of equal lines, for each line, up to which all pairs are looked at in order; beyond, edits are counted up.
PAIRS = 8


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of `a` and `b`, rising in both.

    Equal beginnings and ends belong to it, and what stands in one list only does not; neither changes its length. What is left is solved over its pairs of equal lines
    (Hunt and Szymanski: their number times a logarithm) if these are few, as they are where most lines stand once, and else by Myers' middle snakes (lines
    times edits, in linear space).
    """
    codes: dict = {}
    x, y = ([codes.setdefault(line, len(codes)) for line in side] for side in (a, b))
    out: list[tuple[int, int]] = []
    i, j = list(range(len(x))), list(range(len(y)))
    for _ in range(2):
        lead = next((k for k, (p, q) in enumerate(zip(i, j, strict=False)) if x[p] != y[q]), min(len(i), len(j)))
        out += zip(i[:lead], j[:lead], strict=True)
        i, j = i[lead:], j[lead:]
        tail = next((k for k, (p, q) in enumerate(zip(reversed(i), reversed(j), strict=False)) if x[p] != y[q]), min(len(i), len(j)))
        out += zip(i[len(i) - tail :], j[len(j) - tail :], strict=True)
        i, j = i[: len(i) - tail], j[: len(j) - tail]
        left, right = {x[p] for p in i}, {y[q] for q in j}
        i, j = [p for p in i if x[p] in right], [q for q in j if y[q] in left]
    p, q = [x[k] for k in i], [y[k] for k in j]
    n, m = Counter(p), Counter(q)
    pairs = sum(n[c] * m[c] for c in n)
    found = _by_pairs(p, q) if pairs <= PAIRS * (len(p) + len(q)) else _by_snakes(p, q)
    return sorted(out + [(i[s], j[t]) for s, t in found])


def _by_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(link)
            elif j < ends[k]:
                ends[k], chains[k] = j, link
    out, link = [], chains[-1] if chains else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _by_snakes(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        x, y, u, v = _middle(a, a0, a1, b, b0, b1)
        out += [(x + k, y + k) for k in range(u - x)]
        todo += [(a0, x, b0, y), (u, a1, v, b1)]
    return out


def _middle(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> tuple[int, int, int, int]:
    """The snake in the middle of a shortest way through a[a0:a1] and b[b0:b1], both not empty and unlike at both ends: where two searches, from the start and from the end, meet."""
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2
    size = (n + m) // 2 + 2
    there, back = [0] * (2 * size + 1), [0] * (2 * size + 1)
    for d in range(size):
        # diagonals that leave the rectangle are left out
        low, high = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)
        for k in range(low, high + 1, 2):
            x = there[size + k + 1] if k == -d or (k != d and there[size + k - 1] < there[size + k + 1]) else there[size + k - 1] + 1
            x0 = x
            while x < n and x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            there[size + k] = x
            if odd and abs(delta - k) < d and x + back[size + delta - k] >= n:
                return a0 + x0, b0 + x0 - k, a0 + x, b0 + x - k
        for k in range(low, high + 1, 2):
            x = back[size + k + 1] if k == -d or (k != d and back[size + k - 1] < back[size + k + 1]) else back[size + k - 1] + 1
            x0 = x
            while x < n and x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            back[size + k] = x
            if not odd and abs(delta - k) <= d and x + there[size + delta - k] >= n:
                return a1 - x, b1 - x + k, a1 - x0, b1 - x0 + k
    raise AssertionError("the searches meet before they end")


def edits(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(unchanged, changed, inserted or deleted, line of `old`, line of `new`) from 1 in the order of both; lines that are taken out and put in at one place are changed pair by pair."""
    out: list[tuple[str, int | None, int | None]] = []
    i = j = 0
    for p, q in [*common(old, new), (len(old), len(new))]:
        while i < p and j < q:
            i, j = i + 1, j + 1
            out.append(("changed", i, j))
        while i < p:
            i += 1
            out.append(("deleted", i, None))
        while j < q:
            j += 1
            out.append(("inserted", None, j))
        if p < len(old):
            i, j = p + 1, q + 1
            out.append(("unchanged", i, j))
    return out
