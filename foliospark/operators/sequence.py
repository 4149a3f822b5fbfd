"""Which rule of an ordered list takes which node of a sequence: exact grammar first, least bad recovery else."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Sequence

import numpy as np

BIG = 1 << 61


def assign(edges: np.ndarray | Sequence[Sequence[int]], low: list[int], high: list[int | None], reluctant: list[bool]) -> tuple[list[int], bool]:
    """The rule of each node (-1: none), and whether the sequence is accepted.

    edges[node, rule] is the cost of an assignment, -1 where the rule doesn't match. Accepted sequences part into one
    stretch a rule, in order, of low to high nodes (None: any); the least cost wins, then the first rule whose count
    differs: the smaller if reluctant, else the larger.
    """
    rows = edges.tolist() if isinstance(edges, np.ndarray) else edges
    n = len(rows)
    found = _accept(rows, low, [n if h is None else min(h, n) for h in high], reluctant)
    out = (found, True) if found is not None else (_recover(rows, len(low)), False)
    verify(rows, low, high, *out)
    return out


class Inconsistent(RuntimeError):
    """An assignment that its rules don't allow: no result may be drawn from it."""


def verify(edges: np.ndarray | Sequence[Sequence[int]], low: list[int], high: list[int | None], rules: list[int], accepted: bool) -> None:
    """Raises Inconsistent unless each node's rule matches it, rules come in order and, if accepted, each node has one and
    each rule as many as it may. O(nodes + rules)."""
    n, q = len(edges), len(low)
    count, last = [0] * q, 0
    for i, r in enumerate(rules):
        if r < 0 and not accepted:
            continue
        if not last <= r < q or edges[i][r] < 0:
            raise Inconsistent(f"node {i} can't have rule {r}")
        count[r] += 1
        last = r
    if len(rules) != n or accepted and any(c < a or b is not None and c > b for c, a, b in zip(count, low, high, strict=True)):
        raise Inconsistent("an accepted assignment breaks a cardinality")


def _accept(edges: Sequence[Sequence[int]], low: list[int], high: list[int], reluctant: list[bool]) -> list[int] | None:
    """Rules from the last to the first; best[i] is the least cost of nodes from i on. For each rule a window over the
    ends it may reach slides along; the cost of a stretch is a difference of sums. O(nodes) a rule."""
    n, q = len(edges), len(low)
    if not q or sum(low) > n:
        return None if n or q else []
    best = [BIG] * n + [0]
    choice = [array("q", bytes(8 * (n + 1))) for _ in range(q)]
    for j in range(q - 1, -1, -1):
        column = [row[j] for row in edges]
        reach = [n] * (n + 1)  # the first node from i on that the rule doesn't match
        total = [0] * (n + 1)  # cost of the nodes from i on
        for i in range(n - 1, -1, -1):
            reach[i] = i if column[i] < 0 else reach[i + 1]
            total[i] = total[i + 1] + max(0, column[i])
        new = [BIG] * (n + 1)
        window: deque[tuple[int, int]] = deque()  # (value, end), least in front
        added = n + 1
        for i in range(n, -1, -1):
            first, last = i + low[j], min(i + high[j], reach[i])
            while added > first and added > 0:
                added -= 1
                if added > n or best[added] >= BIG:
                    continue
                value = best[added] - total[added]
                # ends come in descending; of equal values the nearest end stays in front for a reluctant rule
                while window and (window[-1][0] > value or reluctant[j] and window[-1][0] == value):
                    window.pop()
                window.append((value, added))
            while window and window[0][1] > last:
                window.popleft()
            if window and window[0][1] >= first:
                new[i] = window[0][0] + total[i]
                choice[j][i] = window[0][1]
        best = new
    if best[0] >= BIG:
        return None
    out, i = [-1] * n, 0
    for j in range(q):
        end = choice[j][i]
        out[i:end] = [j] * (end - i)
        i = end
    return out


def _recover(edges: Sequence[Sequence[int]], q: int) -> list[int]:
    """Fewest nodes without a rule, then least cost, then take before leave before the next rule."""
    n = len(edges)
    if not q:
        return [-1] * n
    unit = n * max(1, max((max(row) for row in edges), default=0)) + 1
    after = [x * unit for x in range(n, -1, -1)]  # with no rule left, all are left
    move = []  # of each rule from the last: 0 take, 1 leave, 2 the next rule
    for j in range(q - 1, -1, -1):
        now, moves = list(after), bytearray(b"\2") * (n + 1)
        for i in range(n - 1, -1, -1):
            skip = now[i + 1] + unit
            if skip <= now[i]:
                now[i], moves[i] = skip, 1
            cost = edges[i][j]
            if cost >= 0 and (take := now[i + 1] + cost) <= now[i]:
                now[i], moves[i] = take, 0
        after = now
        move.append(moves)
    move.reverse()
    out, i, j = [-1] * n, 0, 0
    while i < n and j < q:
        m = move[j][i]
        if m == 0:
            out[i] = j
        if m == 2:
            j += 1
        else:
            i += 1
    return out
