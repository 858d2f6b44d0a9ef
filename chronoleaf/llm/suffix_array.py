"""Suffix arrays in linear time by grouping.

First phase: suffixes are grouped by a common prefix, at first by their first symbol. Groups are processed in
descending order. For each member the previous position in a lower group is found by following pointers that
are already known; the more members of the group point to a position, the higher that position moves within
its own group. In the end a group holds the suffixes of one Lyndon prefix, and the pointers are those to the
previous smaller suffix. Second phase: suffixes are put in order from the least; each one lets the suffixes
whose Lyndon prefix ends where it starts take the next place of their group, along the same pointers. No
substring is renamed and nothing is sorted but the symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of an integer sequence in ascending order; a proper prefix comes first."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(heads, n))
    start_of = np.empty(n, np.int64)
    start_of[by_symbol] = np.repeat(heads, sizes)
    place_of = np.empty(n, np.int64)
    place_of[by_symbol] = np.arange(n)
    size_at = np.zeros(n, np.int64)
    size_at[heads] = sizes
    order, group, place, size = by_symbol.tolist(), start_of.tolist(), place_of.tolist(), size_at.tolist()
    before = [-1] * n

    def lift(batch: list[int], head: int) -> None:
        """Takes ``batch`` out of the group at ``head`` into a new one right after what stays."""
        left = size[head]
        for p in batch:
            left -= 1
            last, at = head + left, place[p]
            other = order[last]
            order[last], order[at] = p, other
            place[p], place[other] = last, at
        size[head] = left
        fresh = head + left
        size[fresh] = len(batch)
        for p in batch:
            group[p] = fresh

    end = n
    while end:
        head = group[order[end - 1]]
        if end - head == 1:
            i = order[head]
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = before[j]
            before[i] = j
            if j >= 0:
                own = group[j]
                left = size[own] - 1
                if left:
                    last, at = own + left, place[j]
                    other = order[last]
                    order[last], order[at] = j, other
                    place[j], place[other] = last, at
                    size[own] = left
                    size[last] = 1
                    group[j] = last
            end = head
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[head:end]):
            j = i - 1
            while j >= 0 and group[j] >= head:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        levels: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            levels.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(levels, reverse=True):
            for own, batch in levels[times].items():
                if len(batch) < size[own]:
                    lift(batch, own)
        end = head

    out = [0] * n
    free = list(range(n))
    placed = bytearray(n)
    j = n
    for r in range(n + 1):
        s = j - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
        if r < n:
            j = out[r]
    return np.array(out, np.int64)
