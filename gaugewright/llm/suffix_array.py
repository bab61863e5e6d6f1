"""Enhanced suffix arrays over byte strings, and the maximal repeats that their common-prefix intervals give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sorted_suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (n x width bytes) and, for each place in it, the common prefix with the row before."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 16):
        b = min(n, a + (1 << 16))
        same = rows[order[a:b]] == rows[order[a - 1 : b - 1]]
        lcp[a:b] = np.where(same.all(1), width, same.argmin(1))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The nodes (length, first place, last place) of the common-prefix interval tree with a length of ``least`` or more, children first.

    One scan with a stack: an interval opens where the common prefix grows and closes where it falls below.
    """
    stack: list[tuple[int, int]] = []
    for place in range(1, len(lcp) + 1):
        now = int(lcp[place]) if place < len(lcp) else 0
        first = place - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, place - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def diverse_runs(rows: np.ndarray, lengths: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, common prefixes, changes of the byte in front, firsts, lasts) of the tree's top nodes that differ in front.

    ``lengths`` says how many bytes of a row count, ``before`` is the byte in front of it (-1: none or
    unknown). A node whose rows all have the same known byte in front is no maximal repeat, nor is any
    node below it: with that byte it is another one.
    """
    order, lcp = sorted_suffixes(rows)
    ends = lengths[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(ends[1:], ends[:-1]))
    joined = lcp >= least
    firsts = np.flatnonzero(~joined & np.concatenate([joined[1:], [False]]))
    lasts = np.flatnonzero(joined & ~np.concatenate([joined[1:], [False]]))
    front = before[order]
    change = np.concatenate([[0], np.cumsum((front[1:] != front[:-1]) | (front[1:] < 0))])
    diverse = (change[lasts] != change[firsts]) | (front[firsts] < 0) if len(firsts) else np.zeros(0, bool)
    return order, lcp, change, firsts[diverse], lasts[diverse]


def maximal_repeats(rows: np.ndarray, lengths: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, members) of every string of ``least`` bytes or more that begins several rows and can't be extended, with all its members."""
    order, lcp, change, firsts, lasts = diverse_runs(rows, lengths, before, least)
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        part = lcp[a : b + 1].copy()
        part[0] = 0
        for length, first, last in intervals(part, least):
            x, y = a + first, a + last
            if change[y] != change[x] or before[order[x]] < 0:
                yield length, order[x : y + 1]


def later_members(rows: np.ndarray, lengths: np.ndarray, before: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of every row that is not the first, by ``rank``, of some maximal repeat it begins with, and the longest such.

    The scan that finds the intervals carries each interval's first member. Where two parts of an interval
    meet, the later of their first members gets the interval's length; all other members got a longer
    one before. So a repeat with very many members costs one step for each, at any depth of the tree.
    """
    order, lcp, _, firsts, lasts = diverse_runs(rows, lengths, before, least)
    pair = lasts == firsts + 1
    x, y = order[firsts[pair]], order[lasts[pair]]
    later, size = [np.where(rank[x] > rank[y], x, y)], [lcp[lasts[pair]]]
    apart = rank[x] != rank[y]
    later[0], size[0] = later[0][apart], size[0][apart]
    for a, b in zip(firsts[~pair].tolist(), lasts[~pair].tolist()):
        members, common = order[a : b + 1], lcp[a + 1 : b + 1].tolist()
        ranks = rank[members].tolist()
        rows_, sizes = [], []
        stack: list[tuple[int, int]] = []  # open intervals: length, place of the first member so far
        for place in range(1, len(ranks) + 1):
            now = common[place - 1] if place < len(ranks) else 0
            own = place - 1
            while stack and stack[-1][0] >= now:
                length, held = stack.pop()
                if ranks[held] != ranks[own]:
                    rows_.append(held if ranks[held] > ranks[own] else own)
                    sizes.append(length)
                own = held if ranks[held] < ranks[own] else own
            stack.append((now, own))
        later.append(members[rows_])
        size.append(np.array(sizes, np.int64))
    return np.concatenate(later), np.concatenate(size)
