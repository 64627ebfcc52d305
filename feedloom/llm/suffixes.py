"""Enhanced suffix arrays of sequences of symbols: order, common prefixes, prefix intervals."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of ``symbols`` in order, by prefix doubling.

    Also returns, for each doubled length, the ranks of all positions by that
    many symbols, from which common prefixes follow. Doubling ends once no two
    suffixes share a prefix of the length reached.
    """
    n = len(symbols)
    order, rank, classes = ranked(symbols.astype(np.int64))
    levels, length = [(1, rank)], 1
    while classes < n and length < n:
        after = np.zeros(n, np.int64)
        after[:-length] = rank[length:] + 1
        order, rank, classes = ranked(rank * (n + 1) + after)
        length *= 2
        levels.append((length, rank))
    return order, levels


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, the rank of each (equal keys alike), and the number of different keys."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    new[:1] = 0
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, int(new.sum()) + 1 if len(keys) else 0


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (0 for the first)."""
    n = len(order)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    a, b = order[:-1].copy(), order[1:].copy()
    for length, rank in reversed(levels):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        # Equal ranks by `length` symbols can also mean that both end before it; ends are kept apart by separators.
        found[1:][same] += length
        a[same] += length
        b[same] += length
    return found


def prefix_intervals(prefixes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of common-prefix intervals of depth ``least`` or more, by one scan with a stack.

    ``prefixes[i]`` is the common prefix of the suffixes at places i-1 and i.
    Returns arrays left, right (inclusive), depth and parent's depth (0 above
    the roots). Each interval is a set of suffixes sharing exactly ``depth``
    symbols.
    """
    left, right, depth, above = [], [], [], []
    stack: list[tuple[int, int]] = []
    values = np.append(prefixes, 0)
    # Places with shorter prefixes only close what is open.
    for place in np.flatnonzero((values >= least) | (np.append(0, values[:-1]) >= least)).tolist():
        here = int(values[place])
        if here < least:
            here = 0
        start = place - 1
        while stack and stack[-1][1] > here:
            start, deep = stack.pop()
            left.append(start)
            right.append(place - 1)
            depth.append(deep)
            above.append(max(stack[-1][1] if stack else 0, here))
        if here and (not stack or stack[-1][1] < here):
            stack.append((start, here))
    return tuple(np.array(x, np.int64) for x in (left, right, depth, above))


def left_diverse(left: np.ndarray, right: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which intervals have suffixes with different symbols in front of them.

    ``before`` has the symbol in front of each suffix, in suffix order. An
    interval that isn't diverse only repeats what a longer one says.
    """
    changes = np.zeros(len(before) + 1, np.int64)
    changes[2:] = np.cumsum(before[1:] != before[:-1])
    return changes[right + 1] - changes[left + 1] > 0
