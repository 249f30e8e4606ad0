"""The vote's groups of a line of anchors, without going through them one by one.

On a line, in order of (T, q), a group has a reference: its first anchor, then each anchor of smaller q
than all before it in the group. An anchor joins while its T lies within the reach of the reference.
So for any anchor as a reference two places decide how its group goes on: the last anchor within its
reach, and the next anchor of smaller q. If that comes first, it is the next reference; else the group
ends with the reach. Both are found for all anchors at once, chains of references are followed by
doubling, and so are the groups from each stretch's first anchor on.
"""

from __future__ import annotations

import numpy as np


def next_smaller(q: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or any beyond ``end``. What lies between a place and its candidate is never smaller, so candidates are passed on from place to place."""
    n = len(q)
    ahead = np.arange(1, n + 1)
    left = np.arange(n)
    while True:
        at = ahead[left]
        left = left[(at <= end[left]) & (q[np.minimum(at, n - 1)] >= q[left])]
        if not len(left):
            return ahead
        ahead[left] = ahead[ahead[left]]


def starts(T: np.ndarray, q: np.ndarray, line: np.ndarray, reach: int) -> np.ndarray:
    """Places where groups begin, of anchors sorted by (line, T, q)."""
    n = len(T)
    if not n:
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], (line[1:] != line[:-1]) | (T[1:] - T[:-1] > reach)))
    first = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    last = np.concatenate((first[1:], [n])) - 1
    # stretches end within the reach of nothing behind them, so that the whole is one sorted row of numbers
    spread = T - T[first][stretch] + np.concatenate(([0], np.cumsum(T[last] - T[first] + reach + 1)[:-1]))[stretch]
    wide = (T[last] - T[first] > reach)[stretch]
    if not wide.any():
        return first
    place = np.flatnonzero(wide)
    q, spread = q[place], spread[place]
    end = np.searchsorted(spread, spread + reach, side="right") - 1
    ahead = next_smaller(q, end)
    here = np.arange(len(place))
    chain = np.where(ahead <= end, ahead, here)
    while True:
        far = chain[chain]
        if (far == chain).all():
            break
        chain = far
    after = end[chain] + 1
    begins = new[place]
    at = np.flatnonzero(begins)
    found = [first]
    while len(at):
        at = after[at]
        at = at[at < len(place)]
        at = at[~begins[at]]
        found.append(place[at])
    return np.sort(np.concatenate(found))
