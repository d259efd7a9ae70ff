"""Suffix automata of many texts at once, as arrays.

The states of a text's suffix automaton are its classes of substrings that end at the same
places; their suffix links form the suffix tree of the reversed text. So the states of a whole
batch of texts come from one sort of their reversed prefixes: neighbours in that order share
their longest common ending, and the intervals of the order that share at least so much are the
states. Sorting is by doubling, over all texts of the batch together, without a Python object
for a state, so a very long text costs its length in numbers and no more. Transitions are
never asked for and not built.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Characters that the first sort takes at once.
BLOCK = 4


@dataclass(frozen=True)
class Order:
    """Places of a batch in the order of what ends there (texts kept apart), and the characters each shares with the place before it."""

    places: np.ndarray
    shared: np.ndarray


def ending_order(codes: np.ndarray, starts: np.ndarray) -> Order:
    """Sort all places of the texts (which begin at ``starts`` in ``codes``) by the text that ends there, read backwards.

    The first sort takes the last BLOCK characters at once; from then on the ranks by the last h
    characters give those by the last 2h. A place with fewer characters before it ranks below
    the others of its text. What two neighbours share is read from the same ranks, the
    longest step first, and at last character by character.
    """
    n = len(codes)
    if not n:
        return Order(np.zeros(0, np.int64), np.zeros(0, np.int64))
    text = np.zeros(n, np.int64)
    text[starts[starts < n]] = 1
    text = np.cumsum(text)
    at = np.arange(n)
    room = at - np.maximum.accumulate(np.where(np.r_[True, text[1:] != text[:-1]], at, 0))  # characters before each place
    letters, code = np.unique(codes, return_inverse=True)
    width = len(letters) + 1
    block = BLOCK
    while block > 1 and float(text[-1] + 1) * float(width) ** block > 2.0**62:
        block //= 2
    key = text
    for j in range(block):
        key = key * width + np.where(room >= j, code[np.maximum(at - j, 0)] + 1, 0)
    order = np.argsort(key)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))  # a group's rank is its first place in the order
    levels, h = [rank.astype(np.int32)], block
    twin = ~new
    twin[:-1] |= ~new[1:]
    open_ = order[twin]
    while len(open_):
        second = np.where(room[open_] >= h, rank[np.maximum(open_ - h, 0)] + 1, 0)
        key = rank[open_] * (n + 1) + second
        by = np.argsort(key)
        key, open_ = key[by], open_[by]
        group = key // (n + 1)
        new = np.r_[True, key[1:] != key[:-1]]
        here = np.arange(len(key))
        inside = np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], here, 0))
        rank[open_] = group + inside
        levels.append(rank.astype(np.int32))
        twin = ~new
        twin[:-1] |= ~new[1:]
        open_ = open_[twin]
        h *= 2
    order[rank] = at
    a, b = order[:-1], order[1:]
    most = np.where(text[a] == text[b], np.minimum(room[a], room[b]) + 1, 0)
    got = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = block << k
        live = np.flatnonzero(most - got >= step)
        x, y = a[live] - got[live], b[live] - got[live]
        got[live[levels[k][x] == levels[k][y]]] += step
    for _ in range(block - 1):
        live = np.flatnonzero(most > got)
        got[live[code[a[live] - got[live]] == code[b[live] - got[live]]]] += 1
    return Order(order, np.r_[0, got])


@dataclass(frozen=True)
class States:
    """States with at least two occurrences: length of the longest member, occurrences, first and last place where it ends, and its interval of the order."""

    length: np.ndarray
    count: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray


def repeated_states(order: Order, least: int, times: int = 2, among: np.ndarray | None = None) -> States:
    """All states whose longest member has at least ``least`` characters and comes at least ``times`` (two or more) times: the maximal repeats that cannot be made longer to the left. ``among`` flags the places of the texts that are asked for."""
    n = len(order.places)
    close = order.shared >= least
    # A state is an interval of places that share enough with the one before; shorter intervals hold none.
    begin = np.flatnonzero(close & ~np.r_[False, close[:-1]])
    end = np.flatnonzero(close & ~np.r_[close[1:], False]) + 1
    wide = end - begin >= times - 1
    step = np.zeros(n + 1, np.int64)
    step[begin[wide] - 1] += 1
    np.subtract.at(step, end[wide], 1)
    chosen = np.cumsum(step[:n]) > 0
    at = np.flatnonzero(chosen if among is None else chosen & among[order.places])
    places = order.places[at].tolist()
    shared = order.shared[at].tolist()
    shared.append(0)
    out: list[tuple[int, int, int, int, int, int]] = []
    lengths, lows, firsts, lasts = [0], [0], [0], [0]  # the open states, each inside the one before
    top = 0
    for i, s in enumerate(shared):
        if s < least:
            if not top:
                continue
            s = 0
        low, first = i - 1, places[i - 1]
        last = first
        while top > s:
            length, low = lengths.pop(), lows.pop()
            f, l = firsts.pop(), lasts.pop()
            first, last = (f if f < first else first), (l if l > last else last)
            if i - low >= times:
                out.append((length, i - low, first, last, low, i))
            top = lengths[-1]
        if s:
            if top == s:
                if first < firsts[-1]:
                    firsts[-1] = first
                if last > lasts[-1]:
                    lasts[-1] = last
            else:
                lengths.append(s)
                lows.append(low)
                firsts.append(first)
                lasts.append(last)
                top = s
    length, count, first, last, low, high = np.array(out, np.int64).reshape(-1, 6).T
    return States(length, count, first, last, at[low], at[high - 1] + 1) if out else States(length, count, first, last, low, high)


def covered(n: int, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places covered by substrings of the given lengths that end at the given places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, end + 1 - length, 1)
    np.add.at(step, end + 1, -1)
    return np.cumsum(step[:n]) > 0
