"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai's common prefixes, and runs of equal windows."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of text in order.

    Larsson-Sadakane: suffixes are first sorted by eight bytes; then only the groups that are still unsorted are refined, by
    the rank of the suffix that starts as far behind as the order already reaches, which doubles each time.
    """
    n = len(text)
    key = leading_words(text, 0)
    order = np.argsort(key)
    s = key[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is known by its first place in the order
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = 8
    while True:
        places = np.flatnonzero(~(new & np.append(new[1:], True)))  # of groups of more than one suffix
        if not len(places):
            return order
        suffixes = order[places]
        behind = suffixes + reach
        # Of suffixes that end within reach, which are equal so far, the shorter goes first.
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + reach + 1, n - suffixes)
        head = group[places]
        both = head * (n + reach + 2) + second
        sub = np.argsort(both)
        order[places] = suffixes[sub]
        both = both[sub]
        fresh = np.ones(len(places), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[places] = fresh
        group[places] = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[order[places]] = group[places]
        reach *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in the order, up to ``most``; [i] is for the i-th in order.

    Kasai's bound, that the common prefix shrinks by one at most from a place to the next, carries the length along each lane
    [starts, ends) of the text; the lanes advance side by side.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    words = leading_words(text, most + 8)  # eight bytes at a time
    bytes_equal = [np.uint64(1) << np.uint64(8 * k) for k in range(1, 8)]
    length = np.zeros(len(starts), np.int64)
    for step in range(int((ends - starts).max(initial=0))):
        lanes = np.flatnonzero(starts + step < ends)
        i = starts[lanes] + step
        at = place[i]
        j = order[np.maximum(at - 1, 0)]
        h = np.where(at > 0, np.maximum(length[lanes] - 1, 0), 0)
        active = np.flatnonzero((at > 0) & (h < most))
        while len(active):
            differ = words[i[active] + h[active]] ^ words[j[active] + h[active]]
            for limit in bytes_equal:
                h[active] += differ < limit
            whole = differ == 0
            h[active] += whole
            active = active[whole & (h[active] < most)]
        h = np.minimum(np.minimum(h, most), n - np.maximum(i, j))
        length[lanes] = h
        lcp[at] = h
    return lcp


def leading_words(text: np.ndarray, pad: int = 8) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number; pad: places beyond the end that are wanted, too."""
    padded = np.zeros(len(text) + pad + 8, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + pad].copy().view(">u8").ravel().astype(np.uint64)


def window_classes(order: np.ndarray, lcp: np.ndarray, window: int) -> np.ndarray:
    """A class number for each place of the text: suffixes in a run of common prefixes of the window's length share one."""
    classes = np.empty(len(order), np.int64)
    classes[order] = np.cumsum(lcp < window)
    return classes
