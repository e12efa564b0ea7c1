"""Suffix arrays, common prefixes and merging of sorted strings, for one array of bytes."""

from __future__ import annotations

import numpy as np

# Symbols of 9 bits (byte + 1; 0 past the end) in one 63-bit word.
_WIDTH = 7
NONE = np.iinfo(np.int64).max


def _words(data: np.ndarray) -> np.ndarray:
    """The first seven symbols of every suffix, and a zero for the empty one."""
    symbols = np.zeros(len(data) + _WIDTH, np.int64)
    symbols[: len(data)] = data
    symbols[: len(data)] += 1
    words = np.zeros(len(data) + 1, np.int64)
    for i in range(_WIDTH):
        words = (words << 9) | symbols[i : i + len(words)]
    return words


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, first words) by Larsson-Sadakane refinement.

    Suffixes are sorted by their first word; groups of equal ones are then sorted by
    the rank of the suffix that follows the part already compared, which doubles each
    time.  Suffixes that stand alone are not touched again.
    """
    n = len(data)
    words = _words(data)
    order = np.argsort(words[:n])
    sorted_words = words[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_words[1:] != sorted_words[:-1])))[:n]
    size = np.diff(np.append(first, n))
    rank = np.zeros(n + 1, np.int64)  # 1 + place of the group's first suffix; 0 past the end
    rank[order] = np.repeat(first + 1, size)
    active = np.flatnonzero(np.repeat(size > 1, size))
    done = _WIDTH
    while len(active):
        suffix = order[active]
        group = rank[suffix]
        key = (group << 31) | rank[np.minimum(suffix + done, n)]
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[active] = suffix
        start = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(active)))
        rank[suffix] = np.repeat(active[first] + 1, size)
        active = active[np.repeat(size > 1, size)]
        done *= 2
    return order, words


def common_prefixes(data: np.ndarray, order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it, in suffix order.

    Going through the text, a suffix loses at most one symbol of its predecessor's
    common prefix.  It loses exactly one where the letters before the two suffixes
    agree; only elsewhere are letters compared.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    compared = (before <= 0) | (place == 0)
    compared[1:] |= data[:-1] != data[np.maximum(before[1:], 1) - 1]
    length = np.zeros(n, np.int64)
    left = np.flatnonzero(compared & (before >= 0))
    other = before[left]
    at = np.zeros(len(left), np.int64)
    while len(left):
        x = words[np.minimum(left + at, n)]
        y = words[np.minimum(other + at, n)]
        differ = x ^ y
        same = differ == 0
        # The highest differing symbol tells how many of the seven agree.
        top = np.frexp(differ[~same].astype(np.float64))[1]
        length[left[~same]] = at[~same] + (_WIDTH * 9 - top) // 9
        left, other, at = left[same], other[same], at[same] + _WIDTH
    last = np.maximum.accumulate(np.where(compared, place, 0))
    return (length[last] - (place - last))[order]


def least_owner(
    data: np.ndarray, owner: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest owner of each string of ``size`` bytes.

    ``owner`` has NONE where no string starts.  Returns the least owner at each place,
    and of the distinct strings in order: a place, the least owner, the class of each
    place (-1 where no string starts).
    """
    order, words = suffix_array(data)
    prefix = common_prefixes(data, order, words)
    start = np.flatnonzero(np.concatenate(([True], prefix[1:] < size)))
    least = np.minimum.reduceat(owner[order], start)
    length = np.diff(np.append(start, len(order)))
    by_place = np.empty(len(data), np.int64)
    by_place[order] = np.repeat(np.arange(len(start)), length)
    # A class counts if a string starts at one of its suffixes; one such place stands for it.
    real = np.flatnonzero(least != NONE)
    number = np.full(len(start), -1, np.int64)
    number[real] = np.arange(len(real))
    classes = np.where(owner != NONE, number[by_place], -1)
    places = np.zeros(len(real), np.int64)
    starts = np.flatnonzero(classes >= 0)
    places[classes[starts]] = starts
    return np.where(classes >= 0, least[by_place], NONE), places, least[real], classes


def merge_least(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Least owners over several sorted lists of distinct strings, found by binary search."""
    merged = [least.copy() for _, least in parts]
    for i, (keys, _) in enumerate(parts):
        for j, (others, theirs) in enumerate(parts):
            if i == j or not len(keys) or not len(others):
                continue
            at = np.minimum(np.searchsorted(others, keys), len(others) - 1)
            hit = others[at] == keys
            merged[i][hit] = np.minimum(merged[i][hit], theirs[at[hit]])
    return merged
