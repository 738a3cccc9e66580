"""Suffix arrays of many short stretches at once, by prefix doubling on arrays."""

from __future__ import annotations

import numpy as np


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The stretches end to end, each followed by one place for its end mark, and the places of the end marks."""
    sizes = np.array([len(x) for x in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    whole = np.zeros(int(ends[-1]) + 1, parts[0].dtype)
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = np.concatenate(parts)
    return whole, ends


#: Bytes that a key holds, of nine bits each.
KEY_BYTES = 7


def _rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    order = np.argsort(keys)  # the order of equal keys doesn't matter: ranks tell nothing of it, and in the end none are equal
    return _ranked(keys[order], order)


def _ranked(keys: np.ndarray, order: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ranks of sorted keys; those that are `apart` have one each."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    if apart is not None:
        new |= apart
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order, bool(new.all())


def byte_keys(whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the next KEY_BYTES bytes as one number, zeros from the end mark on, and whether there is none among them."""
    units = np.zeros(len(whole) + KEY_BYTES, np.int64)
    units[: len(whole)] = whole
    units[: len(whole)] += 1
    units[ends] = 0
    keys, open_ = np.zeros(len(whole), np.int64), np.ones(len(whole), bool)
    for j in range(KEY_BYTES):
        unit = units[j : j + len(whole)]
        open_ &= unit > 0
        keys <<= 9
        keys |= np.where(open_, unit, 0)
    return keys, open_


def _first_bytes(whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ranks of all suffixes by their first KEY_BYTES bytes; a suffix that ends before has a rank of its own."""
    keys, open_ = byte_keys(whole, ends)
    order = np.argsort(keys, kind="stable")  # suffixes that are equal up to their end marks follow each other as these do
    return _ranked(keys[order], order, ~open_[order])


def suffix_array(whole: np.ndarray, ends: np.ndarray, depths: tuple[int, ...] = ()) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Order of all suffixes, and the ranks by the first 2**k units that `depths` asks for.

    End marks are smaller than all units and differ from each other (an earlier one is smaller), so no two suffixes are
    equal and none matches past the end of its stretch.
    """
    n = len(whole)
    end_of = ends[np.searchsorted(ends, np.arange(n))]
    if whole.dtype == np.uint8 and not depths:
        (rank, order, done), h = _first_bytes(whole, ends), KEY_BYTES
    else:
        first = np.unique(whole, return_inverse=True)[1].astype(np.int64) + len(ends)
        first[ends] = np.arange(len(ends))
        (rank, order, done), h = _rank(first), 1
    kept = {1: rank} if 1 in depths else {}
    while not done or (depths and h < max(depths)):
        after = np.minimum(np.arange(n) + h, end_of)
        rank, order, done = _rank(rank.astype(np.uint64) << np.uint64(32) | rank[after].astype(np.uint64))
        h *= 2
        if h in depths:
            kept[h] = rank
    return order, kept
