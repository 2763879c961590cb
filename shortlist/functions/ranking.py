"""Rank statistics of many lists at once, in n log n: what tasks compute on the lists of one Arrow batch.

Lists lie one after the other in flat arrays, ``row`` says which list an element is of (ascending).  Nothing here looks at
all pairs, but for ``pair_sums``, whose sums have a term for each pair; that one goes in steps of bounded size.
"""

from __future__ import annotations

import numpy as np

#: Differences that one step of ``pair_sums`` holds.
STEP = 2_000_000


def dense_ranks(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A number from 0 for each element: equal for equal x of one list, ascending by (list, x)."""
    order = np.lexsort((x, row))
    new = np.ones(len(x), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (x[order][1:] != x[order][:-1])
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def average_ranks(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Ranks from 1 within each list, ties by their mean."""
    rank = dense_ranks(row, x)
    times = np.bincount(rank)
    upto = np.cumsum(times)
    before = np.r_[0, np.cumsum(np.bincount(row, minlength=n))][row]
    return upto[rank] - (times[rank] - 1) / 2 - before


def spearman(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Correlation of average ranks of each of n lists; NaN where one is constant."""
    size = np.bincount(row, minlength=n)
    middle = (size[row] + 1) / 2
    x, y = average_ranks(row, a, n) - middle, average_ranks(row, b, n) - middle
    total = lambda v: np.bincount(row, v, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return total(x * y) / np.sqrt(total(x * x) * total(y * y))


def inversions(rank: np.ndarray) -> np.ndarray:
    """For each element the number of earlier ones with a greater rank, bit by bit from the highest.

    At a bit, elements that agree in all higher ones stand together in their order; those with a 1 before one with a 0 are
    greater than it.
    """
    out = np.zeros(len(rank), np.int64)
    place = np.arange(len(rank))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        high, one = rank[place] >> (bit + 1), rank[place] >> bit & 1
        ones = np.cumsum(one) - one
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]][: len(high)])
        ahead = ones - np.repeat(ones[first], np.diff(np.r_[first, len(high)]))
        zero = one == 0
        out[place[zero]] += ahead[zero]
        place = place[np.argsort(high * 2 + one, kind="stable")]
    return out


def kendall(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Tau-b of each of n lists; NaN where one is constant.

    In the order of (a, b) a pair is discordant if b falls; concordant are those that are neither that nor tied.
    """
    pairs = lambda size: size * (size - 1) // 2
    order = np.lexsort((b, a, row))
    r, x, y = row[order], dense_ranks(row, a)[order], dense_ranks(row, b)[order]
    total = lambda v, of: np.bincount(of, v, minlength=n).astype(np.int64)
    tied = lambda code: total(pairs(np.bincount(code)), _list_of(code, r))
    both = dense_ranks(x, y)
    every = pairs(np.bincount(row, minlength=n))
    tx, ty, txy = (tied(c) if len(r) else every for c in (x, y, both))
    down = total(inversions(y), r) if len(r) else every
    with np.errstate(invalid="ignore", divide="ignore"):
        return (every - tx - ty + txy - 2 * down) / (np.sqrt((every - tx).astype(np.float64)) * np.sqrt((every - ty).astype(np.float64)))


def _list_of(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The list of each code (all elements with one code are of one list)."""
    out = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
    out[code] = row
    return out


def fewer_before(rank: np.ndarray, first: np.ndarray, end: np.ndarray, than: np.ndarray) -> np.ndarray:
    """For each question the number of elements of ``rank[first:end]`` that are smaller than ``than``, bit by bit from the highest.

    At each bit the elements with a 0 go before those with a 1; a question about a 1 counts the zeros of its range and
    follows the ones, else it follows the zeros.
    """
    out, a, b, now = np.zeros(len(first), np.int64), first.copy(), end.copy(), rank
    for bit in range(int(max(rank.max(initial=0), than.max(initial=0))).bit_length() - 1, -1, -1):
        one = now >> bit & 1
        zeros = np.r_[0, np.cumsum(1 - one)]
        za, zb, up = zeros[a], zeros[b], than >> bit & 1 == 1
        out += np.where(up, zb - za, 0)
        a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        now = np.concatenate([now[one == 0], now[one == 1]])
    return out


def ordered_pairs(row: np.ndarray, score: np.ndarray, target: np.ndarray, gap: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n lists the number of pairs whose targets differ by more than ``gap``, and of those that the scores order alike."""
    order = np.lexsort((target, row))
    row, score, target = row[order], score[order], target[order]
    begin = np.searchsorted(row, np.arange(n))[row]
    # Targets ascend in a list, so the elements that are smaller by more than the gap come first; where they end, by bisection.
    low, high = begin.copy(), np.arange(len(row))
    while (low < high).any():
        middle = (low + high) // 2
        far = (low < high) & (target - target[np.minimum(middle, len(row) - 1)] > gap)
        high = np.where((low < high) & ~far, middle, high)
        low = np.where(far, middle + 1, low)
    pairs = low - begin
    right = fewer_before(dense_ranks(row, score), begin, low, dense_ranks(row, score))
    return np.bincount(row, pairs, minlength=n).astype(np.int64), np.bincount(row, right, minlength=n).astype(np.int64)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def pair_blocks(row: np.ndarray, n: int):
    """(i, j) of all pairs i < j of places within a list, in steps of about ``STEP`` (a step takes one element's partners at least)."""
    end = np.searchsorted(row, np.arange(n), "right")[row]
    partners = end - np.arange(len(row)) - 1
    upto = np.r_[0, np.cumsum(partners)]
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP, "right")) - 1)
        some = partners[at:to]
        i = np.repeat(np.arange(at, to), some)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], some)
        at = to
