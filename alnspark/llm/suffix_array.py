"""Suffix arrays by induced sorting.

Suffixes are of type S if smaller than the next one, else L; an S suffix after an L one is leftmost (LMS).
Sorting the LMS suffixes gives, in two linear passes, the whole array: going up, each placed suffix induces
the L suffix before it at its bucket's head; going down, the S suffix before it at its bucket's tail.  The LMS
substrings, each up to the next LMS place, are sorted by words of several symbols; their names make a text of at
most half the length.  Its suffix array, which orders the LMS suffixes, is made in the same way, until all names
differ.

A pass takes as many whole buckets at once as induce nothing within themselves: one in a text of bytes, more in
a text of names, which has more symbols.  Where numpy would get a few suffixes a call it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last symbol is the only one of its kind and the least."""
    n = len(text)
    s = np.ones(n, bool)
    if n > 1:
        step = np.flatnonzero(text[1:] != text[:-1])  # the last place of each run of equal symbols
        rise = text[step + 1] > text[step]
        s[: n - 1] = np.repeat(rise, np.diff(np.concatenate([[-1], step])))
    return s


#: Texts under this size with fewer suffixes a bucket than this are sorted suffix by suffix.
SMALL, NARROW = 1 << 17, 64


class _Buckets:
    def __init__(self, text: np.ndarray, symbols: int):
        self.count = np.bincount(text, minlength=symbols)
        self.end = np.cumsum(self.count)
        self.begin = self.end - self.count


def _deal(sa: np.ndarray, at: np.ndarray, symbol: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put suffixes of these first symbols, in order, at their buckets' edges and move these on."""
    if len(at) < 3:
        for a, c in zip(at.tolist(), symbol.tolist()):
            sa[edge[c]] = a
            edge[c] += step
        return
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    size = np.diff(np.append(first, len(symbol)))
    kinds = symbol[first]
    rank = np.arange(len(symbol)) - np.repeat(first, size)
    sa[np.repeat(edge[kinds], size) + step * rank] = at[order]
    edge[kinds] += step * size


def _induce_singly(text: np.ndarray, s: np.ndarray, lms: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """``induce`` without numpy."""
    symbol, falls = text.tolist(), (~s).tolist()
    sa = [-1] * len(symbol)
    tail = (buckets.end - 1).tolist()
    for i in lms[::-1].tolist():
        c = symbol[i]
        sa[tail[c]] = i
        tail[c] -= 1
    head = buckets.begin.tolist()
    for i in sa:  # what is placed ahead is met on the way
        if i > 0 and falls[i - 1]:
            c = symbol[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = (buckets.end - 1).tolist()
    for i in reversed(sa):
        if i > 0 and not falls[i - 1]:
            c = symbol[i - 1]
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(sa)


def induce(text: np.ndarray, s: np.ndarray, lms: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """The array in which LMS suffixes, given in an order, have induced the others."""
    n, symbols = len(text), len(buckets.count)
    if n < min(SMALL, NARROW * symbols):
        return _induce_singly(text, s, lms, buckets)
    begin, end = buckets.begin, buckets.end
    sa = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
    _deal(sa, lms[::-1], text[lms[::-1]], end - 1, -1)
    none = np.array([symbols], text.dtype)

    def induced(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in the batch suffixes induce others, these, and their first symbols."""
        symbol = into[batch]
        at = np.flatnonzero(symbol != symbols)
        return at, batch[at] - 1, symbol[at]

    into = np.concatenate([none, np.where(s[:-1], none, text[:-1]), none])  # the last is for places still empty, -1
    head = begin.copy()
    c, width = 0, 1
    while c < symbols:  # L suffixes, up
        stop = min(c + width, symbols)
        at, before, symbol = induced(sa[begin[c] : end[stop - 1]])
        if len(at) and symbol.min() < stop:
            stop = int(symbol.min())
        if stop > c:  # nothing falls into the buckets c ... stop - 1 any more
            cut = np.searchsorted(at, end[stop - 1] - begin[c])
            _deal(sa, before[:cut], symbol[:cut], head, 1)
        else:
            done, stop = begin[c], c + 1
            while done < head[c]:  # first the L suffixes, with those that they induce in their own bucket
                batch, done = sa[done : head[c]], head[c]
                _deal(sa, *induced(batch)[1:], head, 1)
            _deal(sa, *induced(sa[done : end[c]])[1:], head, 1)
        c, width = stop, 2 * (stop - c)
    into[1:n] = np.where(s[:-1], text[:-1], none)
    sa[np.arange(n) >= np.repeat(head, buckets.count)] = -1
    tail = end - 1
    c, width = symbols, 1
    while c > 0:  # S suffixes, down
        stop = max(c - width, 0)
        at, before, symbol = induced(sa[begin[stop] : end[c - 1]][::-1])
        if len(at) and symbol.max() >= stop:
            stop = int(symbol.max()) + 1
        if stop < c:
            cut = np.searchsorted(at, end[c - 1] - begin[stop])
            _deal(sa, before[:cut], symbol[:cut], tail, -1)
        else:
            done, stop = end[c - 1], c - 1
            while done > tail[stop] + 1:
                batch, done = sa[tail[stop] + 1 : done][::-1], tail[stop] + 1
                _deal(sa, *induced(batch)[1:], tail, -1)
            _deal(sa, *induced(sa[begin[stop] : done][::-1])[1:], tail, -1)
        c, width = stop, 2 * (c - stop)
    sa[0] = n - 1
    return sa


def _names(text: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of the LMS substrings in sorted order.  Those with equal numbers are equal; as whole words are
    compared, equal ones may differ behind their end, and then are in the order of what follows."""
    bits = (2 * symbols - 1).bit_length()
    per = 63 // bits
    value = np.concatenate([text.astype(np.int64) * 2 + s, np.zeros(per, np.int64)])  # of one symbol, L is less

    def word(at: np.ndarray) -> np.ndarray:
        out = value[at]
        for depth in range(1, per):
            out = out << bits | value[at + depth]
        return out

    size = np.diff(lms, append=lms[-1]) + 1
    key = word(lms)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    tied = np.arange(len(lms))
    depth = per
    while True:  # a group of equal beginnings ends together
        single = first[tied] & np.append(first[tied[1:]], True)
        tied = tied[~single & (size[order[tied]] > depth)]
        if not len(tied):
            break
        group = np.cumsum(first[tied])
        at = order[tied]
        key = word(lms[at] + depth)
        by = np.lexsort((key, group))
        order[tied], key = at[by], key[by]
        first[tied[1:]] |= key[1:] != key[:-1]
        depth += per
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(first) - 1
    return names


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """The suffix array of a text of names.  A name that occurs once needs no sorting, and ends every comparison:
    of such names the recursion only gets those that follow one that occurs again, and the last."""
    order = np.argsort(names, kind="stable")
    again = (np.bincount(names) > 1)[names]
    if again.any():
        kept = again.copy()
        kept[1:] |= again[:-1]
        kept[-1] = True
        at = np.flatnonzero(kept)
        used = np.zeros(len(names), bool)
        used[names[at]] = True
        number = np.cumsum(used) - 1
        deeper = at[suffix_array(number[names[at]], int(number[-1]) + 1)]
        order[again[order]] = deeper[again[deeper]]
    return order


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Of a text over 0 ... symbols - 1 whose last symbol is 0 and its only 0."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if symbols < 1 << 16:
        text = text.astype(np.uint16)  # numpy sorts 16-bit numbers by radix
    s = types(text)
    mark = s.copy()
    mark[0] = False
    mark[1:] &= ~s[:-1]
    lms = np.flatnonzero(mark)
    buckets = _Buckets(text, symbols)
    order = lms[_order_of_names(_names(text, s, lms, symbols))]
    return induce(text, s, order, buckets).astype(np.int64)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; places near the end see zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(np.uint64).ravel()


def shares_prefix(data: np.ndarray, sa: np.ndarray, length: int, room: np.ndarray) -> np.ndarray:
    """For each place of the text, whether its permuted common prefix (with the suffix before it in the array)
    is ``length`` or more; places with less ``room`` have none."""
    before = np.full(len(data), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero((room >= length) & (before >= 0))
    at = at[room[before[at]] >= length]
    eight = words_at(data)
    for depth in [*range(0, length - 7, 8), max(0, length - 8)] if length >= 8 else []:
        at = at[eight[at + depth] == eight[before[at] + depth]]
    if length < 8:
        for depth in range(length):
            at = at[data[at + depth] == data[before[at] + depth]]
    out = np.zeros(len(data), bool)
    out[at] = True
    return out
