"""Vectorised word and window hashes of many texts at once (numpy inside tasks).

A short word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums, so it costs one
subtraction and one product.  Such polynomials have known collisions from 1024 symbols on (Thue-Morse words and
their complements, for every odd base), and lose bits on shorter words of that shape; so a word of more than
``LONG`` bytes takes its hash from BLAKE2b, and a window of words is a polynomial over the mixed hashes of its
neighbouring pairs, which such words do not cancel.  Two streams make 128 bits where a hash stands for
the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

U = np.uint64
BLOCK = 1 << 18
LONG = 48
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


@cache
def _byte_codes(stream: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASES[stream]) + U(stream + 1))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(stream: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 ... base**(n-1), or of the base's inverse modulo 2**64."""
    held = _powers.get((stream, inverse))
    if held is None or len(held) < n:
        base = pow(BASES[stream], -1, 1 << 64) if inverse else BASES[stream]
        held = np.full(max(n, BLOCK + 2), U(base))
        held[0] = 1
        held = _powers[stream, inverse] = np.multiply.accumulate(held)
    return held[:n]


def table_of(pattern_excluded: Iterable[int]) -> np.ndarray:
    held = np.ones(256, bool)
    held[list(pattern_excluded)] = False
    return held


#: Words are runs of bytes that are no ASCII space, or runs of ASCII letters, digits and other scripts' bytes.
NOT_SPACE = table_of([0x20, *range(0x09, 0x0E)])
ALNUM = table_of([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LETTERS = table_of([*range(0x00, 0x61), *range(0x7B, 0x80)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


class Words:
    """The words of a list of texts.  ``first`` has each text's first word and, at the end, the number of words."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, fold: bool, streams: int = 2, prefixes: tuple[int, ...] = ()):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = joined
        data = _FOLD[joined] if fold else joined
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        mask = is_word[data]
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if mask[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # the last byte is no word's
        self.hash = [np.empty(len(self.start), U) for _ in range(streams)]
        self.prefix = {k: np.zeros(len(self.start), U) for k in prefixes}
        a = 0
        while a < len(self.start):
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + BLOCK, side="right")))
            self._block(data, a, b, streams, prefixes)
            a = b
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _block(self, data: np.ndarray, a: int, b: int, streams: int, prefixes: tuple[int, ...]) -> None:
        lo, hi = int(self.start[a]), int(self.end[b - 1])
        s, e = self.start[a:b] - lo, self.end[a:b] - lo
        for k in range(streams):
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(_byte_codes(k)[data[lo:hi]] * powers(k, hi - lo), out=sums[1:])
            back = powers(k, hi - lo + 1, True)
            self.hash[k][a:b] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(U))
            if k == 0:
                for n in prefixes:
                    long = e - s > n
                    cut = s[long]
                    self.prefix[n][a:b][long] = mix((sums[cut + n] - sums[cut]) * back[cut] ^ U(n << 32))
        for i in np.flatnonzero(e - s > LONG):
            digest = np.frombuffer(hashlib.blake2b(data[lo + s[i] : lo + e[i]], digest_size=16).digest(), "<u8")
            for k in range(streams):
                self.hash[k][a + i] = digest[k]

    def windows(self, k: int, streams: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
        """(valid, hashes): for each word, whether ``k`` words of its text start there, and their hash."""
        n = len(self.start)
        if n < k:
            return np.zeros(n, bool), [np.zeros(n, U) for _ in range(streams)]
        valid = np.zeros(n, bool)
        valid[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return valid, [window_hash(self.hash[s], k, s) for s in range(streams)]


def window_hash(values: np.ndarray, k: int, stream: int) -> np.ndarray:
    """The hash of ``k`` values from each place; zeros where fewer are left."""
    out, n = np.zeros(len(values), U), len(values)
    for lo in range(0, n - k + 1, BLOCK):  # blocks keep the tables of powers small
        part = values[lo : lo + BLOCK + k - 1]
        m = len(part) - k + 1
        if k > 1:
            part = mix(part[:-1] * U(BASES[1 - stream]) + (part[1:] ^ (part[1:] >> U(29))))
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers(stream, len(part)), out=sums[1:])
        pairs = max(1, k - 1)
        out[lo : lo + m] = mix((sums[pairs : pairs + m] - sums[:m]) * powers(stream, m, True) + U(k))
    return out


def group_starts(values: np.ndarray) -> np.ndarray:
    """The first places of equal neighbours."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def running_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of ``w`` values from each place (of what is left, near the end), in log(w) steps."""
    out, span = values.copy(), 1
    while span < w:
        step = min(span, w - span)
        out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out


def running_max(values: np.ndarray, w: int) -> np.ndarray:
    """The greatest of ``w`` values up to each place (of what there is, near the start)."""
    return ~running_min(~values[::-1], w)[::-1]


def chunks(texts: Iterable[str | None], most: int = 2 * BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8) in groups of about ``most`` bytes; a longer text stands alone."""
    group: list[bytes] = []
    begin = size = i = 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if group and size + len(data) > most:
            yield begin, group
            group, begin, size = [], i, 0
        group.append(data)
        size += len(data)
    if group:
        yield begin, group
