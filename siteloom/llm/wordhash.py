"""Words and their hashes over many texts at once, by numpy.

A word's hash is the sum of v(byte) * P^i over its bytes, modulo 2^64, from differences of one running sum; a window's hash is
built in the same way over the mixed hashes of its words. All are functions of the bytes alone, alike on every executor.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at once; a longer text is taken alone.
CHUNK = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Family:
    """One hash function: byte values, base for bytes, base for words."""

    def __init__(self, seed: int):
        r = mix(np.arange(1, 259, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
        self.values = r[:256]
        # Bases are 3 modulo 4, so that base - 1 is only once even and swapped items differ.
        self.bases = [int(x) | 3 for x in r[256:]]
        self._powers: dict[int, np.ndarray] = {}

    def _power(self, base: int, n: int) -> np.ndarray:
        had = self._powers.get(base)
        if had is None or len(had) < n:
            full = np.full(max(n, CHUNK + 64), U(base), dtype=U)
            full[0] = 1
            had = np.multiply.accumulate(full)
            if n <= 4 * CHUNK:
                self._powers[base] = had
        return had[:n]

    def _runs(self, values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * self._power(base, n), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self._power(pow(base, -1, 1 << 64), n)[np.minimum(starts, n - 1)])

    def words(self, t: Texts) -> np.ndarray:
        if not len(t.starts):
            return np.zeros(0, dtype=U)
        return self._runs(self.values[t.bytes], self.bases[0], t.starts, t.ends) + (t.ends - t.starts).astype(U)

    def windows(self, word_hashes: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
        """The hash of the k words from each of starts."""
        if not len(starts):
            return np.zeros(0, dtype=U)
        return self._runs(word_hashes, self.bases[1], starts, starts + k)

    def spans(self, word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(word_hashes):
            return np.zeros(len(starts), dtype=U)
        return self._runs(word_hashes, self.bases[1], starts, ends)


class Texts:
    """Some texts and where their words lie: word w is bytes[starts[w]:ends[w]]; text d has words first[d] to first[d + 1]."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buffer = b" " + b" ".join(texts) + b" "
        self.bytes = np.frombuffer(self.buffer, dtype=np.uint8)
        inside = ~_SPACE[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        begins = 1 + np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def full(self, k: int) -> np.ndarray:
        """The words at which a window of k words of one text starts."""
        w = np.arange(len(self.starts))
        return w[w + k <= self.first[self.doc + 1]]


def give_back() -> None:
    """At a task's end: return freed memory to the system, as Python workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts in UTF-8) in pieces of about limit bytes; a null text is empty."""
    at, size, part = 0, 0, []
    for i, x in enumerate(texts):
        b = b"" if x is None else x if isinstance(x, bytes) else x.encode()
        if part and size + len(b) > limit:
            yield at, i, part
            at, size, part = i, 0, []
        part.append(b)
        size += len(b) + 1
    if part:
        yield at, at + len(part), part
