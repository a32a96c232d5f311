"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of a batch.

A word is ``[^\\x20\\x09-\\x0D]+``. Its 64-bit hash is a polynomial over its bytes, finished with a
mixer; a word of over 64 bytes is hashed by xxhash, as polynomials modulo 2**64 have collisions
among long periodic strings.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes other than those that continue a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LONG = 64


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), U(base), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose result bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a batch of texts: bounds in ``data``, hashes, and each text's range of words."""

    def __init__(self, texts: list[str] | list[bytes], lower: bool = False):
        raws = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
        self.data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        #: Where each text starts in data; its end is one before the next start.
        self.text_starts = np.cumsum([0, *(len(r) + 1 for r in raws)])
        space = SPACE[self.data]
        inside = np.concatenate([[False], ~space])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edges) % 2:
            edges = np.append(edges, len(self.data))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: Words of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.hashes = self._hashes(space)

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        salted = _SALT[self.data]
        salted[space] = 0
        salted *= powers(_BASE, len(self.data))
        sums = np.add.reduceat(salted, self.starts) * powers(_INVERSE, len(self.data))[self.starts]
        size = self.ends - self.starts
        out = mix(sums + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and each text's range of them: a text with
        fewer words, but one at least, has one run of all its words."""
        count = np.diff(self.first)
        runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(runs)])
        total = int(bounds[-1])
        if not total:
            return np.zeros(0, np.uint64), bounds
        owner = np.repeat(np.arange(len(count)), runs)
        at = self.first[:-1][owner] + np.arange(total) - bounds[:-1][owner]
        padded = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
        out = np.zeros(total, np.uint64)
        length = np.minimum(count[owner], n)
        for j in range(n):
            part = mix(padded[at + j] + U((j + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
            out = (out * U(0xC6BC279692B5C323)) + np.where(j < length, part, U(0))
        return mix(out + length.astype(np.uint64)), bounds
