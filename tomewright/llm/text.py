"""Vectorised tokenising and hashing of whole batches of texts.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. Word hashes are polynomials of the UTF-8 bytes modulo 2**64,
mixed afterwards; all words of a batch are hashed by prefix sums, without a
Python step per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CHUNK_BYTES = 1_000_000


def trim() -> None:
    """Gives memory that isn't used any more back to the system, as Python workers live on after their tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def lean(run):
    """A function over a task's batches that trims memory after each of them."""

    def each(batches):
        for batch in batches:
            yield batch
            del batch
            trim()

    def trimmed(batches):
        try:
            yield from run(each(batches))
        finally:
            trim()

    return trimmed


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, store: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if store.get("n", 0) < n:
        n = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        store.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return store["up"], store["down"]


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Words:
    """Words of a list of texts.

    hashes: one value a word; first, last: byte range of each word in data;
    bounds: words of text i are bounds[i]:bounds[i+1]; offsets: bytes of text i
    start at offsets[i].
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.data = data
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        table = np.zeros(256, bool)
        table[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        inside = table[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.first, self.last = edge[0::2], edge[1::2]
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self._sums[1:])
        self.hashes = self.hash_of(self.first, self.last)
        self.bounds = np.searchsorted(self.first, self.offsets)

    def hash_of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._sums[last] - self._sums[first]) * self._down[first])


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` characters; a longer text is one range."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + hashes[j : j + m]
    return mix(out)


class RunHash:
    """Hashes of arbitrary runs of a sequence of values, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        up, self._down = _powers(len(hashes) + 1)
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self._sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        length = (np.asarray(last) - np.asarray(first)).astype(np.uint64)
        return mix((self._sums[last] - self._sums[first]) * self._down[first] + length * np.uint64(MIX_B))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
