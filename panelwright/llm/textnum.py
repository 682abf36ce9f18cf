"""Vectorised word kernels over UTF-8 text: word bounds, rolling hashes and sliding minima.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which is what ``bytes.split()`` cuts.
Documents are handled in pieces of about a MB, so memory follows the longest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * PIECE_BYTES:
            return tables  # one very long document: not kept
        _powers = tables
    return _powers


class Words:
    """The words of several documents in one buffer, single spaces between them.

    ``start`` and ``end`` are byte bounds of each word, ``doc`` its document's index, ``first`` the index of
    each document's first word (with a last entry for the total).
    """

    def __init__(self, texts: list[bytes]):
        norm = [b" ".join(t.split()) for t in texts]
        self.norm = norm
        counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in norm), np.int64, len(norm))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.bytes = b" ".join(t for t in norm if t)
        self.buf = np.frombuffer(self.bytes, np.uint8)
        spaces = np.flatnonzero(self.buf == 32)
        self.n = int(self.first[-1])
        self.start = np.concatenate([[0], spaces + 1]) if self.n else np.zeros(0, np.int64)
        self.end = np.concatenate([spaces, [len(self.buf)]]) if self.n else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(norm)), counts)
        self._sums: np.ndarray | None = None

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each position on, and whether they lie in one document."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=self._sums[1:])
        a, b = self.start[:m], self.end[k - 1 :]
        return mix((self._sums[b] - self._sums[a]) * down[a]), self.doc[:m] == self.doc[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    if len(x) < w:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    if span < w:
        gap = w - span
        x = np.minimum(x[: len(x) - gap], x[gap:])
    return x


def pieces(rows: Iterable[tuple[int, bytes]], limit: int = PIECE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of about ``limit`` bytes each; one longer text makes a piece of its own."""
    keys: list = []
    texts: list[bytes] = []
    size = 0
    for key, text in rows:
        if texts and size + len(text) > limit:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if texts:
        yield keys, texts


def rows_of(batch, key: str, text: str) -> Iterator[tuple[int, bytes]]:
    """(key, UTF-8 bytes) of an Arrow batch; a null text counts as empty."""
    import pyarrow as pa

    texts = batch.column(text).cast(pa.binary())
    for k, t in zip(batch.column(key).to_pylist(), texts, strict=True):
        yield k, t.as_py() or b""
