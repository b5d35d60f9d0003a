"""Word hashes of whole texts with numpy, a block of texts at a time.

Texts are joined into one byte array per block (a block closes at ``BLOCK`` bytes; one longer text
is a block of its own), so no Python code runs per word. Every byte maps to a random 64-bit value;
a word is the polynomial of these values, which a running sum gives for all words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
#: An odd base, and the finalizer constants of SplitMix64.
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte tables of what is part of a word. UTF-8 keeps all bytes of other characters above 0x7F.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[0x30:0x3A] = LETTERS_DIGITS[0x61:0x7B] = LETTERS_DIGITS[0x80:] = True


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(factor))
            steps[0] = 1
            setattr(self, name, np.cumprod(steps))


class Words:
    """The words of a block: hash, text number, and byte range in ``data`` (lower-cased)."""

    def __init__(self, texts: list[bytes], table: np.ndarray, powers: Powers) -> None:
        self.data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        inside = table[self.data]
        edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        total = self.running(powers)
        self.hash = mix((total[self.end] - total[self.start]) * powers.down[self.start]
                        + (self.end - self.start).astype(np.uint64))
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, self.text_start)

    def running(self, powers: Powers) -> np.ndarray:
        """Running sums of the bytes' values times powers: two of them differ by a stretch of bytes."""
        powers.grow(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers.up[:len(self.data)], out=total[1:])
        return total

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ones lap into other texts."""
        n = len(self.hash)
        out = np.full(n, np.uint64(size))
        for k in range(size):
            out[:n - k] += mix(self.hash[k:] + np.uint64((_BASE * (k + 1)) & _MASK))
        return mix(out)


def blocks(texts: list[bytes | None], limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes with the number of their first one; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def as_bytes(column) -> list[bytes | None]:
    """Values of an Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
