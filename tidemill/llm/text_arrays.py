"""Words, word hashes and shingle hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Hashes are 64-bit polynomials taken as
differences of prefix sums, so that a whole batch costs a few passes over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(int(base), done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        if size <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray, inverse: np.uint64) -> np.ndarray:
    return (prefix[hi] - prefix[lo]) * powers(inverse, len(prefix))[lo]


def prefix_sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


class Words:
    """Words of a batch: starts and ends are byte positions in buf; row r has words lo[r] to hi[r]."""

    def __init__(self, texts: pa.Array, byte_map: np.ndarray | None = None):
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if byte_map is not None:
            buf = byte_map[buf]
        self.buf, self.offsets = buf, offsets
        word = ~SPACE[buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(buf))]
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        at = np.searchsorted(self.starts, offsets)
        self.lo, self.hi = at[:-1], at[1:]

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit value for each word."""
        p = prefix_sums(self.buf.astype(np.uint64) + np.uint64(1), _BASE)
        lengths = (self.ends - self.starts).astype(np.uint64)
        return mix(span_hash(p, self.starts, self.ends, _INVERSE) + lengths * np.uint64(0x632BE59BD9B4E019))

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and the byte position of each word (and of the end)."""
        lengths = self.ends - self.starts
        at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        out = np.full(int(at[-1]), 32, np.uint8)
        inside = ~SPACE[self.buf]
        where = np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
        out[where] = self.buf[inside]
        return out.tobytes(), at


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (rows are not told apart; take only windows that lie in one)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    p = prefix_sums(hashes, _WORD_BASE)
    n = len(hashes) - k + 1
    return mix((p[k:] - p[:-k]) * powers(_WORD_INVERSE, n))


def window_starts(lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of k words of one row starts, and the number of them in each row."""
    counts = np.maximum(hi - lo - k + 1, 0)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) + np.repeat(lo - first, counts), counts
