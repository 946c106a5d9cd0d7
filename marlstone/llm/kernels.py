"""numpy kernels on whole Arrow batches of text: byte buffers, hashed words, rolling fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial fingerprint and the mixing steps.
BASE, MIX_1, MIX_2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * MIX_1
    x = (x ^ (x >> U64(27))) * MIX_2
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, U64)
        with np.errstate(over="ignore"):
            done, step = 1, base
            while done < size:
                more = min(done, size - done)
                have[done : done + more] = have[:more] * step
                done, step = done + more, step * step
        _powers[int(base)] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets of n+1 entries); null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Rolling:
    """Fingerprints of any substring of a byte buffer in constant time, from sums of powers modulo 2**64.

    The multiplier's inverse makes a fingerprint independent of its position. Strings of a few
    hundred bytes are far below the length at which such sums modulo 2**64 collide by construction.
    """

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(n, base), out=self.sums[1:])
        self.back = powers(n + 1, U64(pow(int(base), -1, 1 << 64)))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Of each substring of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[length:] - self.sums[:-length]) * self.back[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window, from block-wise running minima in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, x.dtype)
    if width == 1:
        return x
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes of one non-zero kind; no run spans two texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = kind[data]
    change = np.ones(n + 1, bool)
    np.not_equal(k[1:], k[:-1], out=change[1:n])
    change[offsets] = True
    edges = np.flatnonzero(change)
    inside = k[edges[:-1]] != 0
    return edges[:-1][inside], edges[1:][inside]


def hashed_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z as a-z, and the offsets of each text's words."""
    starts, ends = word_spans(data, offsets, kind)
    return Rolling(lower_table()[data]).at(starts, ends), np.searchsorted(starts, offsets)


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; position i stands for words i .. i+n-1."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = np.zeros(size, U64)
    for k in range(n):
        out = mix(out * BASE + words[k : k + size] + U64(k + 1))
    return out


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each entry, and its place in the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return run, np.arange(len(run)) - first[run]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Kinds of bytes for word_spans: all but ASCII white space; digits, letters and all beyond ASCII; these and
#: runs of other visible characters as words of their own.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[32, *range(9, 14)]] = 0
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
WORDS_AND_MARKS = np.where(WORD_BYTES == 1, 1, np.where(NOT_SPACE == 1, 2, 0)).astype(np.uint8)
WORDS_AND_MARKS[:32] = 0
