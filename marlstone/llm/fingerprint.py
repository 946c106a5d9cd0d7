"""Document fingerprints from the quartiles of bucket counts.

A digest has a length code, two quartile ratios, and two bits for each of 128 buckets that say in
which quartile the bucket's count of hashed byte triplets lies. Small edits move few buckets across
a quartile, so digests of similar texts differ in few bits. ``difference`` sums bounded penalties;
``likeness`` maps it to 0..1, and equal digests to 1.

Digests are 68 lowercase hex digits. Texts under three bytes have no triplets and differ by length
only. Null counts as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm.common import add_columns
from marlstone.llm.kernels import text_bytes

BUCKETS = 128
#: Offsets of the triplets that start at a byte, and the odd multiplier that hashes each kind.
TRIPLETS = (((0, 1, 2), 0x9E3779B1), ((0, 1, 3), 0x85EBCA77), ((0, 2, 3), 0xC2B2AE3D))
#: Differences count up to this; 0 means alike, this or more unlike.
BOUND = 400
#: Bytes that are counted at once, so that temporary arrays stay small.
SLICE = 1 << 20


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) counts; triplets never cross texts."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        lo, ends = offsets[first], offsets[first : last + 1]
        part = data[lo : ends[-1]].astype(np.uint32)
        owner = np.repeat(np.arange(last - first), np.diff(ends))
        for (a, b, c), factor in TRIPLETS:
            if (size := len(part) - c) > 0:
                whole = owner[:size] == owner[c:]
                key = (part[a : a + size] | part[b : b + size] << np.uint32(8) | part[c:] << np.uint32(16)) * np.uint32(factor) >> np.uint32(25)
                out[first:last] += np.bincount((owner[:size] * BUCKETS + key)[whole], minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS)
        first = last
    return out


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 34) bytes: length code, two quartile ratios in a byte, 32 bytes of bucket codes."""
    counts = bucket_counts(data, offsets)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, k * BUCKETS // 4 - 1] for k in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    out = np.zeros((len(counts), 34), np.uint8)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(np.diff(offsets)) * 10))
    safe = np.maximum(q3, 1)
    out[:, 1] = (q1 * 15 // safe).astype(np.uint8) << 4 | (q2 * 15 // safe).astype(np.uint8)
    packed = codes.reshape(-1, 32, 4)
    out[:, 2:] = packed[:, :, 0] << 6 | packed[:, :, 1] << 4 | packed[:, :, 2] << 2 | packed[:, :, 3]
    return out


def hex_of(digest: np.ndarray) -> list[str]:
    return [bytes(row).hex() for row in digest]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row: 0 for equal ones, BOUND at most."""
    length = np.abs(a[:, 0].astype(np.int64) - b[:, 0])
    total = np.where(length <= 1, length, np.minimum(60, 4 * length))
    for shift in (4, 0):
        ratio = np.abs((a[:, 1].astype(np.int64) >> shift & 15) - (b[:, 1].astype(np.int64) >> shift & 15))
        total += np.where(ratio <= 1, ratio, np.minimum(30, 4 * (ratio - 1)))
    apart = np.zeros(len(a), np.int64)
    for shift in (6, 4, 2, 0):
        d = np.abs((a[:, 2:] >> shift & 3).astype(np.int64) - (b[:, 2:] >> shift & 3))
        apart += np.where(d == 3, 6, d).sum(axis=1)
    return np.minimum(BOUND, total + apart)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (BOUND - difference(a, b)) / BOUND


def parsed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(-1, 34)


def with_fingerprint(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """docs with the digest of every whole text."""
    return add_columns(docs, [T.StructField(fingerprint, T.StringType())], lambda batch: [pa.array(hex_of(digests(*text_bytes(batch.column(text)))), pa.string())])


def with_likeness(pairs: DataFrame, a: str, b: str, out: str = "likeness") -> DataFrame:
    """Pairs of digests with their likeness; null where either is null."""

    def compute(batch: pa.RecordBatch) -> list:
        x, y = batch.column(a), batch.column(b)
        none = np.array(x.is_null()) | np.array(y.is_null())
        blank = "0" * 68
        return [pa.array(likeness(parsed(x.fill_null(blank)), parsed(y.fill_null(blank))), pa.float64(), mask=none)]

    return add_columns(pairs, [T.StructField(out, T.DoubleType())], compute)
