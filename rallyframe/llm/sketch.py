"""Word shingles and fast similarity sketches, vectorised over Arrow batches.

Documents are lower-cased (A-Z) and cut at ASCII white space. All words of a
batch are hashed together: a word's hash is a polynomial over its bytes, taken
from prefix sums, and a shingle's hash mixes its words' hashes in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    # A word [s, e) hashes to the sum of c[j] * B^(j - s) over it: a difference
    # of prefix sums of c[j] * B^j, times the inverse of B^s modulo 2^64.
    powers = _powers(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTE[_LOWER[joined]] * powers[:-1])))
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    unpower = np.full(len(joined) + 1, inverse, dtype=np.uint64)
    unpower[0] = 1
    unpower = np.multiply.accumulate(unpower)
    hashes = mix64((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, bounds))))
    return hashes, counts


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, grouped by text and sorted within, and how many
    each text has. A text of fewer words, but not none, is one shingle."""
    words, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else first, n) + np.arange(len(owner))
    length = np.minimum(counts, width)[owner]
    h = length.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for j in range(width):
        h = h + np.where(length > j, mix64(padded[begin + j] ^ _PLACE[j]) * _PLACE[width + j], U(0))
    h = mix64(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.bincount(owner, minlength=len(texts))


def fast_sketches(values: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates per set (Dahlgaard, Knudsen, Thorup 2017).

    In round i < t every element is hashed to one bin and offers the value
    (i, hash); a bin keeps its smallest. In round t + b every element goes to
    bin b, so all bins fill whatever the set. Sets drop out once full; most
    need two or three rounds. Coordinates of equal elements agree with the
    probability of the Jaccard similarity, concentrated as for t independent
    draws. Empty sets keep the largest value everywhere.
    """
    n = len(sizes)
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    seeds = np.arange(1, 2 * t + 1, dtype=np.uint64) * _BASE
    for i in range(2 * t):
        h = mix64(values + seeds[i])
        bin_ = ((h >> U(32)) % U(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + bin_, (U(i) << U(54)) | (mix64(h) >> U(10)))
        full = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        alive = ~full[owner]
        if not alive.any():
            break
        values, owner = values[alive], owner[alive]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates; bands differ by number."""
    n, t = sketch.shape
    parts = sketch[:, : t - t % rows].reshape(n, t // rows, rows)
    key = np.broadcast_to(mix64(np.arange(t // rows, dtype=np.uint64) + U(77)), parts.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * U(3) + parts[:, :, j])
    return key


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _blocks(batches, limit: int = 4 << 20):
    """Slices of the batches with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes, at = [len(x) for x in _bytes_of(batch.column(1))], 0
        while at < len(sizes):
            end, total = at + 1, sizes[at]
            while end < len(sizes) and total + sizes[end] <= limit:
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def set_digests(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """128 bits that name a shingle set; null for an empty one."""
    ends = np.cumsum(sizes)
    return pa.array([hashlib.blake2b(values[e - s : e].tobytes(), digest_size=16).digest() if s else None for s, e in zip(sizes, ends, strict=True)], pa.binary())


def sketch_batches(batches, t: int, rows: int, width: int):
    """(id, text) -> (id, n_shingles, digest of the set, band keys)."""
    for batch in _blocks(batches):
        values, sizes = shingles(_bytes_of(batch.column(1)), width)
        digests = set_digests(values, sizes)
        keys = band_keys(fast_sketches(values, sizes, t), rows)
        offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), digests, pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
            ["row", "n_shingles", "digest", "bands"])


def set_batches(batches, width: int):
    """(id, text) -> (digest of the set, sorted distinct shingle hashes)."""
    for batch in _blocks(batches):
        values, sizes = shingles(_bytes_of(batch.column(1)), width)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        yield pa.RecordBatch.from_arrays([set_digests(values, sizes), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))], ["c", "items"])
