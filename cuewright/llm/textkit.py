"""Words and hashes of whole Arrow batches, without a Python loop over words.

Texts are looked at as UTF-8 bytes. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte classes: everything but white space; digits, a-z and all bytes outside ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each row begins and ends (one offset more than rows)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return body, at - at[0]


def words(body: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    inside = is_word[body]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = at[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 1 << 21:
            _powers[kind] = known
    return known[:n]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are sorted and do not overlap.

    Prefix sums of a polynomial give every hash by one subtraction. They are
    taken block by block, so memory does not follow the length of a text.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + block, "right")))
        part = body[low : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power("up", _STEP, len(part)), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * _power("down", _BACK, len(part))[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def run_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """For sorted row numbers: where each of n_rows rows begins, and the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


_WEIGHT = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words are one run, none give none."""
    if not len(hashes):
        return hashes
    n = min(width, len(hashes))
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total = total + hashes[k : len(hashes) - n + 1 + k] * _WEIGHT[k]
    return np.unique(mix(total))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, by its first word; none if there are fewer."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total + hashes[k : k + n] * _WEIGHT[k]
    return mix(total)
