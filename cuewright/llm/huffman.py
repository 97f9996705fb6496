"""Canonical length-limited Huffman codes, packed and unpacked with whole arrays."""

from __future__ import annotations

import numpy as np

#: No code is longer; a table of 2**LIMIT entries decodes one symbol per look.
LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits (package-merge); symbols that never occur get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # Level by level, pairs of the cheapest packages join the single symbols.
    # A package is known by its weight; which ones were single is kept per level.
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weights))
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take, depth = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for single in reversed(levels):
        chosen = single[:take]
        n = int(chosen.sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol; they follow from the lengths alone."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    sizes = lengths[order].astype(int)
    for length in np.unique(sizes):
        code <<= length - last
        same = order[sizes == length]
        codes[same] = code + np.arange(len(same))
        code, last = code + len(same), length
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next ``limit`` bits."""
    symbols, sizes = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return symbols, sizes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of each ``every``-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.uint32)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    # a code of up to 16 bits lies in three bytes
    placed = codes[ids].astype(np.int64) << (24 - (begins & 7) - size)
    first = begins >> 3
    n = int(first[-1]) + 3
    out = np.zeros(n, np.float64)
    for k, shift in enumerate((16, 8, 0)):
        # codes never share a bit, so sums of bytes are unions of bits
        part = np.bincount(first, weights=((placed >> shift) & 255).astype(np.float64), minlength=n - k)
        out[k : k + len(part)] += part[: n - k]
    return out[: (int(ends[-1]) + 7) >> 3].astype(np.uint8).tobytes(), begins[::every].astype(np.uint32)


def unpack(data: bytes, n: int, checkpoints: np.ndarray, every: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block. All stretches between checkpoints are read side by side."""
    if not n:
        return np.zeros(0, np.uint32)
    symbols, sizes = table
    body = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (body[:-3] << 24) | (body[1:-2] << 16) | (body[2:-1] << 8) | body[3:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((len(at), every), np.uint32)
    last = n - (len(at) - 1) * every
    for k in range(min(every, n)):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        look = (window[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[: len(at), k] = symbols[look]
        at = at + sizes[look]
    return out.ravel()[:n]
