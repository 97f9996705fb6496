"""Periodic stretches of words, by Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends; runs of ``MIN_LENGTH`` words and ``MIN_POWER`` periods
or more are listed. The rows of a table are independent of each other, so Spark
deals them out as they are and nothing is shuffled.

1. In a run of that length and power, every ``GRAM`` words in a row stand a
   second time, one period before or after. Words outside stretches of such
   grams are in no run; a run lies whole in one stretch.
2. Phase one of Baier's suffix sorter groups the places of a stretch by their
   longest Lyndon prefix, highest group first: each place of the highest group is
   appended to the nearest place before it that lies in a lower group. The
   length of a place's group is its Lyndon factor, so the Lyndon array falls out
   without sorting any suffix. This is done under the order of the words and
   under its reverse.
3. Every run holds a Lyndon root of one period under one of the two orders. Each
   factor is extended to both sides by longest common extensions, all places at
   once; the runs found are checked word by word.

Null text has no words; rows that repeat are judged alike; an id may be null. An
empty table gives an empty result. Only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import _BACK, _RANDOM, _STEP, NOT_BLANK, _power, gram_hashes, mix, row_slices, run_starts, span_hashes, utf8, words

# Which runs are listed.
MIN_LENGTH = 24
MIN_POWER = 3
#: Words in a row that must stand twice: MIN_LENGTH // MIN_POWER at most, so that one period and they fit into a run twice over.
GRAM = 8
_SALT = _RANDOM.integers(0, 2**63, 1, dtype=np.uint64)


def lyndon_lengths(letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; letters are 0 to max without gaps."""
    n = len(letters)
    first: list[list[int]] = [[] for _ in range(max(letters, default=-1) + 1)]
    for i, c in enumerate(letters):
        first[c].append(i)
    members = first
    size = [1] * len(first)
    lower = list(range(-1, len(first) - 1))  # the next lower group
    upper = [*range(1, len(first)), -1]
    group = list(letters)
    # nearest place before that was in a lower group, for places whose group is done; -2 for all others
    before = [-2] * n
    at = len(first) - 1
    while at >= 0:
        added = size[at]
        appended: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for s in members[at]:
            if group[s] != at:
                continue
            p, passed = s - 1, []
            while p >= 0 and (before[p] != -2 or group[p] == at):
                passed.append(p)
                p = before[p]
            for x in passed:
                before[x] = p
            before[s] = p
            if p != last:
                if last >= 0:
                    appended.setdefault((times, group[last]), []).append(last)
                last, times = p, 0
            times += 1
        if last >= 0:
            appended.setdefault((times, group[last]), []).append(last)
        # those to which more was appended are higher, so they go in first
        for times, old in sorted(appended, key=lambda x: -x[0]):
            new = len(members)
            moved = appended[times, old]
            members.append(moved)
            size.append(size[old] + times * added)
            lower.append(old)
            upper.append(upper[old])
            lower[upper[old]] = new
            upper[old] = new
            for p in moved:
                group[p] = new
        at = lower[at]
    return [size[g] for g in group]


class Extensions:
    """Longest common extensions of places of one sequence, many at once, by hashes of spans."""

    def __init__(self, letters: np.ndarray):
        self.n = len(letters)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(letters.astype(np.uint64) + _SALT) * _power("up", _STEP, self.n), out=self.sums[1:])
        self.back = _power("down", _BACK, self.n + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[a + length] - self.sums[a]) * self.back[a] == (self.sums[b + length] - self.sums[b]) * self.back[b]

    def _longest(self, most: np.ndarray, same) -> np.ndarray:
        found = np.zeros_like(most)
        step = 1 << int(self.n).bit_length()
        while step:
            tried = found + step
            fits = tried <= most
            good = fits & same(np.where(fits, tried, 0))
            found = np.where(good, tried, found)
            step >>= 1
        return found

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on agree (a before b)."""
        return self._longest(self.n - b, lambda k: self.equal(a, b, k))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b agree (a before b)."""
        return self._longest(a, lambda k: self.equal(a - k, b - k, k))


def stretch_runs(letters: np.ndarray, min_length: int, min_power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all listed runs of one sequence, sorted by start, then period."""
    letters = np.unique(letters, return_inverse=True)[1]
    n = len(letters)
    same = Extensions(letters)
    found = set()
    for ordered in (letters, letters.max(initial=0) - letters):
        period = np.array(lyndon_lengths(ordered.tolist()), np.int64)
        at = np.flatnonzero(np.arange(n) + period < n)
        q = period[at]
        # most factors end at once: one word more decides before anything is searched for
        keep = (letters[at] == letters[at + q]) | ((at > 0) & (letters[at - 1] == letters[at + q - 1]))
        at, q = at[keep], q[keep]
        left = same.left(at, at + q)
        length = left + same.right(at, at + q) + q
        listed = (length >= min_length) & (length >= min_power * q)
        found.update(zip((at - left)[listed].tolist(), length[listed].tolist(), q[listed].tolist(), strict=True))
    return sorted((r for r in found if _is_run(letters, *r)), key=lambda r: (r[0], r[2]))


def _is_run(letters: np.ndarray, start: int, length: int, period: int) -> bool:
    """The words themselves repeat, and no neighbour does."""
    end = start + length
    return (
        np.array_equal(letters[start : end - period], letters[start + period : end])
        and (start == 0 or letters[start - 1] != letters[start + period - 1])
        and (end == len(letters) or letters[end] != letters[end - period])
    )


def word_runs(hashes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[list[tuple[int, int, int]]]:
    """Runs of every row. Words of row i are hashes[first[i]:first[i + 1]]; starts count from there."""
    gram = min(GRAM, min_length // min_power)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if len(hashes) < min_length:
        return out
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = gram_hashes(hashes, gram)
    whole = np.flatnonzero(row[: len(grams)] == row[gram - 1 :])
    keys = grams[whole] + mix(row[whole].astype(np.uint64) + _SALT)  # equal grams meet inside a row
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(hashes) + 1, bool)
    twice[whole[order[1:][equal]]] = True
    twice[whole[order[:-1][equal]]] = True
    # maximal stretches of places whose grams stand twice; a place without a gram ends each row
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        b += gram - 1
        if b - a >= min_length:
            base = int(first[row[a]])
            out[row[a]].extend((a - base + s, length, q) for s, length, q in stretch_runs(hashes[a:b], min_length, min_power))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Words that any run contains after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start, then period, and the text with each run cut
    to its first period, words joined by one space."""
    if min_power < 3 or min_length < 2 * min_power:
        raise ValueError("three periods of two words are the least that grams can find")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            body, at = utf8(batch.column("text"))
            starts, ends, row = words(body, at, NOT_BLANK)
            first = run_starts(row, batch.num_rows)
            found = word_runs(span_hashes(body, starts, ends), first, min_length, min_power)
            raw = body.tobytes()
            texts = []
            for i, runs in enumerate(found):
                own = raw[at[i] : at[i + 1]]
                parts = own.split()  # at the same six ASCII blanks
                if runs:
                    gone = dropped(runs, len(parts))
                    parts = [w for w, g in zip(parts, gone.tolist(), strict=True) if not g]
                texts.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first), pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], pa.list_(RUN)), pa.array(texts, pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

