"""An FM-index over word numbers: wavelet-tree ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order, by prefix doubling; all suffixes differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    # a rank is the place where the suffix's group begins
    fresh = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    # only groups that are still tied are sorted again
    while len(tied := np.flatnonzero(np.bincount(ranks, minlength=n)[ranks] > 1)):
        pair = ranks * (n + 1)
        pair[: n - step] += ranks[step:] + 1
        again = tied[np.argsort(pair[tied], kind="stable")]
        place = ranks[again]
        run = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place + np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
        fresh = np.concatenate([[True], pair[again][1:] != pair[again][:-1]])
        ranks[again] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(again)), 0))]
        step *= 2
    out = np.empty(n, np.int64)
    out[ranks] = np.arange(n)
    return out


class WaveletRanks:
    """How often a symbol occurs before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones_start, ones_place = self.ones[k][start], self.ones[k][place]
            start = np.where(one, self.zeros[k] + ones_start, start - ones_start)
            place = np.where(one, self.zeros[k] + ones_place, place - ones_place)
        return place - start


class FMIndex:
    """Index of runs of positive word numbers, each run ended by a zero.

    Every zero counts as a symbol of its own, so a match never crosses it and
    the order of suffixes is total. Positions are sampled at every ``every``-th
    place and at the start of every run.
    """

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        stops = np.flatnonzero(text == 0)
        single = text.astype(np.int64) + len(stops)
        single[stops] = np.arange(len(stops))
        self.order = suffix_order(single)
        before = np.concatenate([[0], text[:-1]])
        last = before[self.order]
        self.ranks = WaveletRanks(last, top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.last = last
        known = (self.order % every == 0) | (last == 0)
        self.known = known
        self.sample = np.where(known, self.order, -1)
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each pattern; patterns stand at the left of their rows."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            base = self.below[symbol]
            low[live], high[live] = base + self.ranks.rank(symbol, low[live]), base + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled place."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            done = self.known[at[todo]]
            ready = todo[done]
            out[ready] = self.sample[at[ready]] + steps[ready]
            todo = todo[~done]
            symbol = self.last[at[todo]]
            at[todo] = self.below[symbol] + self.ranks.rank(symbol, at[todo])
            steps[todo] += 1
        return out
