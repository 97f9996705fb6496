import random

import numpy as np
import pytest

from cuewright.llm import periodic_runs as P


def plain_runs(x, min_length=P.MIN_LENGTH, min_power=P.MIN_POWER):
    """For every period: maximal stretches, smallest period of each."""
    found = {}
    n = len(x)
    for q in range(1, n // min_power + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_power * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(x, runs):
    return [w for i, w in enumerate(x) if not any(s + q <= i < s + length for s, length, q in runs)]


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.choice((1, 2, 3, 6))
        out = []
        while len(out) < rng.randint(0, 160):
            piece = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
            out += piece * rng.choice((1, 1, 3, 4, 7)) + piece[: rng.randint(0, len(piece))]
        yield out


def test_lyndon_lengths_by_definition():
    for x in sequences(3, 150):
        x = [sorted(set(x)).index(c) for c in x][:60]
        lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
        assert P.lyndon_lengths(x) == [max(k for k in range(1, len(x) - i + 1) if lyndon(x[i : i + k])) for i in range(len(x))]


def test_runs_by_search():
    for x in sequences(5, 400):
        hashes = np.array([c * 7919 + 13 for c in x], np.uint64)
        assert P.word_runs(hashes, np.array([0, len(x)])) == [plain_runs(x)]
        assert P.word_runs(hashes, np.array([0, len(x)]), 9, 4) == [plain_runs(x, 9, 4)]


def test_table(spark):
    texts = [" ".join("abcdef"[c] for c in x) for x in sequences(8, 60)]
    texts += [None, "", " \n", "a " * 30, "a " * 30, "é b\x1fc d\t" * 9 + "é b\x1fc", "one two three " * 20_000 + "end", " ".join(map(str, range(50_000)))]
    rows = [(None if i == 7 else i // 2, t, i, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs int, collapsed string")
    got = sorted((r["id"] is not None, r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.periodic_runs(df).collect())
    want = []
    for doc, text, *_ in rows:
        x = (text or "").encode().split()
        runs = [(0, 60_000, 3)] if len(x) > 60_000 else [] if len(x) == 50_000 else plain_runs(x)
        kept = x[:3] + [b"end"] if len(x) > 60_000 else x if len(x) == 50_000 else plain_collapse(x, runs)
        want.append((doc is not None, doc or 0, len(x), runs, b" ".join(kept).decode()))
    assert got == sorted(want)


def test_empty_and_bad_limits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        P.periodic_runs(empty, min_power=2)
