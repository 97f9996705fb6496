import itertools
import random

import numpy as np
import pytest

from cuewright.llm import near_dup as N


def plain(rows, width, percent):
    """All pairs, by sets of word tuples."""
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = [r[0] for r in rows]
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[i] = root[j] = min(root[i], root[j])
    return sorted([(r[0], len(s), c, r[0] is None or r[0] == c) for r, s, c in zip(rows, sets, root, strict=True)], key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one two"), (None, None)]
    shared = [r.choice(words) for _ in range(40)]
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([6, 30, 80]))]
        if k % 3 == 0:
            base = shared + base[:20]  # a common passage: keys that dissimilar texts share
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 7 % 890, " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent", "block"), [(2, 80, 2048), (5, 80, 3), (1, 90, 4)])
def test_components_agree_with_all_pairs(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus(width)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, id int")
    got = N.near_duplicates(df, width=width, percent=percent).select("id", "n_shingles", "component_id", "kept").collect()
    assert sorted([tuple(x) for x in got], key=str) == plain(rows, width, percent)


def test_texts_under_one_id_are_told_apart(spark):
    first = " ".join(f"a{i}" for i in range(40))
    second = " ".join(f"b{i}" for i in range(40))
    rows = [(1, first), (1, second), (3, second + " more"), (4, first), (0, first + " more"), (1, first)]
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", N.F.left("text", N.F.lit(2))), keep=("mark",))
    got = sorted((r["id"], r["mark"], r["component_id"], r["kept"]) for r in found.collect())
    assert got == [(0, "a0", 0, True), (1, "a0", 0, False), (1, "a0", 0, False), (1, "b0", 1, True), (3, "b0", 1, False), (4, "a0", 0, False)]


@pytest.mark.parametrize("block", [2048, 7])
def test_a_large_group_below_the_threshold(spark, monkeypatch, block):
    """A template of 70 words in a hundred: most pairs are near the threshold, some above it."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "TOGETHER", 4096)
    monkeypatch.setattr(N, "CROWDED", 3)
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if r.random() > 0.12 else f"x{r.randrange(400)}" for w in base)) for i in range(80)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).select("id", "n_shingles", "component_id", "kept").collect()
    want = plain(rows, 1, 80)
    assert 1 < len({x[2] for x in want}) < 80
    assert sorted([tuple(x) for x in got], key=str) == want


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_pair_within_the_threshold_shares_a_key():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = r.integers(0, 1 << 16, N.COMPONENTS, dtype=np.uint16)
        b = a.copy()
        b[r.choice(N.COMPONENTS, N.THRESHOLD, replace=False)] ^= 1
        keys = N.key_matrix(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()
