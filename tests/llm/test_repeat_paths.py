import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import repeat_paths as R


def plain_removal(rows, width):
    """Sorted (id, n_words, kept) by comparing windows with those of smaller ids."""
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    first = {}
    for doc, x in split:
        for i in range(len(x) - width + 1):
            if doc is not None:
                w = tuple(x[i : i + width])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, x in split:
        gone = set()
        for i in range(len(x) - width + 1):
            if doc is not None and first[tuple(x[i : i + width])] < doc:
                gone.update(range(i, i + width))
        out.append((doc is not None, doc or 0, len(x), b" ".join(w for i, w in enumerate(x) if i not in gone).decode()))
    return sorted(out)


def made(seed, count):
    """Texts that share passages, with rings, edits, copies and repeated ids."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(5, 60))] for _ in range(9)]
    pool.append(list("abcdefghijklm") * 3)
    rows = []
    for i in range(count):
        words = []
        for _ in range(rng.randint(0, 4)):
            piece = list(rng.choice(pool))
            if piece and rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = f"x{i}"
            words += piece[rng.randint(0, 4) :] + [f"own{rng.randrange(500)}"] * rng.randint(0, 3)
        rows.append((i if rng.random() < 0.9 else rng.randrange(count), rng.choice((" ", "\n", "\t ")).join(words)))
    return rows


def removed(spark, rows, width, **how):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, pos int, spans string, twin int")
    return sorted((r["id"] is not None, r["id"] or 0, r["n_words"], r["kept"]) for r in R.without_repeats(df, width=width, **how).collect())


def test_against_search(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = made(1, 70) + [(None, made(1, 3)[2][1]), (None, long), (500, None), (501, ""), (502, long), (503, "x " + long + " y"), (503, long + " z"), (503, long + " z"), (504, "a b c"), (505, "a b c"), (40, "é " * 40)]
    assert removed(spark, rows, 13) == plain_removal(rows, 13)


def test_other_widths(spark):
    rows = made(2, 60)
    assert removed(spark, rows, 6, core=2) == plain_removal(rows, 6)


def test_paths_are_compact_and_in_step(spark):
    passage = [f"p{i}" for i in range(40)]
    half = [f"q{i}" for i in range(30)]
    rows = [
        (1, "a1 a2 " + " ".join(passage[:25])), (2, "b1 " + " ".join(passage) + " b2"), (3, " ".join(passage) + " c1"),
        (4, "d1 " + " ".join(passage)), (5, " ".join(half) + " e1"), (6, "f1 " + " ".join(half)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = R.keyed(df, "doc_id", "text")
    found = R.repeatable(R.candidates(keyed, R.copies(keyed), 13, 5), 13, 5, once=True)
    edges = R.compacted(R.repeated_edges(found)).orderBy("path", "place").collect()
    paths = {}
    for e in edges:
        paths.setdefault(e["path"], []).append(e["place"])
    # the passage is one path although its edges have two sources
    assert sorted(map(len, paths.values())) == [18, 28] and all(p == list(range(len(p))) for p in paths.values())
    spans = {r["id"]: sorted((s["start"], s["end"], s["place"]) for s in r["spans"]) for r in R.repeated_spans(df).collect()}
    assert spans == {2: [(1, 26, 0)], 3: [(0, 40, 0)], 4: [(1, 41, 0)], 6: [(1, 31, 0)]}


def test_rings_end(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14)], "before long, segment long")
    sizes = spark.createDataFrame([(i, 5) for i in (1, 2, 3, 10, 11, 12, 13, 14)], "segment long, size long")
    assert sorted(tuple(r) for r in R.chained(sizes, links).select("segment", "path", "offset").collect()) == [(10, 10, 0), (11, 10, 5), (12, 10, 10), (13, 10, 15), (14, 10, 20)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.without_repeats(empty).count() == 0
    assert R.without_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sum("n_words")).first()[0] == 0
    with pytest.raises(ValueError):
        R.without_repeats(empty, width=3, core=4)
