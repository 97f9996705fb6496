import re
from itertools import permutations

from cuewright.llm import filter_audit as A


def plain_masks(rows):
    """{row number: set of failed letters}, by the words of the contract."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if any(o is not None and (doc is None or o < doc) and (t or "") == text for o, t, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def plain_audit(rows, labels):
    masks = plain_masks(rows)
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, m) for (d, _, s), m in zip(rows, masks, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d, m in mine if letter in m and not m & before]
                shapley[letter] += len(here)
                found["".join(order), step] = (
                    sum(not m & {*before, letter} for _, m in mine), len(here), sum(letter in m and bool(m & before) for _, m in mine),
                    sum(m == {letter} for _, m in mine), sum(d in good for d in here), sum(d in toxic for d in here),
                )
        out |= {(part, o, k): (*v, shapley[o[k - 1]]) for (o, k), v in found.items()}
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, source string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in A.audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)


def test_against_sets(spark):
    many = " ".join(f"w{i}" for i in range(250))
    dull = " ".join(f"w{i % 50}" for i in range(250))
    loud = " ".join(f"WORD{i}" for i in range(210))
    rows = [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (3, dull, "a"), (4, loud, "a"), (5, many + " 5$", "b"), (6, None, None), (7, "", ""),
        (None, many, "a"), (None, "alone", "b"), (8, "é" * 98 + " AB", "a"), (9, "é" * 97 + " ABC", "a"), (10, dull + " #", "a"), (11, dull + " #", None),
        (12, "word " * 50_000, "b"), (13, "w w\x0bw\x1fw w", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (5, None, 1), (9, 1, None), (11, 1, 1), (None, 1, 1), (99, 1, 1)]
    check(spark, rows, labels)


def test_other_letters_and_empty(spark):
    counted = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 1, 2, 2, 2)], "part string, mask int, n long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in A.interactions(counted, "XY").collect()}
    assert rows == {
        ("XY", 1): (0, 7, 0, 2, 3, 2, 9), ("XY", 2): (0, 0, 5, 0, 0, 0, 5),
        ("YX", 1): (2, 5, 0, 0, 1, 0, 5), ("YX", 2): (0, 2, 5, 2, 2, 2, 9),
    }
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
