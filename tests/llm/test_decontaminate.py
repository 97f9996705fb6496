import random
import re

import pytest

from cuewright.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for k in range(len(w)):
            for size in range(1, window + 1):
                if k + size <= len(w) and (names := windows.get(tuple(w[k : k + size]))):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "part", "shard"), [(1, 1 << 20, 1 << 20), (2, 60, 1 << 20), (3, 1 << 20, 50)])
def test_agrees_with_a_plain_search(spark, seed, part, shard):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(6)] + ["É", "x1"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, "W1-w2, W1"), (51, "W1-w2, W1")]
    docs = [(i, " ".join([*[r.choice(words) for _ in range(r.randrange(0, 20))], r.choice(items[:12])[1], *[r.choice(words) for _ in range(r.randrange(0, 9))]]).upper()) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "... --- !!!")]
    df = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, items string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminated(df, marks, part_bytes=part, shard_bytes=shard, keep=("text",))
    got = sorted([(g["doc_id"], g["n_words"], g["n_hit"], sorted(g["items"])) for g in found.collect()], key=str)
    assert got == plain(docs, items)
    # what is cut out are the hit words and what stands between them
    left = {g["doc_id"]: g["left"] for g in found.withColumn("left", D.without_spans()).collect()}
    assert left[90] is None and left[92] == "... --- !!!"
    counts = {i: (n, h) for i, n, h, _ in plain(docs, items)}
    assert all(len(WORD.findall(lower(t))) <= counts[i][0] - counts[i][1] for i, t in left.items())


def test_null_and_repeated_ids_with_many_parts(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 10, 12])))) for i in range(12)] + [(3, "w1 w2 w3")]
    texts = [" ".join([*[r.choice(words) for _ in range(r.randrange(0, 9))], r.choice(items)[1], f"own{k}"]) for k in range(20)]
    docs = [(None if k % 2 else k // 4, t) for k, t in enumerate([*texts, texts[0], texts[1], None])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    # every row by its place, so that ids play no part
    want = sorted([(docs[k][0], docs[k][1], n, hit, names) for k, n, hit, names in plain([(k, t) for k, (_, t) in enumerate(docs)], items)], key=str)
    cuts = []
    for part in (1 << 20, 60):
        assert (len(list(D.benchmark_parts(marks, "item_id", "text", 10, part))) > 1) == (part == 60)
        found = D.decontaminated(df, marks, part_bytes=part, keep=("text",)).withColumn("left", D.without_spans()).collect()
        assert sorted([(g["doc_id"], g["text"], g["n_words"], g["n_hit"], sorted(g["items"])) for g in found], key=str) == want
        cuts.append(sorted([(g["text"], g["hit_spans"], g["left"]) for g in found], key=str))
    assert cuts[0] == cuts[1]


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two alpha beta gamma"), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta"), (7, "two"), (None, None)], "item_id long, text string")
    for part in (1 << 20, 8):
        got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.decontaminated(docs, items, part_bytes=part).collect()}
        assert got == {1: (4, [None]), 2: (4, ["7", None]), 3: (0, [])}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminated(docs, items).first()["n_hit"] == 0
    assert D.decontaminated(docs.limit(0), items).count() == 0
