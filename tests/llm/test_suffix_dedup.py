import collections
import hashlib
import random

import pytest

from cuewright.llm import queries
from cuewright.llm import suffix_dedup as S


def plain(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for key, t in texts.items():
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        spans = sum(i - 1 not in gone for i in gone)
        out[key] = (len(t), len(gone), spans, bytes(t[i] for i in range(len(t)) if i not in gone))
    return out


def test_merge_of_front_coded_runs():
    r = random.Random(3)
    for _ in range(200):
        runs = [sorted("".join(r.choice("ab") for _ in range(6)).encode() for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 7))]
        coded = [S.front_coded(x, 6) for x in runs]
        taken, out, before = [0] * len(runs), [], b""
        for run, shared in S.merge([S.run_strings(k.tolist(), rest, 6) for k, rest in coded]):
            s = runs[run][taken[run]]
            taken[run] += 1
            assert before[:shared] == s[:shared] and (shared == 6 or not before or before[shared] < s[shared])
            out.append(s)
            before = s
        assert out == sorted(x for run in runs for x in run)


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 1), (3, 0)])
def test_agrees_with_all_substrings(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "BUCKET", 50)
    monkeypatch.setattr(S, "RUN", 100)
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [word(r.choice([15, 25, 60])) for _ in range(8)]
    texts = {1: "", 2: "a" * 70, 3: "a" * 19, 4: "ab" * 40, 5: "aaaa" * 8 + "b"}
    for i in range(10, 70):
        texts[i] = "".join(r.choice([*shared, word(r.randrange(0, 30))]) for _ in range(r.randrange(0, 6)))
    texts[80] = texts[10]
    rows = [*texts.items(), (90, None), (None, "a" * 50)]
    texts = {**texts, None: "a" * 50}
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, spans int")
    got = S.dedup_suffixes(df, length=20, window=7, gram=4, hot=hot).collect()
    want = plain({k: t.encode() for k, t in texts.items()}, 20)
    want |= {90: (0, 0, 0, b"")}
    assert {g["id"]: (g["n_bytes"], sum(s["end"] - s["start"] for s in g["removed"]), len(g["removed"]), bytes(g["kept"])) for g in got} == want


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdef ") for _ in range(90))
    rows = [(5, long + "own end"), (5, "short text."), (None, "x" + long[:60]), (None, "alone here"), (0, "y" * 3 + long[30:]), (0, "alone here"), (7, "z"), (7, "z"), (None, None)]
    rows += [(8, "copy " + long[:40]), (8, "copy " + long[:40])]
    got = S.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), length=20, window=7, gram=4).collect()
    want = plain(dict(enumerate((t or "").encode() for _, t in rows)), 20)
    want = sorted((k is None, k or 0, *want[i]) for i, (k, _) in enumerate(rows))
    assert sorted((g["id"] is None, g["id"] or 0, g["n_bytes"], sum(s["end"] - s["start"] for s in g["removed"]), len(g["removed"]), bytes(g["kept"])) for g in got) == want


def test_empty(spark):
    assert S.dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_agrees_with_all_substrings(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {k: (n, m, s, hashlib.sha256(b).hexdigest()) for k, (n, m, s, b) in plain(texts, 400).items()}
    got = queries.op6_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
