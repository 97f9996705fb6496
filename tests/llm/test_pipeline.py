import re

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from cuewright.llm import line_dedup
from cuewright.llm import quality_classifier as Q
from cuewright.llm.queries import graded_labels, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(docs):
    sites, first = {}, {}
    for i, (text, site) in sorted(docs.items()):
        for k, raw in enumerate(text.split("\n")):
            line = raw.strip(" ")
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= line_dedup.MIN_WORDS and re.match(r"[^\x20\x09-\x0D]", line):
                sites.setdefault(line, set()).add(site)
                first.setdefault(line, (i, k))
    out = {}
    for i, (text, site) in docs.items():
        parts = text.split("\n")
        gone = [k for k, raw in enumerate(parts) if len(sites.get(raw.strip(" "), ())) >= line_dedup.MIN_SITES and first[raw.strip(" ")] != (i, k)]
        left = "\n".join(x for k, x in enumerate(parts) if k not in gone)
        if not gone or re.search(P.WORDS, left):
            out[i] = (left, site)
    return out


def plain_near(docs):
    sets = {}
    for i, (text, _) in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in docs}
    for _ in range(6):
        for a in docs:
            for b in docs:
                if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: d for i, d in docs.items() if root[i] == i}


def plain_cut(docs, items):
    windows = set()
    for text in items:
        w = WORD.findall(lower(text or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    out = {}
    for i, (text, site) in docs.items():
        found = list(WORD.finditer(lower(text)))
        w, hit = [m[0] for m in found], set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        left, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                left += text[at : found[k].start()]
            at = found[k].end()
        left += text[at:]
        if not hit or re.search(P.WORDS, left):
            out[i] = (left, site)
    return out


def test_stages_agree_with_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = Q.fit(docs, graded_labels(spark, SF))
    good = {r["doc_id"] for r in Q.grade_documents(docs, model).where("kept").collect()}
    want = {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] in good}
    frames = [(P.lines, plain_lines), (P.near_duplicates, plain_near), (P.decontamination, lambda d: plain_cut(d, [r["text"] for r in table(spark, SF, "benchmark").collect()]))]
    current = P.quality(spark, docs, SF)
    assert {r["doc_id"] for r in current.collect()} == set(want)
    for stage, plain in frames:
        current, want = P.stored(stage(spark, current, SF), "step"), plain(want)
        got = current.collect()
        assert current.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in got} == {i: t for i, (t, _) in want.items()}
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in P.run(spark, SF).collect()}
    assert final == {i: library.encode(t) for i, (t, _) in want.items()}


def test_empty_and_odd_rows(spark):
    docs = table(spark, SF, "documents")
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "s", 0), (None, "no id", "en", "s", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[P.F.col(c).cast(kinds[c]) for c in docs.columns])
    for frame, n in ((odd, 4), (odd.limit(0), 0)):
        for _, stage in P.STAGES[1:-1]:
            frame = stage(spark, frame, SF)
        assert P.tokens(spark, frame, SF).count() == n
