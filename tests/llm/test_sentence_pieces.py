import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cuewright.llm import sentence_pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(packed):
    return np.frombuffer(packed, "<u2").tolist()


def test_chunks_of_any_place_give_the_ids_of_the_whole(library):
    codec, r = S.Codec.of(MODEL), random.Random(5)
    for _ in range(120):
        alphabet = r.choice(["aeinrst .,0159éß漢\n\t_-=▁AB", "ainrste", "the ▁ ", " ▁"])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60, 300)))
        whole = codec.v.normal(text)
        at = S.cuts(whole, 40, r.choice([1, 10]))
        parts = [(b, e, i, o) for (b, i), (e, o) in zip(at[:-1], at[1:], strict=True)]
        matrices = [S.chunk_matrix(codec.v, whole, *p) for p in parts]
        states = S.boundary_states(matrices)
        got = b"".join(S.chunk_ids(codec, whole, *p, a, b) for p, a, b in zip(parts, states[:-1], states[1:], strict=True))
        assert ids(got) == library.encode(text)
        assert codec.decode(got) == text.replace("▁", " ")


def test_product_is_associative():
    codec = S.Codec.of(MODEL)
    whole = codec.v.normal("internationalisation" * 12)
    at = S.cuts(whole, 50, 1)
    a, b, c = [S.chunk_matrix(codec.v, whole, x, y, i, o) for (x, i), (y, o) in zip(at[:-1], at[1:], strict=True)][:3]
    assert S.product(S.product(a, b), c) == S.product(a, S.product(b, c)) != set()


def test_table(spark, library):
    rows = [
        (1, "Hello world, again\n"), (2, None), (3, ""), (4, " "), (None, "no id"), (5, "x" * 700), (6, "many words " * 90),
        (6, "the same id"), (7, "naïve 漢字\u0000 \U0001f600"), (8, "a" * 301 + " " * 300 + "b"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = S.decode(S.encode(df, MODEL, chunk=100, reach=20), MODEL).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted([(g["id"], g["decoded"], ids(g["ids"]), g["n_chars"]) for g in got], key=key) == sorted(
        [(i, t or "", library.encode(t or ""), len(t or "")) for i, t in rows], key=key
    )
    assert {g["id"] for g in got if g["n_chunks"] > 1} == {5, 6, 8}
    assert S.encode(df.limit(0), MODEL).count() == 0
    assert S.Codec.of(MODEL).decode(np.array([3 + 0xC3, 3 + 0x41], "<u2").tobytes()) == "�A"
