import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cuewright.llm import huffman, token_files
from cuewright.llm.piece_cache import BytePairEncoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_lengths_are_limited_and_complete():
    counts = np.array([0, 1, 1, 2, 4, 8, 1 << 20, 1 << 30, 5])
    lengths = huffman.code_lengths(counts, 5)
    assert lengths.max() <= 5 and lengths[0] == 0
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=0, max_size=900))
def test_pack_and_unpack(ids):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=31) ** 4)
    data, marks = huffman.pack(ids, lengths, huffman.canonical_codes(lengths), 16)
    assert huffman.unpack(data, len(ids), marks, 16, huffman.decode_table(lengths)).tolist() == ids.tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'sl1!.,_\n\t\x1c\x85\u3000é한<|>", max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    whole = Tokenizer.from_file(FILE) if not hasattr(test_pieces_give_the_ids_of_the_whole_text, "t") else test_pieces_give_the_ids_of_the_whole_text.t
    test_pieces_give_the_ids_of_the_whole_text.t = whole
    want = whole.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(BytePairEncoder.of(FILE).packed([text])[0], "<u2").tolist()
    assert got == want


def test_special_text_and_full_memory(monkeypatch):
    monkeypatch.setattr("cuewright.llm.piece_cache.REMEMBERED", 3)
    own = BytePairEncoder(FILE)
    texts = ["a b c d e f g", "x  <|endoftext|> y", None, "", "a b z" + "q" * 300]
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.packed(texts)] == want
    assert len(own.memory) <= 3  # the bound holds


def test_pieces_of_all_kinds_in_their_rows():
    own = BytePairEncoder(FILE)
    texts = ["a1b2 c-d,e f's \n", "one\ntwo, three|4", None, "", " ", "caf\xe9s \u0142\u00f3d\u017a \u0434\u0430 \ud55c\uad6d x\u00d7y", "a\n\nb", "x<y <|endoftext|>", "\0 zero", "end\n", "tab\tbed 1990s (ab) \x1c|"]
    want = [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for _ in range(2):
        got = own.packed_array(pa.array(texts, pa.string()).slice(0), np.array([2], "<u2").tobytes())
        assert [np.frombuffer(x, "<u2").tolist() for x in got.to_pylist()] == want
    part = own.packed_array(pa.array(texts, pa.string()).slice(3, 5))
    assert [np.frombuffer(x, "<u2").tolist() for x in part.to_pylist()] == [w[:-1] for w in want[3:8]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ09 '|,-(<>\n\t\0\xa0\xaa\xe9\xd7\u024f\u0250\u0661", max_size=25), max_size=6))
def test_rows_of_odd_characters(texts):
    own = BytePairEncoder.of(FILE)
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.packed(texts)] == want


@pytest.mark.parametrize("rows", [[], [(3, "b b"), (1, None), (2, ""), (None, "no id"), (2, "again"), (9, "word " * 70_000)]])
def test_files_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, ids string")
    files = token_files.token_files(df, FILE, f"file://{tmp_path}/out")
    got = token_files.digests(files).orderBy("start").collect()
    t, start, want = Tokenizer.from_file(FILE), 0, []
    packed = {r: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, packed[r].astype("<u2").tobytes())):
        want.append((r[0], start, len(packed[r]), zlib.crc32(packed[r].tobytes())))
        start += len(packed[r])
    assert [tuple(x) for x in got] == want
    whole = token_files.read_documents(files).orderBy("start").collect()
    assert [(x["doc"], x["start"], len(x["ids"]) // 4, zlib.crc32(x["ids"])) for x in whole] == want
