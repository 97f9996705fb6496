"""Token ids of texts, put together from the remembered ids of their pieces.

A piece is a word with the white space before it. No pre-token of the byte-level
pattern crosses such a border, and nothing behind the border changes what stands
before it, so the ids of a text are those of its pieces in a row.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Texts in which other white space stands than single blanks and line ends between words, and empty ones.
UNEVEN = r"\A\z|\A[ \n]|[ \n][ \n]|[ \n]\z|[\x00\t\x0B-\x0D\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Pieces of letters of scripts that are letters in every version of Unicode, of digits and of ASCII signs. An
#: apostrophe may begin a contraction, and every added token has a "<": such pieces go to the library.
SIMPLE = re.compile("[ \n]?[!-&(-;=-~\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|\n")
#: A byte is shown by its own character if that is printable, else by one from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = np.arange(256, dtype="<u4")
SHOWN[[b for b in range(256) if b not in _PRINTABLE]] = 256 + np.arange(256 - len(_PRINTABLE))
#: The end of a pre-token; no byte of a simple piece.
TAB = 9
SHOWN[TAB] = TAB
#: Kinds of bytes in simple pieces: letters, digits, signs, the blank, the line end; 0 between pieces.
KIND = np.full(256, 1, np.uint8)
KIND[0x21:0x7F] = [1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(0x21, 0x7F)]
BLANK = 4
KIND[[0x20, 0x0A, TAB]] = BLANK, 5, 0
#: Pieces remembered per Python worker, and the longest one.
REMEMBERED = 400_000
LONGEST = 40
#: Simple pieces that are encoded at once.
TOGETHER = 20_000


class BytePairEncoder:
    """Ids as packed little-endian uint16; all ids must be below 65,536."""

    _known: dict[str, BytePairEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.all_marked = all("<" in t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # the same model behind pre-tokens that are told by hand
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = CharDelimiterSplit("\t")
        self.memory: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> BytePairEncoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        return self.packed_array(pa.array(texts, pa.string())).to_pylist()

    def packed_array(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of each text and ``end``. Every different piece is looked up once."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return pa.array([], pa.binary())
        uneven = pc.match_substring_regex(texts, UNEVEN)
        keys, counts = self.keys(texts, uneven)
        coded = keys.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = [self.memory.get(name) if name else end for name in names]
        fresh = [name for name, got in zip(names, found, strict=True) if got is None]
        if fresh:
            new = self.encoded(fresh)
            found = [new[name] if got is None else got for name, got in zip(names, found, strict=True)]
            room = REMEMBERED - len(self.memory)
            if room > 0:
                self.memory.update([(p, b) for p, b in new.items() if len(p) <= LONGEST][:room])
        ids = np.frombuffer(b"".join(found), "<u2")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        first = (np.cumsum(sizes) - sizes)[codes]
        sizes = sizes[codes]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
        row_ends = ends[np.cumsum(counts) - 1]
        offsets = np.concatenate([[0], 2 * row_ends]).astype(np.int32)
        rows = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
        if not pc.any(uneven).as_py():
            return rows
        return rows.take(pa.array(np.argsort(np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable"))))

    @staticmethod
    def keys(texts: pa.Array, uneven: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Names of all pieces, even texts first, and how many each text has; an empty name ends a text.

        A bare word stands for itself behind a blank, a zero in front for the very piece.
        """
        even = texts.filter(pc.invert(uneven))
        marked = pc.replace_substring(pc.binary_join_element_wise("\0", even, " ", ""), "\n", " \0\n")
        split = pc.split_pattern(marked, " ")
        other = [["\0" + p for p in PIECE.findall(x)] + [""] for x in texts.filter(uneven).to_pylist()]
        flat = pa.array([p for row in other for p in row], split.type.value_type)
        counts = np.concatenate([pc.list_value_length(split).to_numpy(), np.array([len(row) for row in other], np.int32)])
        return pa.concat_arrays([split.flatten(), flat]), counts

    def encoded(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of pieces. In simple ones pre-tokens are told by the kinds of their bytes, and the model alone will do."""
        pieces = [key[1:] if key[0] == "\0" else " " + key for key in keys]
        plain = [self.all_marked and SIMPLE.fullmatch(p) is not None for p in pieces]
        out, simple = {}, [k for k, is_plain in enumerate(plain) if is_plain]
        for at in range(0, len(simple), TOGETHER):
            part = simple[at : at + TOGETHER]
            out.update(zip([keys[k] for k in part], self.simple_ids([pieces[k] for k in part]), strict=True))
        other = [k for k, is_plain in enumerate(plain) if not is_plain]
        if other:
            got = self.tokenizer.encode_batch_fast([pieces[k] for k in other], add_special_tokens=False)
            out.update((keys[k], np.array(e.ids, "<u2").tobytes()) for k, e in zip(other, got, strict=True))
        return out

    def simple_ids(self, pieces: list[str]) -> list[bytes]:
        body = np.frombuffer("\t".join(pieces).encode(), np.uint8)
        kind = KIND[body]
        # a pre-token is a run of one kind, with a blank before it
        border = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (kind[:-1] != BLANK)) + 1
        tokens = 1 + np.bincount(np.cumsum(kind == 0)[border], minlength=len(pieces))
        shown = np.insert(SHOWN[body], border, TAB).tobytes().decode("utf-32-le")
        got = self.bare.encode(shown, add_special_tokens=False)
        ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=tokens.sum()))[np.cumsum(tokens) - 1] * 2
        packed = np.array(got.ids, "<u2").tobytes()
        ends = ends.tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
