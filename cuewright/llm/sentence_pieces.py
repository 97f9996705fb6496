"""SentencePiece encoding and decoding; giant documents as a max-plus parallel scan.

The lattice of ``piece_lattice`` gives the ids that the model's own merging
gives. A text of up to ``CHUNK`` characters is one chunk. A longer one is cut
near every CHUNK-th character, where a word begins if one does within
``REACH`` characters, else wherever that is. Each chunk yields its transfer
matrix between the boundary states; the matrices of a document are multiplied
up from the left and from the right, which gives the state of every boundary on
the one path of finite weight; then every chunk is traced back on its own.

Null text has no ids and decodes to an empty text. Repeated rows are encoded
each; rows of one id stay apart. An empty table gives an empty result. Only the
id and the text are read, so other columns cannot clash. Ids are packed as
little-endian uint16. Decoding gives the text back with U+2581 as a blank (the
model knows no difference); ids that are no UTF-8 give U+FFFD.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_lattice import CUT, SPACE, UNIT, Vocabulary, path, product, transfer, unit_numbers
from .store import stored

CHUNK = 1 << 15
REACH = 1024
#: Words remembered per Python worker, and the longest one.
REMEMBERED = 400_000
LONGEST = 40
WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class Codec:
    _known: dict[str, Codec] = {}

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.memory: dict[str, bytes] = {}
        self.by_byte = {i: b for b, i in self.v.bytes.items()}
        self.shown = [p.replace(SPACE, " ") for p in self.v.pieces]
        for i, b in self.by_byte.items():
            # bytes beyond ASCII are marked and put together afterwards
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    @classmethod
    def of(cls, model_file: str) -> Codec:
        if model_file not in cls._known:
            cls._known[model_file] = cls(model_file)
        return cls._known[model_file]

    def pack(self, numbers: list[int]) -> bytes:
        return np.array([i for n in numbers for i in self.v.ids_of(n)], "<u2").tobytes()

    def words(self, text: str) -> bytes:
        """Ids of a run of whole words."""
        memory, out = self.memory, []
        for unit in UNIT.findall(text):
            found = memory.get(unit)
            if found is None:
                found = self.pack(unit_numbers(self.v, unit))
                if len(memory) < REMEMBERED and len(unit) <= LONGEST:
                    memory[unit] = found
            out.append(found)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        shown = self.shown
        text = "".join([shown[i] for i in np.frombuffer(packed, "<u2").tolist()])
        if not text.isascii() and MARKED.search(text):
            text = MARKED.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), text)
        return text[1:] if self.v.prefix and text[:1] == " " else text


MARKED = re.compile("[\udc80-\udcff]+")


def cuts(text: str, chunk: int, reach: int) -> list[tuple[int, bool]]:
    """Boundaries of the chunks and whether one is hard, that is inside a word."""
    out = [(0, False)]
    while len(text) - out[-1][0] > chunk + reach:
        nominal = out[-1][0] + chunk
        found = WORD_START.search(text, nominal, nominal + reach)
        out.append((found.start(), False) if found else (nominal, True))
    return [*out, (len(text), False)]


def inner(text: str, begin: int, end: int, hard_in: bool, hard_out: bool) -> tuple[int, int]:
    """The whole words of a chunk: where the first begins and the last ends; equal to nothing if there is none."""
    first = begin
    if hard_in:
        found = WORD_START.search(text, begin + 1, end)
        if not found:
            return end, end
        first = found.start()
    last = end
    if hard_out:
        last = first
        for found in WORD_START.finditer(text, max(first, begin + 1), end):
            last = found.start()
    return first, last


def ordinary(df: DataFrame, model_file: str) -> DataFrame:
    """(id, n_chars, n_chunks, ids) of texts that are one chunk."""

    def run(batches):
        codec = Codec.of(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                ids = [codec.words(codec.v.normal(t or "")) for t in texts]
                n = pa.array([len(t or "") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), n, pa.array([1] * len(texts), pa.int64()), pa.array(ids, pa.binary())], ["id", "n_chars", "n_chunks", "ids"])

    return df.mapInArrow(run, "id long, n_chars long, n_chunks long, ids binary")


CHUNKS = "key long, id long, n_chars long, k long, n_chunks long, text string, begin long, end long, hard_in boolean, hard_out boolean"


def chunked(df: DataFrame, model_file: str, chunk: int, reach: int) -> DataFrame:
    """A row per chunk, with as many characters around it as the longest piece has."""

    def run(batches):
        v = Codec.of(model_file).v
        for batch in batches:
            for key, doc, text in zip(*[batch.column(c) for c in ("key", "id", "text")], strict=True):
                plain = text.as_py()
                whole = v.normal(plain)
                at = cuts(whole, chunk, reach)
                for k, ((begin, hard_in), (end, hard_out)) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    low, high = max(0, begin - v.longest), min(len(whole), end + v.longest)
                    row = [key.as_py(), doc.as_py(), len(plain), k, len(at) - 1, whole[low:high], begin - low, end - low, hard_in, hard_out]
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True))], schema=SCHEMA)

    return df.withColumn("key", F.monotonically_increasing_id()).select("key", "id", "text").mapInArrow(run, CHUNKS)


SCHEMA = pa.schema(
    [(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in CHUNKS.split(", "))]
)


def chunk_matrix(v: Vocabulary, text: str, begin: int, end: int, hard_in: bool, hard_out: bool) -> set:
    """Transfer matrix; whole words inside pass from CUT to CUT."""
    first, last = inner(text, begin, end, hard_in, hard_out)
    if first >= end and hard_in:
        return transfer(v, text, begin, end, True, hard_out)
    head = transfer(v, text, begin, first, True, False) if hard_in else {(CUT, CUT)}
    tail = transfer(v, text, last, end, False, True) if hard_out else {(CUT, CUT)}
    return product(head, tail)


def chunk_ids(codec: Codec, text: str, begin: int, end: int, hard_in: bool, hard_out: bool, entry: tuple, leave: tuple) -> bytes:
    """Ids of the pieces that start in a chunk, between two known states."""
    v = codec.v
    first, last = inner(text, begin, end, hard_in, hard_out)
    if first >= end and hard_in:
        return codec.pack(path(v, text, begin, end, entry, leave, hard_out))
    head = codec.pack(path(v, text, begin, first, entry, CUT, False)) if hard_in else b""
    tail = codec.pack(path(v, text, last, end, CUT, leave, True)) if hard_out else b""
    return head + codec.words(text[first:last]) + tail


def boundary_states(matrices: list[set]) -> list[tuple]:
    """The state of every boundary, first and last included, on the path of finite weight."""
    ahead = [{CUT}, *[{out for start, out in m if start == CUT} for m in accumulate(matrices, product)]]
    behind = [{CUT}]
    for m in reversed(matrices):
        behind.append({start for start, out in m if out in behind[-1]})
    return [min(a & b) for a, b in zip(ahead, reversed(behind), strict=True)]


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, reach: int = REACH) -> DataFrame:
    """(id, n_chars, n_chunks, ids) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    giant = F.coalesce(F.length("text"), F.lit(0)) >= chunk + reach
    chunks = stored(chunked(rows.where(giant), model_file, chunk, reach), "chunks")

    def matrices(batches):
        v = Codec.of(model_file).v
        for batch in batches:
            for row in batch.to_pylist():
                found = chunk_matrix(v, *[row[c] for c in ("text", "begin", "end", "hard_in", "hard_out")])
                entries = [[*a, *b] for a, b in sorted(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["k"]]), pa.array([entries], pa.list_(pa.list_(pa.int64())))], ["key", "k", "matrix"]
                )

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states = boundary_states([{((m[0], m[1]), (m[2], m[3])) for m in matrix} for matrix in group["matrix"]])
        pairs = [[*a, *b] for a, b in zip(states[:-1], states[1:], strict=True)]
        return pd.DataFrame({"key": group["key"], "k": group["k"], "states": pairs})

    def trace(batches):
        codec = Codec.of(model_file)
        for batch in batches:
            for row in batch.to_pylist():
                i, j, x, y = row["states"]
                ids = chunk_ids(codec, *[row[c] for c in ("text", "begin", "end", "hard_in", "hard_out")], (i, j), (x, y))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([row[c]], pa.int64()) for c in ("key", "id", "n_chars", "n_chunks", "k")], pa.array([ids], pa.binary())],
                    ["key", "id", "n_chars", "n_chunks", "k", "ids"],
                )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        # the pieces of one document, which were one text before
        group = group.sort_values("k")
        first = group.iloc[:1][["id", "n_chars", "n_chunks"]].copy()
        first["ids"] = [b"".join(group["ids"])]
        return first

    spread = chunks.repartition("key", "k")
    weights = spread.mapInArrow(matrices, "key long, k long, matrix array<array<long>>")
    states = weights.groupBy("key").applyInPandas(scan, "key long, k long, states array<long>")
    traced = chunks.join(states, ["key", "k"]).mapInArrow(trace, "key long, id long, n_chars long, n_chunks long, k long, ids binary")
    long_ones = traced.groupBy("key").applyInPandas(joined, "id long, n_chars long, n_chunks long, ids binary")
    return ordinary(rows.where(~giant), model_file).unionByName(long_ones)


def decode(df: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give an empty text."""

    def run(batches):
        codec = Codec.of(model_file)
        for batch in batches:
            texts = [codec.decode(x.as_py() or b"") for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    df = df.drop(into)
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {into} string")
