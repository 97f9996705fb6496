"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks.

Format ``HTOK1``. A folder holds the files ``part-NNNNN.htok`` in ascending order
of document ids. A file is a row of blocks, then an index, then a footer:

* block: whole documents of ``BLOCK_IDS`` ids or a little more. Bits of the
  codes, most significant bit first, padded to whole bytes; then a little-endian
  uint32 bit offset for every ``CHECKPOINT``-th id;
* index: Arrow stream with a row per block: offset, n_bytes of the bits, n_ids,
  first (ids of the file before it), docs and sizes of its documents;
* code lengths of all ids, one byte each, compressed by zstd;
* footer: uint64 offset of the index, uint64 offset of the lengths, the magic.

Every block can be read alone, given the code lengths; codes follow from them.

Rows without an id are written first, under the smallest id there is; rows with
one id several times are written as often as they occur, in order of their bytes.
Null text has no ids but the end id. An empty table gives no file and no rows.
Writing is repeatable: a task writes to a name of its own and renames it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .huffman import LIMIT, canonical_codes, code_lengths, decode_table, pack, unpack
from .piece_cache import BytePairEncoder
from .store import stored
from .textkit import row_slices

MAGIC = b"HTOK1\0"
BLOCK_IDS = 1 << 16
CHECKPOINT = 64
END_ID = 2
#: Text that is encoded at once; a longer one goes alone.
SLICE_BYTES = 4 << 20


def encoded(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc, ids): the ids of every text as packed uint16, with the end id."""
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encoder = BytePairEncoder.of(tokenizer_file)
        for part in row_slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc"), encoder.packed_array(part.column("text"), end)], ["doc", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc long, ids binary")


def global_counts(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs; the result has as many rows as there are ids, never more."""

    def run(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            _, offsets, data = batch.column("ids").cast(pa.large_binary()).buffers()
            at = np.frombuffer(offsets, np.int64, batch.num_rows + 1, batch.column("ids").offset * 8)
            if batch.num_rows and at[-1] > at[0]:
                total += np.bincount(np.frombuffer(data, "<u2", (at[-1] - at[0]) // 2, at[0]), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_ids, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_files(tokens: DataFrame, folder: str, n_ids: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes (doc, ids) rows in order of doc; returns (part, path, n_ids) of each file."""
    lengths = code_lengths(global_counts(tokens, n_ids))
    codes = canonical_codes(lengths)
    packed_lengths = zstandard.ZstdCompressor().compress(lengths.tobytes())
    root = folder.rstrip("/")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        rows = (pair for b in batches for pair in zip(b.column("doc").to_pylist(), b.column("ids"), strict=True))
        first = next(rows, None)
        if first is None:
            return
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        own = f"{base}/.{uuid.uuid4().hex}"
        index: list[tuple] = []
        written = 0
        with files.open_output_stream(own) as out:

            def flush(docs, parts):
                ids = np.concatenate(parts)
                bits, marks = pack(ids, lengths, codes, CHECKPOINT)
                index.append((out.tell(), len(bits), len(ids), written, docs, [len(p) for p in parts]))
                out.write(bits)
                out.write(marks.astype("<u4").tobytes())
                return len(ids)

            docs, parts, held = [], [], 0
            for doc, packed in chain([first], rows):
                docs.append(doc)
                parts.append(np.frombuffer(packed.as_buffer(), "<u2"))
                held += len(parts[-1])
                if held >= block_ids:
                    written += flush(docs, parts)
                    docs, parts, held = [], [], 0
            if parts:
                written += flush(docs, parts)
            table = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*index), INDEX.types, strict=True)], schema=INDEX)
            where = out.tell()
            with pa.ipc.new_stream(pa.PythonFile(out, "w"), INDEX) as stream:
                stream.write_table(table)
            behind = out.tell()
            out.write(packed_lengths)
            out.write(struct.pack("<QQ", where, behind) + MAGIC)
        path = f"part-{number:05d}.htok"
        files.move(own, f"{base}/{path}")
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{root}/{path}"]), pa.array([written], pa.int64())], ["part", "path", "n_ids"])

    ordered = tokens.repartitionByRange("doc").sortWithinPartitions("doc", "ids")
    return stored(ordered.mapInArrow(run, "part long, path string, n_ids long"), "files")


#: A row per block of a file.
INDEX = pa.schema(
    [
        ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_ids", pa.int64()), ("first", pa.int64()),
        ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ]
)
FOOTER = struct.Struct("<QQ")


def read_footer(path: str) -> tuple[pa.Table, np.ndarray]:
    """The index of a file and its code lengths."""
    files, name = fs.FileSystem.from_uri(path)
    end = files.get_file_info(name).size - FOOTER.size - len(MAGIC)
    with files.open_input_file(name) as f:
        tail = f.read_at(FOOTER.size + len(MAGIC), end)
        if tail[FOOTER.size :] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        where, behind = FOOTER.unpack(tail[: FOOTER.size])
        table = pa.ipc.open_stream(pa.BufferReader(f.read_at(behind - where, where))).read_all()
        lengths = zstandard.ZstdDecompressor().decompress(f.read_at(end - behind, behind))
    return table, np.frombuffer(lengths, np.uint8)


def blocks_of(files: DataFrame, unit: int = 16) -> DataFrame:
    """(before, path, block): units of ``unit`` blocks, dealt out so that a large file is read by many tasks.

    ``before`` is the number of ids in all files before.
    """

    def run(batches):
        for batch in batches:
            for before, path in zip(batch.column("before").to_pylist(), batch.column("path").to_pylist(), strict=True):
                at = range(0, read_footer(path)[0].num_rows, unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before] * len(at), pa.int64()), pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64())],
                    ["before", "path", "block"],
                )

    # one small row per file
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = files.select(before.alias("before"), "path").mapInArrow(run, "before long, path string, block long")
    return units.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path", "block")


def decoded(batches, unit: int = 16):
    """(documents, starts, ids of each) of every block in batches of units."""
    for batch in batches:
        for before, path, block in zip(*[batch.column(c).to_pylist() for c in ("before", "path", "block")], strict=True):
            index, lengths = read_footer(path)
            table = decode_table(lengths, LIMIT)
            source, name = fs.FileSystem.from_uri(path)
            with source.open_input_file(name) as f:
                for row in index.slice(block, unit).to_pylist():
                    n_marks = -(-row["n_ids"] // CHECKPOINT)
                    data = f.read_at(row["n_bytes"] + 4 * n_marks, row["offset"])
                    marks = np.frombuffer(data, "<u4", n_marks, row["n_bytes"])
                    ids = unpack(data[: row["n_bytes"]], row["n_ids"], marks, CHECKPOINT, table).astype("<u4")
                    sizes = np.array(row["sizes"])
                    ends = np.cumsum(sizes)
                    yield row["docs"], before + row["first"] + ends - sizes, [ids[e - n : e] for n, e in zip(sizes, ends, strict=True)]


def read_documents(files: DataFrame) -> DataFrame:
    """(doc, start, ids) of every document in the files; ids are packed uint32.

    ``start`` is the number of ids of all documents before it.
    """

    def run(batches):
        for docs, starts, ids in decoded(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc", "start", "ids"]
            )

    return blocks_of(files).mapInArrow(run, "doc long, start long, ids binary")


def digests(files: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the files, read and checked block by block."""

    def run(batches):
        for docs, starts, ids in decoded(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                ["doc", "start", "n_tokens", "ids_crc32"],
            )

    return blocks_of(files).mapInArrow(run, "doc long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_file: str, folder: str, n_ids: int = 50_257, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes all texts and writes the files; returns (part, path, n_ids) of each file."""
    tokens = stored(encoded(df, tokenizer_file, id_col, text, end_id), "tokens")
    return write_files(tokens, folder, n_ids)
