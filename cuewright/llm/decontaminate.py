"""Benchmark passages in documents, found with an FM-index per shard of texts.

A shard is a few megabytes of whole documents. Its words become numbers in the
benchmark's vocabulary. Only runs of words whose neighbouring pairs all occur in
some window can hold a window; these runs are indexed. All windows are searched
backward at once through wavelet-tree ranks, located by sampled suffix positions,
and their spans merged. Documents are never shuffled.

A window is ``WINDOW`` consecutive item words; an item of fewer words, but not
none, is one window. The benchmark is dealt into parts of a bounded size (bytes
of its text), each a broadcast of its own. One pass looks for all parts in every
row, and a task loads one part at a time; rows are never grouped or joined, so
ids may be null or repeat and the number of parts does not change the result.

Null text has no words, a null item none either. Repeated documents are judged
alike; repeated items count once. Items without an id are looked for like all
others; together they are one null in ``items``, behind the ids. Extra columns pass through, and columns with
the names of the results are replaced. Empty tables: no documents give no rows,
no items leave every document clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .textkit import LETTER_OR_DIGIT, LOWER, row_slices, span_hashes, utf8, words

WINDOW = 10
#: Text of the benchmark that one part may hold.
PART_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
RESULTS = ("n_words", "n_hit", "items", "hit_spans")


class Windows:
    """Windows of one part of the benchmark, as word numbers."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        body, at = utf8(pa.array(texts, pa.string()))
        body = LOWER[body]
        starts, ends, rows = words(body, at, LETTER_OR_DIGIT)
        hashes = span_hashes(body, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        numbers = numbers.astype(np.int64) + 1
        found: dict[tuple, set[int]] = {}
        cut = np.searchsorted(rows, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            own = numbers[cut[i] : cut[i + 1]]
            for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                found.setdefault(tuple(own[k : k + window].tolist()), set()).add(i)
        self.ids = ids
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.patterns[i, : len(w)] = w
        # flat, so that a part is quick to load
        self.item_at = np.cumsum([0, *(len(v) for v in found.values())])
        self.item = np.array([i for v in found.values() for i in sorted(v)], np.int64)
        self.top = len(self.vocabulary)
        first, second = self.patterns[:, :-1].ravel(), self.patterns[:, 1:].ravel()
        self.pairs = np.unique((first * (self.top + 1) + second)[second > 0])
        self.alone = np.unique(self.patterns[self.lengths == 1, 0])

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not self.top:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), self.top - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def occurrences(self, numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) of every occurrence; word is where it begins."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(numbers):
            return none, none
        code = numbers[:-1] * (self.top + 1) + numbers[1:]
        tied = (numbers[:-1] > 0) & (numbers[1:] > 0) & (rows[:-1] == rows[1:])
        at = np.flatnonzero(tied)
        slot = np.minimum(np.searchsorted(self.pairs, code[at]), max(0, len(self.pairs) - 1))
        good = at[self.pairs[slot] == code[at]] if len(self.pairs) else none
        keep = np.isin(numbers, self.alone) if len(self.alone) else np.zeros(len(numbers), bool)
        keep[good] = True
        keep[good + 1] = True
        linked = np.zeros(len(numbers), bool)  # to the next word
        linked[good] = True
        place = np.flatnonzero(keep)
        if not len(place):
            return none, none
        # runs too short for any window go
        new = np.concatenate([[True], ~linked[place[:-1]] | (np.diff(place) != 1)])
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(place)))
        enough = np.repeat(sizes >= self.lengths.min(), sizes)
        place, new = place[enough], new[enough]
        if not len(place):
            return none, none
        # a zero after every run
        where = np.arange(len(place)) + np.cumsum(new) - 1
        text = np.zeros(len(place) + int(new.sum()), np.int64)
        text[where] = numbers[place]
        origin = np.full(len(text), -1, np.int64)
        origin[where] = place
        index = FMIndex(text, self.top)
        low, high = index.search(self.patterns, self.lengths)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return origin[index.locate(np.repeat(low, count) + inside)], window


def loaded(sent: list):
    """The parts one after another; of several, only one stays in the worker's memory."""
    for part in sent:
        yield part.value
        if len(sent) > 1 and hasattr(part, "_path"):  # without a file (encrypted) the value cannot be loaded again
            part.__dict__.pop("_value", None)


def scan(df: DataFrame, parts: Iterable[Windows], id_columns: list[str], text: str, shard_bytes: int) -> DataFrame:
    """Adds RESULTS to every row; ``hit_spans`` are byte spans of merged hit words."""
    context = df.sparkSession.sparkContext
    sent = [context.broadcast(windows) for windows in parts]
    fields = [f for f in df.schema.fields if f.name not in RESULTS and f.name in id_columns]
    schema = T.StructType(
        fields
        + [
            T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    kept = [f.name for f in fields]

    def run(batches):
        for batch in row_slices(batches, text, shard_bytes):
            body, at = utf8(batch.column(text))
            body = LOWER[body]
            starts, ends, rows = words(body, at, LETTER_OR_DIGIT)
            hashes = span_hashes(body, starts, ends)
            n = batch.num_rows
            marks = np.zeros(len(starts) + 1, np.int64)
            items: list[set] = [set() for _ in range(n)]
            for windows in loaded(sent):
                found, which = windows.occurrences(windows.number(hashes), rows)
                np.add.at(marks, found, 1)
                np.add.at(marks, found + windows.lengths[which], -1)
                pairs = np.unique(np.stack([rows[found], which]), axis=1) if len(found) else np.zeros((2, 0), np.int64)
                for row, window in pairs.T:
                    items[row].update(windows.ids[i] for i in windows.item[windows.item_at[window] : windows.item_at[window + 1]])
                del windows  # before the next one is loaded
            hit = np.cumsum(marks[:-1]) > 0
            n_words, n_hit = np.bincount(rows, minlength=n), np.bincount(rows[hit], minlength=n)
            spans: list[list] = [[] for _ in range(n)]
            word = np.flatnonzero(hit)
            if len(word):
                first = np.concatenate([[True], (np.diff(word) != 1) | (rows[word][1:] != rows[word][:-1])])
                begin = word[first]
                end = word[np.append(np.flatnonzero(first)[1:] - 1, len(word) - 1)]
                for row, s, e in zip(rows[begin], starts[begin], ends[end], strict=True):
                    spans[row].append({"start": int(s - at[row]), "end": int(e - at[row])})
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x, key=lambda i: (i is None, i or "")) for x in items], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                [*kept, *RESULTS],
            )

    columns = list(dict.fromkeys([*kept, text]))
    return df.select(*columns).mapInArrow(run, schema)


def benchmark_parts(items: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> Iterator[Windows]:
    """The benchmark in parts of a bounded size; one part is fetched at a time."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // part_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        found = part.orderBy("id").collect()
        yield Windows([r["id"] for r in found], [r["text"] for r in found], window)


def decontaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, n_words, n_hit, items, hit_spans) for every row, in one pass."""
    columns = list(dict.fromkeys([id_col, *keep]))
    return scan(df, benchmark_parts(items, item_id, item_text, window, part_bytes), columns, text, shard_bytes)


def without_spans(text: str = "text", spans: str = "hit_spans"):
    """The text without its hit spans; the parts around them are joined as they are."""
    body = F.encode(F.col(text), "utf-8")
    edges = F.transform(F.col(spans), lambda s, i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(spans), i - 1)["end"]).cast("int").alias("a"), s["start"].cast("int").alias("b")))
    head = F.transform(edges, lambda e: F.decode(F.substring(body, e["a"] + 1, e["b"] - e["a"]), "utf-8"))
    tail = F.decode(F.substring(body, F.get(F.col(spans), F.size(spans) - 1)["end"].cast("int") + 1, F.octet_length(F.col(text))), "utf-8")
    return F.when(F.size(spans) > 0, F.concat(F.array_join(head, ""), tail)).otherwise(F.col(text))
