"""Removal of word windows that an earlier document holds, by De Bruijn compaction.

A window of ``WIDTH`` words is an edge from its first ``WIDTH - 1`` words to its
last; both nodes are 64-bit hashes, so an edge is known by 128 bits. Each word
covered by a window that also starts in a document with a smaller id goes.
Windows are judged on the input.

0. A row whose whole text a smaller id holds is a copy: it goes whole, if it has a
   window at all, and only the first row of each text is looked at further.
1. Which windows can repeat: the smallest hash of ``CORE`` words inside a window
   is its core, and equal windows have equal cores. Cores are counted, each once
   a document, map-side first. Windows whose core stands in one document only
   are done.
2. The others become edges. Equal edges are combined map-side into one row with
   its source: the smallest id that holds it, and the place there. Edges of one
   document are dropped.
3. A node with one edge in and one edge out does not branch. Edges that follow
   each other in their source over such nodes form a segment; where such a node
   joins two sources, segments are chained by pointer jumping: each round of
   joins doubles the way to the head, until every segment knows its path and
   its offset. A ring of segments has no head and stays in segments.
4. Occurrences are joined with their edges. Windows of one document that walk
   along one path in step with the coordinates of their source are one span.

Ids are integers. A row without an id keeps all its words and is nobody's
source. Rows that repeat an id never remove from each other; each is judged
on its own text. Null text has no words. Fewer than ``WIDTH`` words hold no window.
An empty table gives an empty result. Only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import forget
from .store import stored_tidily as stored
from .textkit import NOT_BLANK, gram_hashes, mix, row_slices, span_hashes, utf8, words

WIDTH = 13
CORE = 5
KEY = ["id", "twin"]
SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "path", "place")]))
#: Where a window's words first stand.
SOURCE = ["src", "src_twin", "src_pos"]


def windows(texts: pa.Array, width: int, core: int) -> tuple[np.ndarray, ...]:
    """(row, word number, left node, right node, core, whether the window before has the same one) of every window."""
    body, at = utf8(texts)
    starts, ends, row = words(body, at, NOT_BLANK)
    hashes = span_hashes(body, starts, ends)
    n = max(0, len(hashes) - width + 1)
    whole = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
    nodes = gram_hashes(hashes, width - 1).view(np.int64)
    grams = gram_hashes(hashes, core)
    # smallest upper half first, the last of equal ones: the same place in equal windows
    low = np.uint64(0xFFFFFFFF)
    order = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    least = order[:n].copy()
    for k in range(1, width - core + 1):
        np.minimum(least, order[k : k + n], out=least)
    owner = (low - (least[whole] & low)).astype(np.int64)
    place = whole - np.searchsorted(row, row[whole])
    shared = np.zeros(len(whole), bool)
    shared[1:] = owner[1:] == owner[:-1]
    return row[whole], place, nodes[whole], nodes[whole + 1], grams[owner].view(np.int64), shared


def keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, twin, text): the twin tells rows of one id with different texts apart."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("twin"), F.col(text).alias("text"))


def copies(rows: DataFrame) -> DataFrame:
    """(id, twin) of rows whose text a smaller id has; texts are told apart by 128 bits."""
    known = rows.select(*KEY, F.xxhash64(F.lit(7), "text").alias("mark"))
    firsts = known.groupBy("twin", "mark").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # written, so that the join of a text with very many copies can be split
    several = stored(firsts.drop("last"), "first-rows")
    return stored(known.join(several, ["twin", "mark"]).where("first < id").select(*KEY).distinct(), "copies")


def cores(rows: DataFrame, width: int, core: int) -> DataFrame:
    """(core, id, twin), each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            row, *_, found, shared = windows(batch.column("text"), width, core)
            row, found = row[~shared], found[~shared]
            _, once = np.unique(found.view(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
            keys = [batch.column(c).to_numpy(zero_copy_only=False)[row[once]] if len(once) else [] for c in KEY]
            yield pa.RecordBatch.from_arrays([pa.array(found[once], pa.int64()), *[pa.array(k, pa.int64()) for k in keys]], ["core", *KEY])

    return rows.mapInArrow(run, "core long, id long, twin long")


def candidates(rows: DataFrame, copied: DataFrame, width: int, core: int) -> DataFrame:
    """(id, twin, text, cores) of rows that are no copies, with their cores that stand in several documents."""
    found = cores(rows, width, core)
    often = found.groupBy("core").count().where("count > 1").select("core")
    # the repeated cores are written, so that the join of a core that many documents share can be split
    # in which each stands once, so hash tables of them are even
    wanted = found.join(stored(often, "repeated-cores").hint("shuffle_hash"), "core", "left_semi")
    lists = wanted.groupBy(*KEY).agg(F.collect_set("core").alias("cores"))  # fewer than the words of one text
    texts = rows.join(lists.join(copied, KEY, "left_anti"), KEY).dropDuplicates(KEY)
    return stored(texts, "candidates")


def repeatable(rows: DataFrame, width: int, core: int, once: bool) -> DataFrame:
    """(id, twin, pos, l, r) of all windows with one of their row's cores; once: one of equal windows of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            row, place, left, right, found, _ = windows(batch.column("text"), width, core)
            keep = np.isin(found, batch.column("cores").flatten().to_numpy())
            row, place, left, right = row[keep], place[keep], left[keep], right[keep]
            if once:
                key = mix(left.view(np.uint64)) + right.view(np.uint64) + mix(row.astype(np.uint64) + np.uint64(1))
                order = np.argsort(key, kind="stable")
                same = (row[order[1:]] == row[order[:-1]]) & (left[order[1:]] == left[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
                fresh = np.ones(len(row), bool)
                fresh[order[1:][same]] = False
                row, place, left, right = row[fresh], place[fresh], left[fresh], right[fresh]
            keys = [batch.column(c).to_numpy(zero_copy_only=False)[row] if len(row) else [] for c in KEY]
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], pa.array(place, pa.int32()), pa.array(left), pa.array(right)], [*KEY, "pos", "l", "r"])

    return rows.mapInArrow(run, "id long, twin long, pos int, l long, r long")


def repeated_edges(found: DataFrame) -> DataFrame:
    """(l, r, src, src_twin, src_pos) of every edge that two ids hold."""
    first = found.groupBy("l", "r").agg(
        F.min("id").alias("src"), F.max("id").alias("_last"), F.min_by("twin", "id").alias("src_twin"), F.min_by("pos", "id").alias("src_pos")
    )
    return stored(first.where("src < _last").drop("_last"), "edges")


def plain_links(edges: DataFrame) -> DataFrame:
    """From the edge into every node that does not branch to the edge out of it, both by their source."""
    sides = edges.select(F.col("r").alias("node"), F.lit(True).alias("into"), *SOURCE).unionByName(edges.select(F.col("l").alias("node"), F.lit(False).alias("into"), *SOURCE))
    into, out = F.col("into"), ~F.col("into")
    nodes = sides.groupBy("node").agg(
        F.count_if(into).alias("ins"), F.count_if(out).alias("outs"),
        *[F.max(F.when(into, F.col(c))).alias(f"from_{c}") for c in SOURCE], *[F.max(F.when(out, F.col(c))).alias(c) for c in SOURCE],
    )
    plain = nodes.where("ins = 1 AND outs = 1")
    in_step = "from_src = src AND from_src_twin = src_twin AND from_src_pos + 1 = src_pos"
    return stored(plain.select(*SOURCE, *[f"from_{c}" for c in SOURCE], F.expr(in_step).alias("in_step")), "links")


def chained(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(segment, path, offset) of every segment, from links (before, segment).

    Every segment points at one before it and knows the edges in between. A
    round of joins lets it point at what that one points at. ``path`` is the head
    of the chain; segments of a ring never reach one and are paths of their own.
    """
    sizes = segments.select(F.col("segment").alias("before"), F.col("size").alias("offset"))
    now = stored(links.join(sizes, "before").select("segment", F.col("before").alias("to"), "offset"), "pointers")
    # those that nothing precedes
    heads = links.select(F.col("before").alias("segment")).join(links, "segment", "left_anti").distinct()
    done = stored(heads.select("segment", F.col("segment").alias("path"), F.lit(0).cast("long").alias("offset")), "heads")
    parts = [done]
    while True:
        ahead = now.select(F.col("segment").alias("to"), F.col("to").alias("next"), F.col("offset").alias("more"))
        # pointers at a segment whose path is known are done
        known = done.select(F.col("segment").alias("to"), "path", F.col("offset").alias("start"))
        step = stored(now.join(known, "to", "left").join(ahead, "to", "left"), "jumps")
        done = step.where("path IS NOT NULL").select("segment", "path", (F.col("offset") + F.col("start")).alias("offset"))
        if done.isEmpty():
            break
        parts.append(done)
        now = step.where("path IS NULL").select("segment", F.coalesce("next", "to").alias("to"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        done = everything(parts)
    return everything(parts)


def everything(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compacted(edges: DataFrame) -> DataFrame:
    """Every edge with its path and its place on it."""
    links = plain_links(edges)
    steps = links.where("in_step").select(*SOURCE, F.lit(True).alias("_joined"))
    # inside one source: edges that follow each other without a branch, at most the words of one text
    along = Window.partitionBy("src", "src_twin").orderBy("src_pos")
    begins = F.when(F.col("_joined").isNull(), F.col("src_pos"))
    placed = edges.join(steps, SOURCE, "left").withColumn("_start", F.max(begins).over(along))
    name = lambda src, twin, start: F.xxhash64(src, twin, start)
    placed = stored(placed.select("l", "r", *SOURCE, name("src", "src_twin", "_start").alias("segment"), (F.col("src_pos") - F.col("_start")).alias("place")), "segments")
    segments = placed.groupBy("segment").agg(F.count(F.lit(1)).alias("size"))
    crossings = links.where("NOT in_step")
    ends = placed.select(*[F.col(c).alias(f"from_{c}") for c in SOURCE], F.col("segment").alias("before"))
    crossed = crossings.join(ends, [f"from_{c}" for c in SOURCE]).select("before", name("src", "src_twin", "src_pos").alias("segment")).where("before <> segment")
    paths = chained(segments, stored(crossed, "crossings"))
    path = F.coalesce("path", "segment").alias("path")
    out = placed.join(paths, "segment", "left").select("l", "r", "src", path, (F.coalesce("offset", F.lit(0)) + F.col("place")).alias("place"))
    out = stored(out, "paths")
    forget(edges, links, placed)
    return out


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """(id, twin, spans, copy): word spans that windows of smaller ids cover, each (start, end, path, place on the path)."""
    rows = keyed(df, id_col, text).where("id IS NOT NULL AND text IS NOT NULL")
    copied = copies(rows)
    texts = candidates(rows, copied, width, core)
    edges = compacted(repeated_edges(repeatable(texts, width, core, once=True)))
    found = repeatable(texts, width, core, once=False)
    # each edge stands once among the edges, so hash tables of them are even
    hits = found.join(edges.hint("shuffle_hash"), ["l", "r"]).where("src < id").select(*KEY, "pos", "path", "place")
    # windows that walk along a path word by word
    along = Window.partitionBy(*KEY).orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    in_step = (before("pos") + 1 == F.col("pos")) & (before("path") == F.col("path")) & (before("place") + 1 == F.col("place"))
    spans = hits.withColumn("_new", F.coalesce(~in_step, F.lit(True))).withColumn("_span", F.count_if("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy(*KEY, "_span").agg(
        F.min("pos").cast("long").alias("start"), (F.max("pos") + width).cast("long").alias("end"), F.first("path").alias("path"), F.min("place").alias("place")
    )
    spans = merged.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", "path", "place")).alias("spans"))
    whole = copied.select(*KEY, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy"))
    return spans.withColumn("copy", F.lit(False)).unionByName(whole)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) of every row; kept holds the words that stay, joined by one space.
    The one span of a copy has no path."""
    if not 1 <= core <= width or width < 2:
        raise ValueError("a window has two words or more, and its core lies in it")
    spans = stored(repeated_spans(df, id_col, text, width, core), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            total, removed, kept = [], [], []
            listed = []
            for value, own, copy in zip(batch.column("text"), batch.column("spans"), batch.column("copy"), strict=True):
                parts = (value.as_py() or "").encode().split()  # at the six ASCII blanks
                total.append(len(parts))
                spans = sorted(own.as_py() or [], key=lambda s: s["start"])
                if copy.as_py() and len(parts) >= width:
                    spans = [{"start": 0, "end": len(parts), "path": None, "place": None}]
                listed.append(spans)
                out, at = [], 0
                for s in spans:
                    out += parts[at : s["start"]]
                    at = max(at, s["end"])
                out += parts[at:]
                removed.append(len(parts) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(listed, SPANS), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "spans", "kept"],
            )

    joined = keyed(df, id_col, text).join(spans, KEY, "left").select("id", "text", "spans", "copy")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, spans array<struct<start:long,end:long,path:long,place:long>>, kept string")
