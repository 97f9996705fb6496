"""Removal of long byte strings that occur more than once, by sorted suffixes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere
else goes. Strings are judged on the input, and never cross documents.

1. The start of a string is owned by the smallest hash of ``GRAM`` bytes within
   the next ``WINDOW`` starts (its anchor). Equal strings have equal anchors at
   equal distance, so only anchors need to be matched first.
2. All strings of an anchor contain the same core. A core that occurs once ends
   the matter. Where two anchors agree on all bytes of all their strings, all of
   those are repeats. What is left are anchors with a repeated core and bytes of
   their own, near the ends of repeats.
3. The suffixes at the strings of these anchors, and of one representative of
   each variant of their cores, are sorted: each task sorts its own into runs and
   front-codes them (shared prefix length, rest). The runs are exchanged by core
   and merged by a loser tree that keeps prefix lengths, so known prefixes are
   never compared again. Neighbours that share ``LENGTH`` bytes are repeats. A core
   with many variants (``HOT``) is dealt out further by both ends of the strings:
   equal strings still meet.

Ids are integers. A row is known by its id (null or not) and 64 bits of its text,
so rows of one id keep spans of their own, and rows without an id take part like
all others. Rows that repeat id and text repeat each other in full. Null text is
empty text. An empty table gives an empty result; only the id and the text are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .textkit import _BACK, _BYTE, _STEP, _power, mix, row_slices, utf8

LENGTH = 400
GRAM = 16
WINDOW = 128
#: Suffixes that a task sorts at once, and that a bucket of runs should hold.
RUN = 60_000
BUCKET = 200_000
#: Variants of a core beyond which its strings are dealt out by their ends, too.
HOT = 1000
#: What a row is known by.
KEY = ("id", "mark")


def anchors(body: np.ndarray, at: np.ndarray, length: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, place, farthest, nearest, core, whole) of each anchor; places count from the row's start.

    It owns the strings that start ``nearest`` to ``farthest`` bytes before it.
    """
    n = len(body)
    ends = np.repeat(at[1:], np.diff(at))
    starts = np.flatnonzero(np.arange(n) + length <= ends) if n else np.zeros(0, np.int64)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[body] * _power("up", _STEP, n), out=sums[1:])
    back = _power("down", _BACK, n + 1)

    def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * back[a])

    places = np.arange(n - gram + 1)
    hashes = spans(places, places + gram) >> np.uint64(32)
    # smallest hash first, the last of equal ones; a window never spans 2**32 bytes
    order = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - places.astype(np.uint64))
    padded = np.full((-(-len(order) // window) + 1) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(order)] = order
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + window - 1])
    owner = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(starts) != 1)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    place = owner[first]
    far, near = place - starts[first], place - starts[last]
    core = spans(place, place + length - window + 1)
    whole = mix(spans(place - far, place - near + length) + (far.astype(np.uint64) << np.uint64(20)) + near.astype(np.uint64))
    row = np.searchsorted(at, place, "right") - 1
    return row, place - at[row], far, near, core.view(np.int64), whole.view(np.int64)


def all_anchors(rows: DataFrame, length: int, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in row_slices(batches, "text"):
            row, place, far, near, core, whole = anchors(*utf8(batch.column("text")), length, window, gram)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("mark").take(pa.array(row)), pa.array(place, pa.int32()),
                 pa.array(far, pa.int16()), pa.array(near, pa.int16()), pa.array(core, pa.int64()), pa.array(whole, pa.int64())],
                ["id", "mark", "place", "far", "near", "core", "whole"],
            )

    return rows.mapInArrow(run, "id long, mark long, place int, far short, near short, core long, whole long")


def front_coded(strings: list[bytes], length: int) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths of sorted strings with the one before, and all rests in a row."""
    table = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, length)
    differ = table[1:] != table[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    lengths = np.concatenate([[0], shared]).astype(np.uint16)
    return lengths, b"".join([s[k:] for s, k in zip(strings, lengths.tolist(), strict=True)])


def run_strings(shared: list[int], rests: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(shared prefix length, string) of a front-coded run."""
    before, at = b"", 0
    for k in shared:
        before = before[:k] + rests[at : at + length - k]
        at += length - k
        yield k, before


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one length, of which ``known`` bytes are known to agree."""
    x = int.from_bytes(a[known:]) ^ int.from_bytes(b[known:])
    return len(a) - (x.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, length of the prefix shared with the string before) in sorted order of all strings.

    A loser tree. Every waiting string knows how much it shares with the last
    winner of its node. The longer shared prefix wins; bytes are compared only
    at equal lengths, and only behind them.
    """
    n = 1
    while n < len(runs):
        n *= 2
    done = (-1, b"")
    heads: list[tuple[int, bytes]] = [next(r, done) for r in runs] + [done] * (n - len(runs))
    losers = [0] * n

    def play(one: int, two: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes what it shares with the winner."""
        (k1, s1), (k2, s2) = heads[one], heads[two]
        if k1 != k2:
            return (one, two) if k1 > k2 else (two, one)
        if k1 < 0:
            return one, two
        k = common(s1, s2, k1)
        if s1[k:] <= s2[k:]:
            heads[two] = (k, s2)
            return one, two
        heads[one] = (k, s1)
        return two, one

    # first round: nothing is known yet
    for i, (k, s) in enumerate(heads):
        if k >= 0:
            heads[i] = (0, s)
    level = list(range(n))
    at = n // 2
    while len(level) > 1:
        pairs = [play(a, b) for a, b in zip(level[::2], level[1::2], strict=True)]
        for k, (_, lost) in enumerate(pairs):
            losers[at + k] = lost
        level = [won for won, _ in pairs]
        at //= 2
    winner = level[0]
    while heads[winner][0] >= 0:
        yield winner, heads[winner][0]
        heads[winner] = next(runs[winner], done)
        node = (winner + n) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def sorted_runs(rows: DataFrame, length: int, buckets: int, hot: int) -> DataFrame:
    """(bucket, run) blobs of the suffixes that ``todo`` names: front-coded, with their places."""
    def flush(strings: list[bytes], where: list[tuple[int, int, int]], cores: list[int]):
        order = sorted(range(len(strings)), key=strings.__getitem__)
        dealt: dict[int, list[int]] = {}
        for i in order:
            dealt.setdefault(cores[i] % buckets, []).append(i)
        for bucket, part in dealt.items():
            shared, rests = front_coded([strings[i] for i in part], length)
            places = np.array([where[i] for i in part], np.int64).T
            body = zstandard.ZstdCompressor(level=3).compress(shared.tobytes() + places.tobytes() + rests)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([body], pa.binary())], ["bucket", "n", "run"])

    def run(batches):
        strings: list[bytes] = []
        where: list[tuple[int, int, int]] = []
        cores: list[int] = []
        for batch in batches:
            for doc, mark, text, todo in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("text"), batch.column("todo"), strict=True):
                body = (text.as_py() or "").encode()
                for item in todo.as_py():
                    for start in range(item["place"] - item["far"], item["place"] - item["near"] + 1):
                        s = body[start : start + length]
                        if len(s) < length:
                            continue
                        core = item["core"]
                        if item["variants"] > hot:
                            core = xxhash.xxh64_intdigest(s[:8] + s[-8:], core & 0xFFFFFFFF)
                        strings.append(s)
                        where.append((doc, mark, start))
                        cores.append(core)
                    if len(strings) >= RUN:
                        yield from flush(strings, where, cores)
                        strings, where, cores = [], [], []
        if strings:
            yield from flush(strings, where, cores)

    return rows.mapInArrow(run, "bucket long, n long, run binary")


def merged_repeats(runs: DataFrame, length: int) -> DataFrame:
    """(id, mark, start) of every suffix whose first ``length`` bytes occur more than once."""
    def finish(parts: list[tuple[int, bytes]]):
        iterators, places = [], []
        for n, packed in parts:
            body = zstandard.ZstdDecompressor().decompress(packed)
            places.append(np.frombuffer(body, np.int64, 3 * n, 2 * n).reshape(3, n))
            iterators.append(run_strings(np.frombuffer(body, np.uint16, n).tolist(), body[26 * n :], length))
        taken = [0] * len(iterators)
        out, last = [], None
        for run, shared in merge(iterators):
            k = taken[run]
            taken[run] += 1
            if last is not None and shared >= length:
                if last:
                    out.append(places[last[0]][:, last[1]])
                out.append(places[run][:, k])
                last = ()
            else:
                last = (run, k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(out, np.int64).reshape(-1, 3).T.copy()], [*KEY, "start"])

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for b, n, packed in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if b != bucket and parts:
                    yield from finish(parts)
                    parts = []
                bucket = b
                parts.append((n, packed))
        if parts:
            yield from finish(parts)

    return runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, mark long, start long")


def repeats(rows: DataFrame, length: int, window: int, gram: int, hot: int) -> DataFrame:
    """(id, mark, spans) of all rows (id, mark, text) with repeats; spans are (start, end) byte pairs that may overlap."""
    core = Window.partitionBy("core")
    variant = Window.partitionBy("core", "whole")
    found = all_anchors(rows, length, window, gram).repartition("core")
    found = found.withColumn("n_core", F.count(F.lit(1)).over(core)).where("n_core > 1")
    found = found.withColumn("n_whole", F.count(F.lit(1)).over(variant)).withColumn("nth", F.row_number().over(variant.orderBy(*KEY, "place")))
    # per core: how many variants, and whether one of them stands alone
    found = found.withColumn("variants", F.sum((F.col("nth") == 1).cast("long")).over(core)).withColumn("single", F.min("n_whole").over(core) == 1)
    found = stored(found.select(*KEY, "place", "far", "near", "core", "n_whole", "nth", "variants", "single"), "anchors")
    sure = found.where("n_whole > 1").select(*KEY, (F.col("place") - F.col("far")).cast("long").alias("start"), (F.col("place") - F.col("near") + length).cast("long").alias("end"))
    open_ones = found.where("single AND nth = 1 AND variants > 1")
    total = open_ones.agg(F.sum(F.col("far") - F.col("near") + 1)).first()[0] or 0
    todo = open_ones.groupBy(*KEY).agg(F.collect_list(F.struct("place", "far", "near", "core", "variants")).alias("todo"))
    runs = sorted_runs(rows.join(todo, [*KEY]), length, max(1, -(-total // BUCKET)), hot)
    more = merged_repeats(runs, length).select(*KEY, "start", (F.col("start") + length).alias("end"))
    return sure.unionByName(more).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_suffixes(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, removed, kept) of every row: removed byte spans, merged, and the bytes that stay."""
    if window + gram - 1 > length:
        raise ValueError("a window of starts and its last gram must fit into the length")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    # a row without an id goes by 0, and by other bits than a row with the id 0
    rows = rows.withColumn("mark", F.xxhash64("text", F.col("id").isNull()))
    key = F.coalesce("id", F.lit(0).cast("long"))
    spans = stored(repeats(rows.where("text IS NOT NULL").select(key.alias("id"), "mark", "text"), length, window, gram, hot), "spans")

    def run(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for value, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                body = (value.as_py() or "").encode()
                out = union_of([(s["start"], s["end"]) for s in own.as_py() or []])
                parts, at = [], 0
                for a, b in out:
                    parts.append(body[at:a])
                    at = b
                sizes.append(len(body))
                removed.append([{"start": a, "end": b} for a, b in out])
                kept.append(b"".join([*parts, body[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "removed", "kept"],
            )

    joined = rows.withColumn("_key", key).join(spans.withColumnRenamed("id", "_key"), ["_key", "mark"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, "id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
