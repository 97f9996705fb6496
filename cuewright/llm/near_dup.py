"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

1. A document's set is its distinct word shingles. Equal sets form one class;
   only one row of each class goes on.
2. A signature holds ``COMPONENTS`` minima of 16 bits. The distance of two
   signatures is the number of components in which they differ.
3. The components are split into ``CHUNKS`` chunks. Within the distance
   ``THRESHOLD`` = CHUNKS * (ERRORS + 1) - 1 some chunk has at most ``ERRORS``
   differing components (pigeonhole). Leaving out every choice of ``ERRORS``
   components of every chunk gives the keys of a signature; two signatures
   within the threshold share a key, always. At similarity 0.8 a pair is beyond
   the threshold with a probability of about 4e-6, at 0.85 of 4e-10.
4. Members of a key are linked with its smallest member (a star), pairs beyond
   the distance or the size ratio are dropped, the others are confirmed on the
   full sets. In keys whose members then still lie in several components, a
   second star goes to the member that shares most with all others: the centre
   of a group of near copies, if it has one. Keys that are still mixed are gone
   through in blocks: all members of different components are compared by
   signature, and what is within the distance is confirmed on the full sets. No
   link between two components is lost, and no key's pairs are ever written.

Ids are integers. Every row takes the component of its own set, so rows that
repeat an id with the same text agree. A row without an id is linked with
nothing (no component, kept); so is a text without words, null texts included.
Repeated rows are equal sets. An empty table gives an empty result; only the id
and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import components as connected
from .store import stored
from .textkit import LOWER, NOT_BLANK, mix, row_slices, run_starts, shingle_hashes, span_hashes, utf8, words

COMPONENTS = 128
CHUNKS = 24
ERRORS = 1
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
#: Members of a key that are compared in one piece, and shingles (8 bytes each) that they may have.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 21
#: Members of a piece from which on earlier keys are looked at before signatures.
CROWDED = 64
#: Documents to fetch whose numbers may be broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_RANDOM = np.random.default_rng(977)
_FLIP = _RANDOM.integers(0, 2**32, COMPONENTS, dtype=np.uint32)[:, None]
_TIMES = (_RANDOM.integers(0, 2**31, COMPONENTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its set."""
    body, at = utf8(texts)
    body = LOWER[body]
    starts, ends, rows = words(body, at, NOT_BLANK)
    hashes = span_hashes(body, starts, ends)
    cut = run_starts(rows, len(texts))
    for i in range(len(texts)):
        yield shingle_hashes(hashes[cut[i] : cut[i + 1]], width)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the set under COMPONENTS hash functions, cut to 16 bits."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(COMPONENTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 4096):
        np.minimum(low, (((short[None, k : k + 4096] ^ _FLIP) * _TIMES)).min(axis=1), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def set_marks(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size of a set and 128 bits of it."""
    total = np.array([shingles.sum(), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()]).astype(np.int64)
    return len(shingles), int(total[0]), int(total[1])


def signatures(df: DataFrame, id_col: str, text: str, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, s1, s2, sig, kept columns) per row: set size, 128 bits of the whole set, signature; null sig for an empty set."""

    def run(batches):
        for batch in row_slices(batches, "text"):
            found = []
            for shingles in shingle_sets(batch.column("text"), width):
                found.append((*set_marks(shingles), signature(shingles).tobytes()) if len(shingles) else (0, 0, 0, None))
            n, s1, s2, sig = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.binary()), *(batch.column(c) for c in keep)],
                ["id", "n", "s1", "s2", "sig", *keep],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), *keep)
    schema = T._parse_datatype_string("id long, n long, s1 long, s2 long, sig binary")
    return rows.mapInArrow(run, T.StructType([*schema.fields, *(rows.schema[c] for c in keep)]))


def _choices() -> list[tuple[int, int, list[tuple[int, ...]]]]:
    """Per chunk its first and last component and the components left out, in every choice."""
    edges = np.linspace(0, COMPONENTS, CHUNKS + 1).astype(int)
    return [(a, b, list(combinations(range(a, b), ERRORS))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def key_matrix(sigs: np.ndarray) -> np.ndarray:
    """(rows, keys): one 64-bit key per chunk and choice."""
    spread = mix(sigs.astype(np.uint64) + (np.arange(COMPONENTS, dtype=np.uint64) << np.uint64(16)))
    columns, salt = [], 0
    for a, b, choices in _choices():
        whole = spread[:, a:b].sum(axis=1, dtype=np.uint64)
        for left_out in choices:
            salt += 1
            columns.append(mix(whole - spread[:, list(left_out)].sum(axis=1, dtype=np.uint64) + np.uint64(salt)))
    return np.stack(columns, axis=1)


def unpack(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, COMPONENTS)


def keys(reps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = key_matrix(unpack(part.column("sig").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(part.column("id").to_numpy(), found.shape[1]))], ["key", "id"]
                )

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def within_distance(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes can reach 0.8 and whose signatures are within the threshold."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                apart = (unpack(batch.column("sig_a").to_pylist()) != unpack(batch.column("sig_b").to_pylist())).sum(axis=1)
                yield batch.filter(pa.array(apart <= THRESHOLD)).select(["a", "b"])

    return pairs.join(left, "a").join(right, "b").where(sizes_fit("n_a", "n_b")).mapInArrow(run, "a long, b long")


def sizes_fit(n_a: str, n_b: str, percent: int = 80):
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            packed_a, packed_b = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                a = np.frombuffer(packed_a[i].as_buffer(), np.uint64)
                b = np.frombuffer(packed_b[i].as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * shared >= percent * (len(a) + len(b) - shared)
            yield batch.filter(pa.array(good)).select(["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def full_sets(df: DataFrame, id_col: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted classes (id, rep, s1); 64-bit hashes, packed.

    A class is read from the rows with the id of its first member; of several
    texts under that id, the one whose set is the class's.
    """

    def run(batches):
        for batch in row_slices(batches, "text"):
            sets, own = [], batch.column("s1").to_pylist()
            for shingles, s1 in zip(shingle_sets(batch.column("text"), width), own, strict=True):
                sets.append(shingles.tobytes() if len(shingles) and set_marks(shingles)[1] == s1 else None)
            found = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])
            yield found.filter(found.column("shingles").is_valid())

    rows = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text).alias("text"))
    wanted = stored(wanted, "wanted")
    small = wanted.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(wanted) if small else wanted, "rep").select("id", "s1", "text").mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"])


def contested(open_rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of mixed keys, dealt into pieces of two blocks, that have a partner in their piece.

    Partners are of different components and within the distance. A pair counts
    only in the first key that it shares.
    """
    rows = open_rows.join(reps.select("id", "n", "sig"), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "id", "root", "block", "n", "sig", other)
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "root", "block", "n", "sig")
    return rows.repartition(*PIECE).sortWithinPartitions(*PIECE, "root", "id").mapInArrow(by_piece(_partnered), rows.schema)


def joining_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on the full sets; a piece gives only links that join what it had not joined yet."""
    dealt = rows.join(sets, "id").repartition(*PIECE).sortWithinPartitions(*PIECE, "root", "id")

    def links(piece, group):
        yield from _linked(piece, group, percent)

    return dealt.mapInArrow(by_piece(links), "a long, b long").distinct()


PIECE = ("key", "low", "high")
#: Bytes of rows that are gone through at once, if they are several pieces.
TOGETHER = 4 << 20


def by_piece(work):
    """An Arrow function that hands whole pieces to ``work``, which gets sorted rows and the piece of each."""

    def run(batches):
        rest = None
        for batch in (part for b in batches for part in _slices(b)):
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = _groups(rest)
            # the last piece may go on in the next batch
            full = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if full:
                yield from work(rest.slice(0, full), group[:full])
                rest = rest.slice(full)
        if rest is not None and rest.num_rows:
            yield from work(rest, _groups(rest))

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, TOGETHER * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _groups(rows: pa.Table) -> np.ndarray:
    """Number of the piece of each row; rows are sorted by it."""
    marks = np.stack([rows.column(c).to_numpy() for c in PIECE])
    return np.cumsum(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(axis=0)])) if rows.num_rows else np.zeros(0, int)


def _behind(group: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row where the rows of other roots behind it begin, and where its piece ends; rows are sorted by root."""
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (root[1:] != root[:-1])])
    return np.append(np.flatnonzero(fresh)[1:], len(group))[np.cumsum(fresh) - 1], np.searchsorted(group, group, "right")


def _first_shared(keys_one: np.ndarray, keys_two: np.ndarray) -> np.ndarray:
    shared = (keys_one == keys_two).argmax(axis=1)
    return np.take_along_axis(np.broadcast_to(keys_one, keys_two.shape), shared[:, None], 1)[:, 0].view(np.int64)


def _met_before(key: np.ndarray, named: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """128 bits per row: a bit for each key before this one whose middle value in the piece the row has.

    Two rows with a common bit share an earlier key, so they are no pair here. In
    a piece of near copies most keys have one common value. Small pieces have no bits.
    """
    bits = np.zeros((len(group), 16), np.uint8)
    for low in np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])):
        high = ends[low]
        if high - low >= CROWDED:
            before = int((named[low].view(np.int64) == key[low]).argmax())
            if before:
                earlier = named[low:high, :before]
                middle = np.partition(earlier, (high - low) // 2, axis=0)[(high - low) // 2]
                same = np.packbits(earlier == middle, axis=1)
                bits[low:high, : same.shape[1]] = same
    return bits.view(np.uint64)


def _partnered(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with a partner. A row meets only those behind its own root's rows, step by step, all rows at once."""
    key, root, n, block = (rows.column(c).to_numpy() for c in ("key", "root", "n", "block"))
    mixed = rows.column("low").to_numpy() != rows.column("high").to_numpy()
    sigs = unpack(rows.column("sig").to_pylist())
    firsts, ends = _behind(group, root)
    hit = np.zeros(len(group), bool)
    live = np.arange(len(group))
    named = key_matrix(sigs)
    met = _met_before(key, named, ends, group)
    for step in range(len(group)):
        live = live[firsts[live] + step < ends[live]]
        if not len(live):
            break
        one, two = live, firsts[live] + step
        new = ~((met[one, 0] & met[two, 0]) | (met[one, 1] & met[two, 1])).astype(bool)
        one, two = one[new], two[new]
        fit = (100 * np.minimum(n[one], n[two]) >= 80 * np.maximum(n[one], n[two]))
        fit &= ~mixed[one] | (block[one] != block[two])
        fit &= ~(hit[one] & hit[two])
        one, two = one[fit], two[fit]
        if len(one):
            close = (sigs[one] != sigs[two]).sum(axis=1) <= THRESHOLD
            one, two = one[close], two[close]
        if len(one):
            here = _first_shared(named[one], named[two]) == key[one]
            hit[one[here]] = hit[two[here]] = True
    yield from rows.filter(pa.array(hit)).to_batches()


def _linked(rows: pa.Table, group: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components of a piece, by full sets; what a link has joined is one component from then on."""
    key, ids, root, n, block = (rows.column(c).to_numpy() for c in ("key", "id", "root", "n", "block"))
    mixed = rows.column("low").to_numpy() != rows.column("high").to_numpy()
    sigs = unpack(rows.column("sig").to_pylist())
    named = key_matrix(sigs)
    firsts, ends = _behind(group, root)
    packed = rows.column("shingles").combine_chunks()
    a, b = [], []
    for low in np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])):
        high = ends[low]
        sets = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in range(low, high)]
        words_, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.cumsum([0, *map(len, sets)])
        mark = np.zeros(len(words_), bool)
        part = np.unique(root[low:high], return_inverse=True)[1]
        for i in range(low, high):
            other = np.arange(firsts[i], high)
            other = other[part[other - low] != part[i - low]]
            fit = 100 * np.minimum(n[i], n[other]) >= 80 * np.maximum(n[i], n[other])
            if mixed[i]:
                fit &= block[other] != block[i]
            other = other[fit]
            other = other[(sigs[other] != sigs[i]).sum(axis=1) <= THRESHOLD]
            if len(other):
                other = other[_first_shared(named[i : i + 1], named[other]) == key[i]]
            if not len(other):
                continue
            own = numbers[at[i - low] : at[i - low + 1]]
            mark[own] = True
            for j in other:
                if part[j - low] == part[i - low]:
                    continue
                both = int(np.count_nonzero(mark[numbers[at[j - low] : at[j - low + 1]]]))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
                    part[part == part[j - low]] = part[i - low]
            mark[own] = False
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def with_roots(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the smallest id of their component so far, and the components."""
    roots = stored(connected(links, "a", "b"), "roots")
    named = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return named.withColumn("root", F.coalesce("root", "id")), roots


def mixed_rows(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, members, root) of the keys whose members lie in several components."""
    named = stored(with_roots(shared.select("key", "id", "members"), links)[0], "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    return stored(named.join(mixed, "key", "left_semi"), "mixed")


def central_star(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, b being the member of a key with most members in all its keys."""
    weight = rows.groupBy("id").agg(F.sum("members").alias("weight"))
    centre = rows.join(weight, "id").groupBy("key").agg(
        F.max_by(F.struct(F.col("id").alias("b"), F.col("root").alias("root_b")), F.struct("weight", "id")).alias("centre")
    )
    return rows.join(centre, "key").where("root <> centre.root_b").select(F.col("id").alias("a"), F.col("centre.b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_shingles, component_id, kept, ``keep`` columns), one row per input row.

    ``component_id`` is the smallest id that links reach, the row's own if it has
    none; ``kept`` says that it is the row's own. ``percent`` may be 80 or more:
    the threshold of the signatures is made for that. ``keep`` may not name a
    column of the result.
    """
    if percent < 80:
        raise ValueError("the signature threshold is made for a similarity of 0.8 or more")
    marks = stored(signatures(df, id_col, text, width, keep), "marks")
    classes = marks.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(
        F.min("id").alias("rep"), F.min("sig").alias("sig")
    )
    # numbered as it is written: every reader sees the same numbers
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("id", "n", "sig")
    every = keys(reps)
    leaders = every.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(every.join(leaders, "key"), "keys")
    star = shared.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    near = stored(within_distance(star, reps), "near")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids.distinct(), "id", "left_semi").select("id", "rep", "s1")
        return stored(full_sets(df, id_col, text, width, wanted), "sets")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    near_sets = sets_of(ends_of(near))
    links = stored(confirmed(near.groupBy("a").agg(F.min("b").alias("b")), near_sets, percent), "links")
    left, roots = with_roots(near.withColumnRenamed("a", "id"), links)
    side = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    apart = left.join(side, "b", "left").where(F.col("root") != F.coalesce("root_b", "b")).select(F.col("id").alias("a"), "b")
    links = stored(links.unionByName(confirmed(apart, near_sets, percent)), "links")
    central = stored(within_distance(central_star(mixed_rows(shared, links)), reps), "central")
    links = stored(links.unionByName(confirmed(central, sets_of(ends_of(central)), percent)), "links")
    rest = stored(contested(mixed_rows(shared, links), reps), "rest")
    links = stored(links.unionByName(joining_links(rest, sets_of(rest.select("id")), percent)), "links")
    final = stored(connected(links, "a", "b"), "roots").withColumnsRenamed({"node": "id", "root": "_root"})
    named = classes.select("n", "s1", "s2", "id", "rep").join(final, "id", "left").withColumn("_root", F.coalesce("_root", "id"))
    smallest = named.groupBy("_root").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "_root").select("n", "s1", "s2", "component_id")
    joined = marks.drop("sig").join(named, ["n", "s1", "s2"], "left")
    own = F.coalesce(F.when(F.col("id").isNotNull(), F.col("component_id")), F.col("id")).alias("component_id")
    return joined.select("id", F.col("n").alias("n_shingles"), own, *keep).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    )
