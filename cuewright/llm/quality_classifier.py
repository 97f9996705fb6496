"""Ordinal cumulative-link regression on hashed text.

P(grade >= k) = sigmoid(x . w - b_k): all grades share the weights ``w`` of the
hashed features, the thresholds b_1 < b_2 < ... tell the grades apart. From them
follow the expected grade and the tail probability of a wanted grade.

Features are sets: hashed words, and hashed bins of a few ratios of the text
(shouted words, words that end in signs, echoes, length). A feature takes part
only if its association with the grades is beyond chance (``Z``), so that long
texts do not gather noise.

The fit uses at most ``SAMPLE`` labelled documents, drawn by a hash of their id,
each text once. Scoring covers every row. Null or empty text has only its ratio
features. A null grade is no label. Without labels every row has null grades and
is kept. Ties and repeated rows score alike; an empty table gives an empty
result. Extra columns pass through; columns with the results' names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .textkit import LETTER_OR_DIGIT, LOWER, NOT_BLANK, mix, row_slices, span_hashes, utf8, words

#: Production parameters: bound of the labelled sample, hashed features, screening level, penalty, least tail probability.
SAMPLE = 20_000
BITS = 20
Z = 4.5
PENALTY = 1.0
LEAST_TAIL = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#*$%&|<>!=~^"]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, by row."""
    n = len(texts)
    body, at = utf8(texts)
    low = LOWER[body]
    starts, ends, rows = words(low, at, LETTER_OR_DIGIT)
    hashed = (span_hashes(low, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    starts, ends, owner = words(body, at, NOT_BLANK)
    count = np.bincount(owner, minlength=n)
    signs = np.bincount(owner[_SIGN[body[ends - 1]]] if len(ends) else owner, minlength=n)
    letters = np.bincount(np.searchsorted(at, np.flatnonzero(_LETTER[body]), "right") - 1, minlength=n)
    upper = np.bincount(np.searchsorted(at, np.flatnonzero(_UPPER[body]), "right") - 1, minlength=n)
    whole = span_hashes(low, starts, ends)
    same = np.flatnonzero((whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])) + 1
    echoes = np.bincount(owner[same], minlength=n)
    shares = [signs / np.maximum(count, 1), upper / np.maximum(letters, 1), echoes / np.maximum(count, 1)]
    bins = [np.ceil(s * 16).astype(np.int64) for s in shares] + [np.ceil(2 * np.log2(count + 1)).astype(np.int64)]
    extra = [(mix((np.uint64(k + 1) << np.uint64(32)) + b.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64) for k, b in enumerate(bins)]
    pairs = np.concatenate([(rows << BITS) | hashed, *[(np.arange(n) << BITS) | e for e in extra]])
    pairs = np.unique(pairs)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    chosen: np.ndarray  # features that take part, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # empty: no labels

    def tails(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """(n, grades - 1): P(grade >= k) for k = 1, 2, ..."""
        at = np.minimum(np.searchsorted(self.chosen, found), max(0, len(self.chosen) - 1))
        value = np.where(self.chosen[at] == found, self.weights[at], 0.0) if len(self.chosen) else np.zeros(len(found))
        latent = np.bincount(rows, weights=value, minlength=n)
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam over the whole sample.

    Thresholds are a first one and positive gaps, so their order always holds.
    """
    top = int(grades.max())
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    first = np.log(1 / share - 1)
    gaps = np.log(np.maximum(np.diff(first), 1e-3))
    theta = np.concatenate([np.zeros(width), first[:1], gaps])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grades)
    for step in range(1, rounds + 1):
        w, raw = theta[:width], theta[width:]
        b = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        latent = np.bincount(rows, weights=w[columns], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(latent[:, None] - b[None, :], -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)[np.arange(n), grades]
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        slope = (upper * (1 - upper) - lower * (1 - lower)) / p  # of log p in the latent
        grad_w = np.bincount(columns, weights=slope[rows], minlength=width) - penalty * w
        grad_b = np.zeros(top)
        for k in range(top):
            one = s[:, k] * (1 - s[:, k]) / p
            grad_b[k] = (-one[grades == k + 1]).sum() + one[grades == k].sum()
        scale = np.concatenate([[1.0], np.exp(raw[1:])])
        grad = np.concatenate([grad_w, np.array([grad_b[k:].sum() for k in range(top)]) * scale]) / n
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    raw = theta[width:]
    return theta[:width], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def associated(hits: np.ndarray, seen: np.ndarray, shares: np.ndarray, n: int, z: float) -> np.ndarray:
    """Which features have a share of some upper grade that differs from all documents' share by ``z`` deviations.

    ``seen`` documents of ``n`` have the feature; ``hits[k]`` of them have a grade above k, as ``shares[k]`` of all.
    """
    strongest = np.zeros(len(seen))
    for of, share in zip(hits, shares, strict=True):
        spread = np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / (n + 1.0)), 1e-9))
        strongest = np.maximum(strongest, (np.abs(of - seen * share) - 0.5) / spread)
    return (strongest >= z) & (seen >= 3)


def screened(taken: DataFrame, grades: np.ndarray, z: float) -> np.ndarray:
    """The features that take part, sorted: rows (grade, features) are counted in tasks, and only those come to the driver."""
    n, shares = len(grades), np.array([(grades >= k).mean() for k in range(1, int(grades.max()) + 1)])

    def counted(batches):
        for batch in row_slices(batches, "features"):
            parts = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("features").to_pylist()]
            of = np.repeat(np.asarray(batch.column("grade"), dtype=np.int64), [len(x) for x in parts])
            pairs, count = np.unique((of << BITS) | np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs & ((1 << BITS) - 1)), pa.array((pairs >> BITS).astype(np.int32)), pa.array(count.astype(np.int64))], ["feature", "grade", "n"])

    def judged(batches):
        for batch in batches:
            lists = batch.column("counts")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            entries = lists.flatten()
            grade, count = (np.asarray(entries.field(c), dtype=np.int64) for c in ("grade", "n"))
            hits = [np.bincount(owner, weights=np.where(grade >= k, count, 0), minlength=batch.num_rows) for k in range(1, len(shares) + 1)]
            seen = np.bincount(owner, weights=count, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("feature").filter(pa.array(associated(hits, seen, shares, n, z)))], ["feature"])

    counts = taken.select("grade", "features").mapInArrow(counted, "feature long, grade int, n long").groupBy("feature", "grade").agg(F.sum("n").alias("n"))
    found = counts.groupBy("feature").agg(F.collect_list(F.struct("grade", "n")).alias("counts")).mapInArrow(judged, "feature long")
    return np.array(sorted(row["feature"] for row in found.toLocalIterator()), np.int64)  # at most 2**BITS


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents; ``labels`` has the id and a grade 0, 1, 2, ..."""
    wanted = (
        labels.select(F.col(id_col).alias("id"), F.col(grade).cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
        .dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    # at most `sample` small rows
    graded = rows.join(F.broadcast(wanted), "id").dropDuplicates(["id"])

    def run(batches):
        for batch in row_slices(batches, "text"):
            owner, found = features(batch.column("text"))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            body = [found[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("grade"), pa.array(body, pa.binary())], ["id", "grade", "features"])

    taken = stored(graded.select("id", "grade", "text").mapInArrow(run, "id string, grade int, features binary"), "labelled")
    # one row per distinct text, so that a group of copies weighs no more than one of them
    taken = stored(taken.groupBy("features").agg(F.min_by("grade", "id").alias("grade"), F.min("id").alias("id")), "distinct")
    grades = np.array([row["grade"] for row in taken.select("grade").toLocalIterator()], np.int64)
    if len(grades) == 0 or grades.max() < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    chosen = screened(taken, grades, Z)

    def places(batches):
        """Of each row's features the chosen ones, by their place among those."""
        for batch in batches:
            body = []
            for x in batch.column("features").to_pylist():
                own = np.frombuffer(x, "<u4").astype(np.int64)
                at = np.searchsorted(chosen, own)
                body.append(at[np.append(chosen, -1)[at] == own].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(body, pa.binary())], ["id", "grade", "places"])

    found, grades = [], []
    for row in taken.select("id", "grade", "features").mapInArrow(places, "id string, grade int, places binary").orderBy("id").toLocalIterator():  # bounded by `sample`
        found.append(np.frombuffer(row["places"], "<u4"))
        grades.append(row["grade"])
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    columns = np.concatenate(found).astype(np.int64)
    del found
    weights, thresholds = fit_ordinal(owner, columns, np.array(grades, np.int64), len(chosen))
    return Model(chosen, weights, thresholds)


RESULTS = ("expected_grade", "tail", "kept")


def grade_documents(df: DataFrame, model: Model, text: str = "text", wanted: int | None = None, least: float = LEAST_TAIL) -> DataFrame:
    """Adds expected_grade, tail = P(grade >= wanted) and kept = (tail >= least). ``wanted`` is the top grade by default."""
    known = [f for f in df.schema.fields if f.name not in RESULTS]
    schema = T.StructType([*known, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def run(batches):
        m = sent.value
        for batch in row_slices(batches, text):
            n = batch.num_rows
            if len(m.thresholds):
                tails = m.tails(*features(batch.column(text)), n)
                tail = tails[:, (wanted or len(m.thresholds)) - 1]
                scores = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= least)]
            else:
                scores = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in known], *scores], [f.name for f in schema.fields])

    return df.select(*[f"`{f.name}`" for f in known]).mapInArrow(run, schema)
