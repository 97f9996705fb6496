"""How filters interact: every order in which they can be applied, step by step.

Each document gets one bit per filter that it fails. Documents then collapse
into cells (part, mask) with their counts, a bounded number per part. A
recursive CTE extends filter prefixes by every letter not used yet, carries the
bits applied so far and joins the mask cells: each level of the recursion says
for its step and every mask whether such documents are removed here, were
removed before, or stay. Joined with the counts this gives the metrics of all
orders. The recursion depends on the filters alone (at most 325 prefixes times
32 masks), never on the number of documents or parts.

Filters: A fewer than ``MIN_WORDS`` words; B 100 * distinct words < 50 * words;
C 100 * A-Z characters > 2 * code points; D any of ``#$%&*|``; E the text equals
that of a smaller id anywhere in the table, removed or not.

A null text is an empty one, a null part the empty string. Rows that repeat an
id with one text are not copies of each other. A row without an id is no one's
original, and a copy if any row with an id has its text. Several labels of one
id count once each kind (good if any says so, toxic likewise); a document
without labels is neither. Only the named columns are read, so others cannot
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .textkit import NOT_BLANK, row_slices, span_hashes, utf8, words

LETTERS = "ABCDE"
# The limits of the filters.
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
#: Bytes that begin a code point.
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D for each text."""
    body, at = utf8(texts)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    starts, ends, row = words(body, at, NOT_BLANK)
    hashes = span_hashes(body, starts, ends)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    rows = len(at) - 1
    n_words = np.bincount(row, minlength=rows)
    distinct = np.bincount(r[fresh], minlength=rows)
    fails = (
        n_words < MIN_WORDS,
        100 * distinct < DISTINCT_PERCENT * n_words,
        100 * per_row(_UPPER[body]) > UPPER_PERCENT * per_row(_HEAD[body]),
        per_row(_SYMBOL[body]) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def masked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, digest, mask): bits A to D, and a digest by which equal texts meet."""

    def run(batches):
        for batch in row_slices(batches, "text"):
            digests = [hashlib.sha256((t.as_py() or "").encode()).digest() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(text_masks(batch.column("text")), pa.int32())],
                ["id", "part", "digest", "mask"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; at most 32 rows a part."""
    rows = stored(masked(docs, id_col, text, part), "masked")
    # the first of each text that occurs more than once; written, so that a hot text's join can be split
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL")
    firsts = stored(firsts.select("digest", "first"), "firsts")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    copy = F.col("first").isNotNull() & F.coalesce(F.col("id") > F.col("first"), F.lit(True))
    judged = rows.join(firsts, "digest", "left").join(marks, "id", "left")
    return judged.groupBy("part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


#: ``before`` are the bits applied by earlier steps; one row per prefix and mask that occurs.
WALK = """
WITH RECURSIVE walk (prefix, before, applied, step, letter, bit, mask) AS (
  SELECT '', 0, 0, 0, '', 0, c.mask FROM {cells} AS c WHERE c.bit = 1
  UNION ALL
  SELECT concat(w.prefix, c.letter), w.applied, w.applied | c.bit, w.step + 1, c.letter, c.bit, c.mask
  FROM walk AS w JOIN {cells} AS c ON c.mask = w.mask AND (w.applied & c.bit) = 0
)
SELECT prefix, step, letter, mask,
  (mask & applied) = 0 AS kept,
  (mask & before) = 0 AND (mask & bit) <> 0 AS removed,
  (mask & before) <> 0 AND (mask & bit) <> 0 AS redundant,
  mask = bit AS alone
FROM walk WHERE step > 0
"""


def walks(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What every step of every prefix does to every mask; the recursion joins on masks, each with all its letters."""
    named = F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << k).alias("bit")) for k, x in enumerate(letters)]))
    cells = masks.withColumn("named", named).select("mask", "named.letter", "named.bit")
    return masks.sparkSession.sql(WALK, cells=cells)


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all letters, and step, from the cells."""
    counted = stored(counted, "cells")
    # one row per mask, 2 ** len(letters) at most
    masks = stored(counted.select("mask").distinct().coalesce(1), "masks")
    walked = stored(walks(masks, letters).coalesce(1), "walks")
    total = lambda flag, n: F.coalesce(F.sum(F.when(F.col(flag), F.col(n))), F.lit(0)).cast("long")
    steps = counted.join(F.broadcast(walked), "mask").groupBy("part", "prefix", "step", "letter").agg(
        total("kept", "n").alias("kept"), total("removed", "n").alias("removed"), total("redundant", "n").alias("redundant"),
        total("alone", "n").alias("unique_fails"), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
    )
    # every whole order with its own prefixes: 600 rows for five letters
    orders = walked.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("left(filter_order, step)")).drop("step")
    whole = steps.join(F.broadcast(orders), "prefix")
    # a letter's rows in one part: one per order
    return whole.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    return interactions(cells(docs, labels, id_col, text, part))
