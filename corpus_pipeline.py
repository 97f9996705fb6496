"""From raw documents to token ids: five stages, each on all that the one before kept.

1. quality: documents that the ordinal classifier rejects go.
2. lines: lines that spread over many sites stay once; a document that loses all its words goes.
3. near duplicates: one document of each group stays (five words, similarity of 0.8 or more).
4. decontamination: benchmark passages are cut out; a document that loses all its words goes.
5. tokens: SentencePiece ids, packed as little-endian uint16.

All stages but the last return the columns of documents; ``n_chars`` follows the
text. Documents without an id pass stage 3 as they are. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, line_dedup, near_dup, quality_classifier, sentence_pieces
from cuewright.llm.queries import graded_labels, table
from cuewright.llm.store import stored

WORDS = r"[^\x20\x09-\x0D]"


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit(docs, graded_labels(spark, sf_dir))
    return quality_classifier.grade_documents(docs, model).where("kept").select(*docs.columns)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(WORDS)))
    return with_length(cleaned.select(*docs.columns))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.withColumn("_text", F.xxhash64("text"))
    kept = near_dup.near_duplicates(rows, width=5, percent=80, keep=("_text",)).where("kept AND id IS NOT NULL")
    kept = kept.select(F.col("id").alias("_id"), F.col("_text").alias("_hash")).distinct()
    # a row that repeats id and text is a copy too
    rows = rows.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    once = rows.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)
    return once.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    cut = found.withColumn("text", decontaminate.without_spans())
    return with_length(cut.where((F.col("n_hit") == 0) | F.regexp_like("text", F.lit(WORDS))).select(*docs.columns))


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select(F.col("id").alias("doc_id"), "n_chars", "n_chunks", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), "ids")


#: Names and functions; each one's result is written as Parquet and read again for the next.
STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentence_pieces", tokens),
]

#: A fitted classifier and merged pieces are beyond SQL; a test compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
