"""Files of a take tree as tables.

Reading and parsing are apart: a reader yields (path, content), a parser turns
any such table into typed rows and error rows. Schemas are explicit; a file that
does not parse becomes an error row and never stops the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAKE_NAME = r"P(\d+)_t(\d+)\.json$"
METRICS = (
    "dur DOUBLE, median_hz DOUBLE, range_st DOUBLE, end_slope DOUBLE, first_hz DOUBLE, last_hz DOUBLE, "
    "tail_delta DOUBLE, final_glide DOUBLE, final_rebound DOUBLE, hard_gate_pass BOOLEAN, hard_gate_status STRING"
)
TAKE_SCHEMA = (
    "take INT, seed BIGINT, ok BOOLEAN, why ARRAY<STRING>, n_syl DOUBLE, `numeric` BOOLEAN, text STRING, temp DOUBLE, "
    f"gen_s DOUBLE, metrics STRUCT<{METRICS}>, _corrupt_record STRING"
)
JOB_SCHEMA = "blocks ARRAY<STRUCT<id STRING, text STRING, seed BIGINT>>"
PHRASE_SCHEMA = "text STRING, sentence_final BOOLEAN, forced BOOLEAN"
REPORT_SCHEMA = "id STRING, picks ARRAY<INT>"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def read_files(spark: SparkSession, root: str, glob: str, recursive: bool = True) -> DataFrame:
    """path, content (text), raw (bytes), modified, for every file that matches."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(root)
    )
    return files.select(
        "path", F.decode("content", "UTF-8").alias("content"), F.col("content").alias("raw"),
        F.col("modificationTime").alias("modified"),
    )


def _part(path: Column, back: int) -> Column:
    """Path component counted from the end; 1 is the file name."""
    return F.get(F.reverse(F.split(path, "/")), back - 1)


SCALAR = r'^\s*(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|"([^"\\]|\\.)*")\s*$'


def _other_json(content: Column) -> Column:
    """Well-formed JSON that is not an object."""
    return content.rlike(SCALAR) | content.rlike(r"^\s*\[") & F.from_json(content, "array<string>").isNotNull()


def parse_jobs(raw: DataFrame) -> DataFrame:
    """One row per block of each job document."""
    doc = F.from_json("content", JOB_SCHEMA)
    return raw.select("path", F.posexplode(doc["blocks"]).alias("block_pos", "_b")).select(
        "path", "block_pos", F.col("_b.id").alias("block_id"), F.col("_b.text").alias("text"), F.col("_b.seed").alias("seed")
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(JOB_SCHEMA).option("multiLine", "true").json(path).select(F.explode("blocks").alias("_b"))
    return rows.select(F.col("_b.id").alias("block_id"), F.col("_b.text").alias("text"), F.col("_b.seed").alias("seed"))


def parse_takes(
    raw: DataFrame, blocks: list[str] | None = None, ignore_case: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(takes, errors). Block is the parent folder; phrase and take come from the file name."""
    name = _part(F.col("path"), 1)
    pattern = ("(?i)^" if ignore_case else "^") + TAKE_NAME
    keyed = raw.where(name.rlike(pattern)).withColumns(
        {
            "block_id": _part(F.col("path"), 2),
            "phrase_idx": F.regexp_extract(name, pattern, 1).try_cast("int"),
            "take_id": F.regexp_extract(name, pattern, 2).try_cast("int"),
        }
    )
    if blocks is not None:
        keyed = keyed.where(F.col("block_id").isin(*blocks))
    # as a generated column a document is parsed once; the filter on its errors would else go below, with all that made the content
    parsed = keyed.select("*", F.explode(F.array(F.from_json("content", TAKE_SCHEMA, PERMISSIVE))).alias("doc")).withColumn(
        "error",
        F.when(F.col("phrase_idx").isNull() | F.col("take_id").isNull(), F.lit("take_name_error:OverflowError"))
        .when(_other_json(F.col("content")), F.lit("take_json_error:ValueError")).when(
            F.col("doc._corrupt_record").isNotNull() | F.col("doc").isNull(), F.lit("take_json_error:JSONDecodeError")
        ),
    )
    good = parsed.where("error IS NULL").select(
        "path", "block_id", "phrase_idx", "take_id", F.sha2("content", 256).alias("sha256"),
        *[F.col(f"doc.{c}").alias(c) for c in ("seed", "ok", "why", "n_syl", "text", "temp", "gen_s")],
        F.col("doc.numeric").alias("numeric_heavy"), "doc.metrics.*",
    )
    return good, parsed.where("error IS NOT NULL").select("path", "error")


def read_takes(
    spark: SparkSession, root: str, blocks: list[str] | None = None, recursive: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Takes below a folder at any depth (names in any case), or exactly one level down."""
    if recursive:
        return parse_takes(read_files(spark, root, "*.json"), blocks, ignore_case=True)
    return parse_takes(read_files(spark, f"{root.rstrip('/')}/*", "P*_t*.json", recursive=False), blocks)


def parse_phrases(raw: DataFrame) -> DataFrame:
    """Phrase rows by their array position; entries that are not objects are skipped, not renumbered."""
    entries = F.from_json("content", "array<string>")
    rows = raw.select(_part(F.col("path"), 2).alias("block_id"), F.posexplode(entries).alias("phrase_idx", "_e"))
    return rows.where(F.col("_e").rlike(r"^\s*\{")).withColumn("_p", F.from_json("_e", PHRASE_SCHEMA)).select(
        "block_id", "phrase_idx", F.col("_p.text").alias("text"),
        F.coalesce("_p.sentence_final", F.lit(False)).alias("sentence_final"), F.coalesce("_p.forced", F.lit(False)).alias("forced"),
    )


def parse_pins(raw: DataFrame) -> DataFrame:
    """(block, phrase_idx, take) from ``<block>_pins.json``; keys other than P<digits>, and numbers beyond an int, are ignored."""
    pins = F.from_json("content", "map<string,int>")
    block = F.regexp_replace(_part(F.col("path"), 1), r"_pins\.json$", "")
    rows = raw.select(block.alias("block_id"), F.explode(pins).alias("key", "take_id"))
    index = F.regexp_extract("key", r"^P(\d+)$", 1).try_cast("int")
    return rows.select("block_id", index.alias("phrase_idx"), "take_id").where("phrase_idx IS NOT NULL AND take_id IS NOT NULL")


def parse_reports(raw: DataFrame) -> DataFrame:
    """(block, phrase_idx, take) from the pick list of ``*_report.json``; the position is the phrase."""
    doc = F.from_json("content", REPORT_SCHEMA)
    return raw.select(doc["id"].alias("block_id"), F.posexplode(doc["picks"]).alias("phrase_idx", "take_id"))


def pending(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Blocks without a report."""
    return jobs.join(reports.select("block_id").distinct(), "block_id", "left_anti")
