"""Removal of lines that spread over many sites.

A HyperLogLog sketch of the sites is kept per line hash; sketches merge by
aggregation, before and after the shuffle. Lines whose estimate lies near the
threshold get an exact count of distinct sites. A line found on ``min_sites``
sites or more is boilerplate: its first occurrence (smallest document, then
line number) stays, every other one goes.

A row is known by its document id and 64 bits of its text, so rows that repeat an
id with another text, or have none, lose their own lines only; among them ties
are broken by the hash. Rows that are alike in both are judged alike.

A line is what stands between two newlines, without blanks (space, tab to carriage
return) at its ends; lines of fewer than ``min_words`` words never count. Null text has no lines, a null
site counts as one site of its own. An empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters.
MIN_SITES = 5
MIN_WORDS = 4
LG_K = 12
BLANKS = " \t\n\x0b\x0c\r"
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: Three relative standard errors of a sketch, and one site at least.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)


def split_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def counted_lines(df: DataFrame, id_col: str, text: str, site: str, min_words: int) -> DataFrame:
    """One row (h, h2, site, doc, own, line) for each line that can count; 96 hash bits tell lines apart."""
    lines = df.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("own"), F.coalesce(F.col(site), F.lit("")).alias("site"), F.posexplode(split_lines(text)).alias("line", "value")
    ).withColumn("value", F.trim("value", F.lit(BLANKS)))
    enough = F.regexp_like("value", F.lit(f"^(?:{WORD}{BLANK}){{{min_words - 1}}}{WORD}"))
    return lines.where(enough).select(F.xxhash64("value").alias("h"), F.hash("value").alias("h2"), "site", "doc", "own", "line")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, h2, doc, line, own): every boilerplate line and the place where it stays."""
    # one row per line and site, combined before the shuffle: a hot line is a row per task and site
    sites = lines.groupBy("h", "h2", "site").agg(F.min(F.struct("doc", "line", "own")).alias("first"))
    spread = (
        sites.groupBy("h", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("first").alias("first"))
        .select("h", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(1.0, BAND * min_sites)
    spread = spread.where(F.col("sites") >= min_sites - margin)
    near = spread.where(F.col("sites") <= min_sites + margin).select("h", "h2")
    exact = (
        sites.join(near, ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.count(F.lit(1)).alias("exact"))
    )
    known = F.coalesce(F.col("exact").cast("double"), F.col("sites"))
    return spread.join(exact, ["h", "h2"], "left").where(known >= min_sites).select("h", "h2", "first.doc", "first.line", "first.own")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source",
                  min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, own, removed): numbers of the lines to remove, per document that has any."""
    lines = counted_lines(df, id_col, text, site, min_words)
    spread = boilerplate(lines, min_sites).withColumnsRenamed({"doc": "first_doc", "line": "first_line", "own": "first_own"})
    gone = lines.join(spread, ["h", "h2"]).where(
        ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line")) & (F.col("own") == F.col("first_own")))
    )
    return gone.groupBy("doc", "own").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows; ``text`` without its removed lines, ``n_lines`` and ``n_removed``."""
    gone = removed_lines(df, id_col, text, site, min_sites, min_words)
    rows = df.drop("n_lines", "n_removed").join(
        gone.withColumnsRenamed({"doc": "_doc", "own": "_own", "removed": "_removed"}),
        F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_own")), "left",
    )
    # the line array is a column of its own, so that it is split once per row
    rows = rows.withColumn("_lines", split_lines(text))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")
    return (
        rows.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"))
        .withColumn("n_removed", F.when(F.col("_removed").isNull(), F.lit(0)).otherwise(F.size("_removed")).cast("long"))
        .withColumn(
            text,
            F.when(F.col("_removed").isNull(), F.col(text)).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
            ),
        )
        .drop("_doc", "_own", "_removed", "_lines")
    )
