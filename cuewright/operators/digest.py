"""Order-free fingerprints of whole tables.

The digest of a multiset is its size and, for each of eight parts of the row
hashes, their sum: one map-side combined aggregate, whatever the skew and
however many copies a row has. Equal tables give equal digests; tables that
differ agree only if all eight sums of their hashes (256 bits a row) do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 8


def table_digest(df: DataFrame, row: Column, keys: list[str] | None = None) -> DataFrame:
    """``digest`` and ``n_rows`` per key of the multiset of ``row`` strings; one row without keys, also for an empty table."""
    hashed = df.select(*(keys or []), F.sha2(row, 256).alias("_h"))
    part = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"_s{i}") for i in range(PARTS)]
    counted = hashed.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    text = F.concat_ws(",", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(PARTS)])
    return counted.select(*(keys or []), F.sha2(text, 256).alias("digest"), "n_rows")


LEVELS = (5, 2, 0)


def sorted_digest(df: DataFrame, row: Column, keys: list[str] | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``digest`` and ``n_rows`` per key: one hash over all row hashes in order, taken bucket by bucket.

    Row hashes with their counts are listed in order inside buckets of equal
    prefix, the hash of a bucket is listed in the bucket of a shorter prefix, and
    so on up to one. Buckets follow the hash, never the skew of the data; one
    exchange by the longest prefix serves the counting and the first lists.
    """
    keys = keys or []
    bucket = lambda c, n: F.substring(c, 1, n) if n else F.lit("")
    hashed = df.select(*keys, F.sha2(row, 256).alias("_r")).withColumn("_b", bucket("_r", levels[0])).repartition(*keys, "_b")
    level = hashed.groupBy(*keys, "_b", "_r").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_e", F.concat_ws(":", "_r", F.col("n_rows").cast("string")))
    for i, n in enumerate(levels):
        if i:
            level = level.select(*keys, bucket("_b", n).alias("_b"), F.concat_ws(":", "_b", "_h").alias("_e"), "n_rows")
        listed = F.array_join(F.array_sort(F.collect_list("_e")), ",")
        level = level.groupBy(*keys, "_b").agg(F.sha2(listed, 256).alias("_h"), F.sum("n_rows").alias("n_rows"))
    if keys:
        return level.select(*keys, F.col("_h").alias("digest"), "n_rows")
    # an empty table without keys still has a digest
    return level.agg(F.coalesce(F.max("_h"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))


def sorted_digest_sql(rows: str, key: str, row: str, levels: tuple[int, ...] = LEVELS) -> str:
    """SQL twin over a relation with a key and a hex hash a row."""
    b = lambda c, n: f"substr({c}, 1, {n})" if n else "''"
    out = f"SELECT {key}, {b(row, levels[0])} AS b, {row} || ':' || count(*) AS e, count(*) AS n_rows FROM {rows} GROUP BY {key}, {row}"
    for i, n in enumerate(levels):
        if i:
            out = f"SELECT {key}, {b('b', n)} AS b, b || ':' || h AS e, n_rows FROM ({out}) l{i}"
        out = f"SELECT {key}, b, sha256(string_agg(e, ',' ORDER BY e)) AS h, sum(n_rows) AS n_rows FROM ({out}) q{i} GROUP BY {key}, b"
    return f"SELECT {key}, h AS digest, CAST(n_rows AS BIGINT) AS n_rows FROM ({out}) q"


def digest_sql(rows: str, key: str, row: str) -> str:
    """SQL twin over a relation with a key and a hex hash a row: the fields ``digest, n_rows`` per key."""
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr({row}, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(PARTS))
    return f"SELECT {key}, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {sums})) AS digest, count(*) AS n_rows FROM {rows} GROUP BY {key}"
