"""What files there are, whether they changed, and whether a record still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.digest import table_digest


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("sha256"))


def fingerprint(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Digest and file count of a manifest. Two trees have one digest if and only if they agree."""
    return table_digest(entries, F.concat_ws(":", "path", "sha256"), keys)


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per path: added, removed, changed or same."""
    b = before.select("path", F.col("sha256").alias("before"))
    a = after.select("path", F.col("sha256").alias("after"))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
        .otherwise("same")
    )
    return b.join(a, "path", "full").select("path", change.alias("change"))


def read_only_verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: nothing was added, removed or changed."""
    counted = diff(before, after).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "same")]
    )
    return counted.withColumn("read_only_verified", F.col("added") + F.col("removed") + F.col("changed") == 0)


def cache_key(*columns: str):
    """Key of the named inputs: sha256 of their JSON, in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def verify(expected: DataFrame, recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """First reason why a stored artifact cannot be reused, or a hit.

    ``expected``: name, source_sha256. ``recorded``: name, source_sha256,
    artifact_sha256, valid. ``actual``: name, artifact_sha256.
    """
    e = expected.select("name", F.col("source_sha256").alias("_want"))
    r = recorded.select(
        "name", F.col("source_sha256").alias("_seen"), F.col("artifact_sha256").alias("_kept"), "valid", F.lit(True).alias("_known")
    )
    a = actual.select("name", F.col("artifact_sha256").alias("_have"))
    reason = (
        F.when(F.col("_known").isNull(), "manifest_missing")
        .when(~F.coalesce("valid", F.lit(False)), "manifest_invalid")
        .when(~F.col("_want").eqNullSafe(F.col("_seen")), "source_mismatch")
        .when(F.col("_have").isNull(), "artifact_missing")
        .when(F.col("_have") != F.col("_kept"), "artifact_hash_mismatch")
    )
    out = e.join(r, "name", "left").join(a, "name", "left")
    return out.select("name", reason.alias("reason"), reason.isNull().alias("hit"))
