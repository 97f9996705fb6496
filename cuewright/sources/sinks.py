"""Writing results: finite JSON, never into the input, never over something that exists."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import INF


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != INF), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [_safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite numbers become null at any depth; columns in name order."""
    return df.select(*[_safe(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def _plain(path: str) -> str:
    scheme, mark, rest = path.partition("://")
    if mark and scheme != "file":
        return scheme + mark + posixpath.normpath(rest)
    return posixpath.normpath("/" + (rest if mark else path.removeprefix("file:")).lstrip("/"))


def is_within(path: str, root: str) -> bool:
    """Whether a path lies in a folder once dots are resolved; local paths may carry a file scheme."""
    inner, outer = _plain(path), _plain(root)
    return inner == outer or inner.startswith(outer.rstrip("/") + "/")


def write_report(df: DataFrame, path: str, forbid_inside: str) -> str:
    """JSON lines outside the read-only input folder; existing output is an error."""
    if is_within(path, forbid_inside):
        raise ValueError("report must be outside the read-only input folder")
    json_safe(df).write.mode("errorifexists").json(path)
    return path


def write_exclusive(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


CSV_METRICS = (
    "candidate_count", "successful_candidate_count", "failed_candidate_count", "failure_rate", "mean_content_accuracy",
    "mean_speaker_similarity", "mean_existing_prosody_score", "mean_phrase_transition_score", "mean_duration_seconds",
    "mean_generation_seconds", "mean_assembly_seconds", "total_processing_seconds", "real_time_factor",
)


def long_metrics(analysis: DataFrame) -> DataFrame:
    """mode, metric, value."""
    typed = analysis.select("mode", *[F.col(m).cast("double").alias(m) for m in CSV_METRICS])
    return typed.unpivot(["mode"], list(CSV_METRICS), "metric", "value")


def markdown_rows(analysis: DataFrame) -> DataFrame:
    """One table line per mode; what was not measured says so."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not_run"))
    cells = ("failure_rate", "mean_content_accuracy", "mean_speaker_similarity", "mean_phrase_transition_score")
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", "mode", F.col("candidate_count").cast("string"), F.col("failed_candidate_count").cast("string"), *[show(c) for c in cells]), F.lit(" |")
    )
    return analysis.select("mode", line.alias("line"))


def write_bundle(analysis: DataFrame, blinded: DataFrame, path: str) -> str:
    """Analysis, long metrics, evidence lines, and the blind package apart from its key."""
    from ..operators import experiment

    parts = {
        "analysis": (json_safe(analysis), "json"),
        "metrics": (long_metrics(analysis), "csv"),
        "evidence": (markdown_rows(analysis).select(F.col("line").alias("value")), "text"),
        "blind_manifest": (experiment.public(blinded), "parquet"),
        "blind_answer_key": (experiment.answer_key(blinded), "parquet"),
    }
    for name, (df, fmt) in parts.items():
        write_exclusive(df, f"{path.rstrip('/')}/{name}", fmt)
    return path
