"""Gate a take table, and check rows against declared constraints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, ratio, reasons
from ..functions.prosody import gate_reasons, quality
from ..functions.text import strip


def gate(takes: DataFrame) -> DataFrame:
    """Adds ``why`` (codes, in rule order) and ``ok``."""
    return takes.withColumn("why", gate_reasons()).withColumn("ok", F.size("why") == 0)


def score(takes: DataFrame, log2: Callable[[Column], Column] = F.log2) -> DataFrame:
    return takes.withColumn("quality", quality(log2=log2))


def gate_and_score(takes: DataFrame, log2: Callable[[Column], Column] = F.log2) -> DataFrame:
    return score(gate(takes), log2)


def first_error(*checks: tuple[Column, str]) -> Column:
    """Message of the first check that holds, else null."""
    (head, message), *rest = checks
    out = F.when(head, F.lit(message))
    for condition, text in rest:
        out = out.when(condition, F.lit(text))
    return out


def validate_requests(df: DataFrame) -> DataFrame:
    """Code of the first broken constraint of a request row (text, output_wav, mode, seed, request_id, block_id). An absent seed takes the default."""
    c = F.col
    text = strip(F.coalesce(c("text"), F.lit("")))
    seed = c("seed").try_cast("bigint")
    return df.withColumn(
        "error",
        first_error(
            (text == "", "text_missing"),
            (F.length(text) > 2000, "text_too_long"),
            (strip(F.coalesce(c("output_wav"), F.lit(""))) == "", "output_missing"),
            (~F.lower(strip(c("mode"))).isin("fast", "production"), "mode_unknown"),
            (c("seed").isNotNull() & seed.isNull(), "seed_no_integer"),
            ((seed < 0) | (seed >= 2**31), "seed_out_of_range"),
            (F.length(strip(c("request_id"))).between(1, 128) == F.lit(False), "request_id_length"),
            (~strip(c("block_id")).rlike("^[A-Za-z0-9_-]{1,64}$"), "block_id_characters"),
        ),
    )


def validate_paths(df: DataFrame, path: str = "path", digest: str | None = None) -> DataFrame:
    """Normalised repository-relative path, or null with the reason; optional 64-hex check."""
    slashed = F.regexp_replace(F.col(path), r"\\", "/")
    squeezed = F.regexp_replace(F.regexp_replace(slashed, "/(\\./)+", "/"), "/+", "/")
    normal = F.regexp_replace(F.regexp_replace(squeezed, "^(\\./)+", ""), "(/\\.)?/?$", "")
    checks = [
        (slashed.isNull() | (slashed == "") | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:"),
         "path must be non-empty and repository-relative"),
        (normal.isin("", ".", "..") | normal.startswith("../"), "path must stay within the repository"),
    ]
    if digest:
        checks.append((~F.coalesce(F.lower(digest).rlike("^[0-9a-f]{64}$"), F.lit(False)), "not a SHA-256 hex string"))
    out = df.withColumn("error", first_error(*checks))
    return out.withColumn("normal_path", F.when(F.col("error").isNull(), normal))


def validate_issues(df: DataFrame) -> DataFrame:
    """Pronunciation issues need the word, how it sounded, and how it should sound."""
    blank = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    missing = blank("problem_word") | blank("heard_as") | blank("desired_pronunciation")
    return df.withColumn(
        "error",
        F.when(
            (F.col("category") == "PRONUNCIATION") & missing,
            F.lit("pronunciation issues require problem_word, heard_as, and desired_pronunciation"),
        ),
    )


# What each switch may be set to.
FLAG_DOMAINS = {
    "quality_mode": ("off", "shadow", "select"),
    "conditionals_cache": ("off", "on"),
    "asr_validator": ("off", "on"),
    "speaker_validator": ("off", "on"),
    "mos_validator": ("off", "on"),
    "preference_ranker": ("off", "shadow", "select"),
    "hybrid_synthesis": ("off", "experiment"),
}


def validate_flags(df: DataFrame, name: str = "flag", value: str = "value") -> DataFrame:
    """One row per setting: effective value (default off) and whether its domain allows it."""
    effective = F.lower(F.trim(F.coalesce(F.col(value), F.lit("off"))))
    allowed = F.lit(False)
    for flag, domain in FLAG_DOMAINS.items():
        allowed = allowed | ((F.col(name) == flag) & effective.isin(*domain))
    return df.withColumn("effective", effective).withColumn("valid", allowed)


def bank_projection(takes: DataFrame) -> DataFrame:
    """Derived measures of a stored take."""
    return takes.withColumns(
        {
            "syllables_per_second": ratio(F.col("n_syl"), F.col("dur")),
            "relative_tail": ratio(F.col("tail_delta"), F.col("range_st")),
        }
    )


def timing_errors(df: DataFrame) -> DataFrame:
    """Real-time factor of one synthesis with the ordering rules of its clock readings."""
    c = F.col
    return df.withColumn("rtf", ratio(c("generation_seconds"), c("audio_seconds"))).withColumn(
        "errors",
        reasons(
            (c("finished") < c("started"), "finish_precedes_start"),
            (c("pcm_ready") < c("finished"), "pcm_precedes_finish"),
            (c("audio_seconds") <= 0, "audio_duration_not_positive"),
            (c("generation_seconds") < 0, "generation_negative"),
            (finite(c("rtf")) < 0, "rtf_negative"),
        ),
    )
