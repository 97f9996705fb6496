"""Gate and score expressions over one take row.

A take row carries ``n_syl, dur, median_hz, range_st, end_slope, tail_delta,
final_glide, final_rebound`` plus the class flags ``numeric_heavy, question,
forced, sentence_final``. All of it is one projection: no shuffle, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .numeric import outside, reasons, semitones


def slope_profile(question: Column, forced: Column) -> Column:
    """Gate band, prior and bonus band by class: question, then forced, then statement."""

    def pack(profile):
        band, prior, bonus = profile
        return F.struct(
            F.lit(band[0]).alias("low"),
            F.lit(band[1]).alias("high"),
            F.lit(prior).alias("prior"),
            F.lit(bonus[0]).alias("bonus_low"),
            F.lit(bonus[1]).alias("bonus_high"),
        )

    return (
        F.when(question, pack(R.QUESTION_SLOPE))
        .when(forced, pack(R.FORCED_SLOPE))
        .otherwise(pack(R.STATEMENT_SLOPE))
    )


def speaking_rate(n_syl: Column, dur: Column) -> Column:
    return F.when(dur > 0, n_syl / dur).otherwise(F.lit(0.0))


def level(median_hz: Column) -> Column:
    return semitones(median_hz, R.LEVEL_ANCHOR_HZ)


def gate_reasons(
    n_syl="n_syl",
    dur="dur",
    median_hz="median_hz",
    range_st="range_st",
    end_slope="end_slope",
    tail_delta="tail_delta",
    final_glide="final_glide",
    final_rebound="final_rebound",
    numeric="numeric_heavy",
    question="question",
    forced="forced",
    final="sentence_final",
) -> Column:
    """Codes of every rule the take breaks, in rule order. Null metrics: unmeasurable."""
    c = F.col
    q, fin = c(question), c(final)
    rate = speaking_rate(c(n_syl), c(dur))
    rate_miss = (
        F.when(q, outside(rate, R.RATE_BAND_QUESTION))
        .when(c(numeric), outside(rate, R.RATE_BAND_NUMERIC))
        .otherwise(outside(rate, R.RATE_BAND))
    )
    relative = F.when(c(range_st) > 0, c(tail_delta) / c(range_st)).otherwise(F.lit(0.0))
    profile = slope_profile(q, c(forced))
    ceiling = F.when(
        fin & ~q, F.least(profile["high"], F.lit(R.FINAL_SLOPE_CEILING))
    ).otherwise(profile["high"])
    has_tail = c(tail_delta).isNotNull()
    by_tail = q & fin & has_tail
    statement_tail = fin & ~q & has_tail
    listed = reasons(
        (rate_miss, "rate"),
        (by_tail & outside(c(tail_delta), R.QUESTION_TAIL_BAND), "q_tail"),
        (by_tail & outside(relative, R.QUESTION_RELATIVE_BAND), "q_rel"),
        (~by_tail & ((c(end_slope) < profile["low"]) | (c(end_slope) > ceiling)), "end_slope"),
        (statement_tail & (c(tail_delta) > R.TAIL_DELTA_MAX), "tail"),
        (statement_tail & (relative > R.TAIL_RELATIVE_MAX), "rel_fall"),
        (fin & (c(final_glide) < R.FINAL_GLIDE_MIN), "glide"),
        (fin & (c(final_rebound) < R.FINAL_REBOUND_MIN), "rebound"),
        (outside(c(range_st), R.RANGE_BAND), "range"),
        (F.abs(level(c(median_hz))) > R.LEVEL_BAND_ST, "level"),
    )
    unmeasured = c(dur).isNull() | c(median_hz).isNull() | c(range_st).isNull() | c(end_slope).isNull()
    return F.when(unmeasured, F.array(F.lit("unmeasurable"))).otherwise(listed)


def _score(n_syl, dur, median_hz, end_slope, final_glide, final_rebound, question, forced, final, p, log2=F.log2) -> Column:
    profile = slope_profile(question, forced)
    base = (
        -F.abs(n_syl / dur - p["rate_target"]) * p["rate_weight"]
        - F.least(F.abs(end_slope - profile["prior"]), F.lit(R.SLOPE_DISTANCE_CAP)) * p["slope_weight"]
        + F.when(end_slope.between(profile["bonus_low"], profile["bonus_high"]), R.SLOPE_BONUS).otherwise(0.0)
        - F.abs(semitones(median_hz, p["level_anchor_hz"], log2)) * p["level_weight"]
    )
    rebound_loss = F.coalesce(F.greatest(p["rebound_min"] - final_rebound, F.lit(0.0)), F.lit(0.0))
    glide_loss = F.coalesce(F.greatest(p["glide_min"] - final_glide, F.lit(0.0)), F.lit(0.0))
    release = rebound_loss * R.REBOUND_WEIGHT + glide_loss * R.GLIDE_WEIGHT
    return base - F.when(final, release).otherwise(F.lit(0.0))


SCORE_PARAMETERS = {
    "rate_target": R.RATE_TARGET,
    "rate_weight": R.RATE_WEIGHT,
    "slope_weight": R.SLOPE_WEIGHT,
    "level_anchor_hz": R.LEVEL_ANCHOR_HZ,
    "level_weight": R.LEVEL_WEIGHT,
    "rebound_min": R.FINAL_REBOUND_MIN,
    "glide_min": R.FINAL_GLIDE_MIN,
}


def _literals(parameters):
    return {k: F.lit(float(v)) for k, v in parameters.items()}


def quality(
    n_syl="n_syl",
    dur="dur",
    median_hz="median_hz",
    end_slope="end_slope",
    final_glide="final_glide",
    final_rebound="final_rebound",
    question="question",
    forced="forced",
    final="sentence_final",
    log2=F.log2,
) -> Column:
    """Distance from the rate, slope and level targets, plus the release at a sentence end."""
    c = F.col
    score = _score(
        c(n_syl), F.nullif(c(dur), F.lit(0.0)), c(median_hz), c(end_slope), c(final_glide), c(final_rebound),
        c(question), c(forced), c(final), _literals(SCORE_PARAMETERS), log2,
    )
    return score


def shadow_quality(
    n_syl="n_syl",
    dur="dur",
    median_hz="median_hz",
    end_slope="end_slope",
    final_glide="final_glide",
    final_rebound="final_rebound",
    question="question",
    forced="forced",
    final="sentence_final",
    parameters: dict | None = None,
) -> Column:
    """The same score with explicit parameters; null where an ingredient is missing or 0."""
    c = F.col
    p = _literals({**SCORE_PARAMETERS, **(parameters or {})})
    usable = (
        c(dur).isNotNull() & (c(dur) != 0) & c(n_syl).isNotNull() & c(end_slope).isNotNull()
        & c(median_hz).isNotNull() & (c(median_hz) != 0)
    )
    score = _score(
        c(n_syl), F.when(usable, c(dur)), F.when(usable, c(median_hz)), c(end_slope), c(final_glide),
        c(final_rebound), c(question), c(forced), c(final), p,
    )
    return F.when(usable, score)


def reset_st(first_hz: Column, previous_last_hz: Column) -> Column:
    """Pitch jump from the end of the previous phrase to the start of this one."""
    return F.when(previous_last_hz > 0, semitones(first_hz, previous_last_hz))
