"""Read-only evaluation next to the production choice: validations in long form,
three-valued statuses, ranks, and how far the recommendation agrees."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, ratio, semitones
from ..rules import LEVEL_ANCHOR_HZ
from .ordered import Hot, number_rows

TAKE = ["project_id", "block_id", "phrase_id", "take_id"]
PHRASE = TAKE[:3]

# The validators of a shadow run and what their absence is called.
VALIDATORS = (
    ("audio_sanity", True, "audio_not_configured"),
    ("content_asr", True, "asr_not_configured"),
    ("speaker_identity", True, "speaker_not_configured"),
    ("existing_prosody_gate", True, "gate_not_configured"),
    ("mos", False, "mos_not_configured"),
)


def result(name: str, status: Column, hard_gate: bool, score: Column, reasons: Column, metrics: Column) -> Column:
    """One validation of a take, in the take's own row."""
    values = {
        "validator_name": F.lit(name), "status": status, "hard_gate": F.lit(hard_gate), "score": score.cast("double"),
        "reasons": reasons, "metrics": metrics.cast("map<string,double>"),
    }
    return F.struct(*[c.alias(n) for n, c in values.items()])


def gate_result() -> Column:
    """The stored verdict of a take as a validation; metrics keep only finite numbers."""
    why = F.when(F.size("why") > 0, F.col("why")).otherwise(F.array(F.lit("existing_gate_rejected")))
    return result(
        "existing_prosody_gate",
        F.when(F.col("ok"), "pass").when(F.col("ok") == F.lit(False), "fail").otherwise("unknown"),
        True,
        F.lit(None),
        F.when(F.col("ok"), F.array().cast("array<string>"))
        .when(F.col("ok") == F.lit(False), why)
        .otherwise(F.array(F.lit("existing_gate_status_missing"))),
        F.map_filter("metrics", lambda k, v: finite(v).isNotNull()),
    )


def imported_gate(takes: DataFrame) -> DataFrame:
    """The stored verdict of each take as a validation row."""
    return takes.select(*TAKE, F.inline(F.array(gate_result())))


def complete_validations(takes: DataFrame, results: DataFrame, validators: tuple = VALIDATORS) -> DataFrame:
    """Every take x every validator; what did not run says so instead of vanishing.

    The validators are a handful of configured names, so each take row fans out
    in place; results join once on the full key.
    """
    names = F.array(
        *[
            F.struct(
                F.lit(name).alias("validator_name"),
                F.lit(hard).alias("default_hard_gate"),
                F.lit(absent).alias("absent_reason"),
            )
            for name, hard, absent in validators
        ]
    )
    # a take's own results, so the list is no longer than the validators that ran on it
    columns = ("validator_name", "status", "hard_gate", "score", "reasons", "metrics")
    folded = results.groupBy(*TAKE).agg(F.collect_list(F.struct(*columns)).alias("_results"))
    kinds = results.select(*columns).schema

    def completed(v: Column) -> Column:
        """The rows of one validator: its results, or one that says why there is none."""
        absent = F.struct(*[F.lit(None).cast(kinds[c].dataType).alias(c) for c in columns])
        found = F.filter("_results", lambda r: r["validator_name"] == v["validator_name"])
        own = F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(F.array(absent))
        return F.transform(
            own,
            lambda r: F.struct(
                v["validator_name"].alias("validator_name"),
                F.coalesce(r["status"], F.lit("not_run")).alias("status"),
                F.coalesce(r["hard_gate"], v["default_hard_gate"]).alias("hard_gate"),
                r["score"].alias("score"),
                F.when(r["status"].isNull(), F.array(v["absent_reason"])).otherwise(r["reasons"]).alias("reasons"),
                r["metrics"].alias("metrics"),
            ),
        )

    # rows fan out behind the join, so one row per take is shuffled
    joined = takes.select(*TAKE).join(folded, TAKE, "left")
    return joined.select(*TAKE, F.inline(F.flatten(F.transform(names, completed))))


def guarded_validator(name: str, hard_gate: bool, check: Callable[[dict], tuple[str, float | None, list[str]]]):
    """A per-row Python check as a DataFrame step; an exception becomes an 'unknown' row.

    ``check(row) -> (status, score, reasons)``. Rows arrive in Arrow batches.
    """
    schema = (
        "project_id string, block_id string, phrase_id bigint, take_id int, validator_name string, "
        "status string, hard_gate boolean, score double, reasons array<string>, metrics map<string,double>"
    )

    def apply(takes: DataFrame) -> DataFrame:
        def run(batches: Iterable[pd.DataFrame]):
            for batch in batches:
                rows, names = [], list(batch.columns)
                for values in zip(*[batch[c].tolist() for c in names]):
                    row = dict(zip(names, values))
                    try:
                        status, score, why = check(row)
                    except Exception as exc:
                        status, score, why = "unknown", None, [f"validator_exception:{type(exc).__name__}"]
                    rows.append((*[row[k] for k in TAKE], name, status, hard_gate, score, why, None))
                yield pd.DataFrame(
                    rows,
                    columns=[*TAKE, "validator_name", "status", "hard_gate", "score", "reasons", "metrics"],
                )

        return takes.mapInPandas(run, schema)

    return apply


def survives(validations: DataFrame) -> DataFrame:
    """False only where a hard gate failed; unknown and not_run stay visible, never a pass."""
    return validations.groupBy(*TAKE).agg(
        (~F.bool_or(F.col("hard_gate") & (F.col("status") == "fail"))).alias("survives"),
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "not_run").alias("n_not_run"),
        F.count_if(F.col("status") == "unknown").alias("n_unknown"),
    )


def survival(takes: DataFrame, results: DataFrame, validators: tuple = VALIDATORS, with_passed: bool = False) -> DataFrame:
    """What ``survives`` says of the completed validations, without writing a row for what did not run.

    Results fold to one row per take before they are shuffled; validators that a
    take has no result of are counted by subtraction. ``with_passed`` adds the
    names of the validators that passed, in their order.
    """
    names = [name for name, _, _ in validators]
    default = F.create_map(*[F.lit(x) for name, hard, _ in validators for x in (name, hard)])
    status = F.coalesce("status", F.lit("not_run"))
    hard = F.coalesce(F.col("hard_gate"), default[F.col("validator_name")])
    folded = results.where(F.col("validator_name").isin(names)).groupBy(*TAKE).agg(
        F.bool_or(hard & (status == "fail")).alias("_failed"),
        F.count_if(status == "pass").alias("_pass"),
        F.count_if(status == "not_run").alias("_not_run"),
        F.count_if(status == "unknown").alias("_unknown"),
        *[F.max((F.col("validator_name") == n).cast("int")).alias(f"_has_{i}") for i, n in enumerate(names)],
        *[F.bool_or((F.col("validator_name") == n) & (status == "pass")).alias(f"_ok_{i}") for i, n in enumerate(names) if with_passed],
    )
    passed = [F.array_compact(F.array(*[F.when(F.col(f"_ok_{i}"), F.lit(n)) for i, n in enumerate(names)])).alias("passed")] if with_passed else []
    found = sum((F.coalesce(F.col(f"_has_{i}"), F.lit(0)) for i in range(len(names))), F.lit(0))
    return takes.select(*TAKE).join(folded, TAKE, "left").select(
        *TAKE,
        (~F.coalesce("_failed", F.lit(False))).alias("survives"),
        F.coalesce("_pass", F.lit(0)).alias("n_pass"),
        (F.coalesce("_not_run", F.lit(0)) + F.lit(len(names)) - found).alias("n_not_run"),
        F.coalesce("_unknown", F.lit(0)).alias("n_unknown"),
        *passed,
    )


def survival_in_row(results: dict[str, Column], validators: tuple = VALIDATORS) -> tuple[Column, Column]:
    """``survives`` and ``passed`` of ``survival`` where a take's results, one a validator or null, are in its own row: no shuffle."""
    failed, passing = F.lit(False), []
    for name, hard, _ in validators:
        if name in results:
            r = results[name]
            failed = failed | F.coalesce(F.coalesce(r["hard_gate"], F.lit(hard)) & (r["status"] == "fail"), F.lit(False))
            passing.append(F.when(r["status"] == "pass", F.lit(name)))
    return ~failed, F.array_except(F.array(*passing).cast("array<string>"), F.array(F.lit(None).cast("string")))


def ranking_features(takes: DataFrame) -> DataFrame:
    """Feature columns from take metrics and, where present, the validators' columns.

    ``level_deviation_db`` keeps its published name; its unit is semitones.
    ``phrase_reset_st`` is never known here.
    """
    have = set(takes.columns)

    def maybe(*names: str) -> Column:
        """The first finite value of the columns that there are."""
        found = [finite(F.col(n)) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    error_rate = maybe("normalized_edit_distance")
    median = finite(F.col("median_hz"))
    return takes.withColumns(
        {
            "f_syllables_per_second": ratio(finite(F.col("n_syl")), finite(F.col("dur"))),
            "f_pitch_median_hz": median,
            "f_pitch_range_st": finite(F.col("range_st")),
            "f_tail_delta_st": finite(F.col("tail_delta")),
            "f_relative_tail": ratio(finite(F.col("tail_delta")), finite(F.col("range_st"))),
            "f_final_glide_st_per_s": finite(F.col("final_glide")),
            "f_final_rebound_st": finite(F.col("final_rebound")),
            "f_level_deviation_db": F.when(median > 0, semitones(median, LEVEL_ANCHOR_HZ)),
            "f_phrase_reset_st": F.lit(None).cast("double"),
            "f_speaker_similarity_chatterbox": maybe("primary_chatterbox_similarity", "primary_similarity"),
            "f_speaker_similarity_speechbrain": maybe("secondary_speechbrain_similarity", "secondary_similarity"),
            "f_content_score": F.when(error_rate.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - error_rate)),
            "f_content_error_rate": error_rate,
            "f_mos_score": maybe("mos"),
        }
    )


def shadow_rank(evaluated: DataFrame, score: str = "rank_score", hot: Hot = None) -> DataFrame:
    """Rank of every surviving take in its phrase, best first, null scores last."""
    known = F.round(F.col(score), 9)
    order = [F.coalesce(-known, F.lit(float("inf"))), F.col("take_id")]
    chunk = [F.coalesce(F.floor(-known * 64), F.lit(1 << 50))]
    return number_rows(evaluated.where("survives"), PHRASE, order, chunk, "shadow_rank", hot)


def top_three(ranked: DataFrame) -> DataFrame:
    """At most three take ids per phrase, in rank order."""
    top = ranked.where("shadow_rank <= 3").groupBy(*PHRASE).agg(
        F.array_sort(F.collect_list(F.struct("shadow_rank", "take_id"))).alias("_t")
    )
    return top.select(
        *PHRASE, F.col("_t.take_id").alias("shadow_top_3"), F.col("_t.take_id")[0].alias("shadow_top_1")
    )


def selection_overlay(reports: DataFrame, pins: DataFrame) -> DataFrame:
    """Selected take per phrase: a pin overrides the block report; the source is kept."""
    r = reports.select(*PHRASE, F.col("take_id").alias("_report"))
    p = pins.select(*PHRASE, F.col("take_id").alias("_pin"))
    return r.join(p, PHRASE, "full").select(
        *PHRASE,
        F.coalesce("_pin", "_report").alias("take_id"),
        F.when(F.col("_pin").isNotNull(), "pins").otherwise("block_report").alias("source"),
    )


def recommended(value: Column | str, score: str = "rank_score") -> Column:
    """Aggregate: ``value`` of the best surviving take, null scores last."""
    place = F.struct(F.coalesce(-F.round(F.col(score), 9), F.lit(float("inf"))), F.col("take_id"))
    return F.min_by(value, F.when(F.col("survives"), place))


def agreement(evaluated: DataFrame, selections: DataFrame, score: str = "rank_score") -> DataFrame:
    """Per phrase: selected take, whether it exists, the recommendation, and if they agree.

    The recommendation is the best surviving take, null scores last. ``agreement``
    is null without a selection; a selected take that is gone counts as
    disagreement. Takes meet the selections once and fold to their phrase in the
    same partitions.
    """
    at = selections.select(*PHRASE, F.col("take_id").alias("selected_take"), "source")
    takes = evaluated.select(*TAKE, "survives", score).join(at, PHRASE, "left")
    folded = takes.groupBy(*PHRASE).agg(
        F.max("selected_take").alias("selected_take"), F.max("source").alias("source"),
        F.bool_or(F.coalesce(F.col("take_id") == F.col("selected_take"), F.lit(False))).alias("selected_present"),
        recommended("take_id", score).alias("shadow_top_1"),
    )
    same = F.coalesce(F.col("selected_present") & (F.col("selected_take") == F.col("shadow_top_1")), F.lit(False))
    return folded.withColumn("agreement", F.when(F.col("selected_take").isNotNull(), same))


def disagreements(compared: DataFrame, features: list[str]) -> DataFrame:
    """One row per difference between the selected take (``a``) and the recommended one (``s``) of a phrase.

    Both hold ``take_id``, ``survives``, ``rank_score`` and the features; a
    phrase without one of them, or where they are the same, has no difference.
    """
    both = compared.where("a.take_id <> s.take_id")

    def entry(kind: str, feature: str, a: Column, s: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(feature).alias("feature"), a.cast("double").alias("actual"),
            s.cast("double").alias("shadow"), (s.cast("double") - a.cast("double")).alias("shadow_minus_actual"),
        )

    gate = F.when(
        ~F.col("a.survives").eqNullSafe(F.col("s.survives")),
        entry("hard_gate_survival", "", F.col("a.survives").cast("int"), F.col("s.survives").cast("int")),
    )
    deltas = [
        F.when(F.col(f"a.{f}") != F.col(f"s.{f}"), entry("feature_delta", f, F.col(f"a.{f}"), F.col(f"s.{f}")))
        for f in sorted(features)
    ]
    score = F.when(
        ~F.col("a.rank_score").eqNullSafe(F.col("s.rank_score")),
        entry("rank_score", "", F.col("a.rank_score"), F.col("s.rank_score")),
    )
    return both.select(*PHRASE, F.inline(F.array_compact(F.array(gate, *deltas, score))))


def disagreement_maps(actual: Column, shadow: Column) -> Column:
    """The same comparison over two feature maps of free keys: array of (feature, actual, shadow, delta)."""
    merged = F.map_zip_with(
        actual, shadow,
        lambda k, a, s: F.struct(finite(a).alias("actual"), finite(s).alias("shadow")),
    )
    entries = F.transform(
        F.array_sort(F.map_entries(merged)),
        lambda e: F.struct(
            e["key"].alias("feature"), e["value"]["actual"].alias("actual"), e["value"]["shadow"].alias("shadow"),
            (e["value"]["shadow"] - e["value"]["actual"]).alias("shadow_minus_actual"),
        ),
    )
    return F.filter(entries, lambda e: e["actual"] != e["shadow"])


def feature_names(actual: Column, shadow: Column) -> Column:
    """Sorted union of the keys of two maps."""
    return F.array_sort(F.array_union(F.map_keys(actual), F.map_keys(shadow)))


# What a selection approval must cover.
MINIMUM_VALIDATORS = ("audio_sanity", "existing_prosody_gate")


def approval_reasons(
    approval: DataFrame, artifacts: DataFrame, required: tuple[str, ...] = MINIMUM_VALIDATORS
) -> DataFrame:
    """Every mismatch between an approval and the artifacts it names, one array per approval.

    ``approval``: approval_id, approved_by, approved, ranker_sha256,
    calibration_sha256, config_sha256, validators, minimum_top_confidence,
    minimum_feature_coverage. ``artifacts``: approval_id and the actual hashes.
    """
    have = artifacts.select(
        "approval_id",
        F.col("ranker_sha256").alias("_ranker"),
        F.col("calibration_sha256").alias("_calibration"),
        F.col("config_sha256").alias("_config"),
    )

    def unit(name: str) -> Column:
        return ~F.coalesce(finite(F.col(name)).between(0.0, 1.0), F.lit(False))

    need = F.array(*[F.lit(r) for r in required])
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    listed = [
        (~F.coalesce((F.col("approved_by") == "USER") & F.col("approved"), F.lit(False)), "select_not_user_approved"),
        (differs("ranker_sha256", "_ranker"), "approved_ranker_hash_mismatch"),
        (differs("calibration_sha256", "_calibration"), "approved_calibration_hash_mismatch"),
        (differs("config_sha256", "_config"), "approved_feature_config_hash_mismatch"),
        (F.size(F.array_except(need, "validators")) > 0, "approved_validator_scope_incomplete"),
        (unit("minimum_top_confidence"), "invalid_minimum_top_confidence"),
        (unit("minimum_feature_coverage"), "invalid_minimum_feature_coverage"),
    ]
    why = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in listed]))
    return approval.join(have, "approval_id", "left").select("approval_id", why.alias("reasons"))
