"""Comparing generation modes: plans, checks, results, blind reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import derive_seed, finite
from .ordered import number_rows

MODES = ("existing_phrase", "sentence", "hybrid")
VALIDATORS = (
    "content_accuracy", "audio_sanity", "speaker_similarity", "existing_prosody_gates", "phrase_transition",
    "boundary_alignment",
)
SIGNALS = ("hallucination", "repetition", "speaker_drift", "abnormal_silence")
STATUSES = ("pass", "fail", "unknown", "not_run")
SAFE_ID = "^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"
FALLBACK = "semantic_split_unavailable_or_safety_limit"
CLOSED = rf"[{X.ENDERS}]+\z"


def validate(scripts: DataFrame) -> DataFrame:
    """First broken constraint of each script row.

    ``scripts``: script_id, text, seed, existing_phrases (array of struct with
    ``text``). Uniqueness is an aggregate joined back, not a window over an id.
    """
    copies = scripts.groupBy("script_id").agg(F.count(F.lit(1)).alias("_copies"))
    parts = F.transform("existing_phrases", lambda p: X.strip(F.coalesce(p["text"], F.lit(""))))
    text = X.strip(F.coalesce(F.col("text"), F.lit("")))
    checks = [
        (~F.coalesce(F.col("script_id").rlike(SAFE_ID), F.lit(False)) | (F.col("_copies") > 1), "script_id_not_unique_or_safe"),
        ((text == "") | (F.coalesce(F.size("existing_phrases"), F.lit(0)) <= 0), "text_or_phrases_missing"),
        (F.col("seed").isNull(), "seed_not_integer"),
        (F.exists(parts, lambda p: p == ""), "phrase_text_empty"),
        (X.compact(F.array_join(parts, "")) != X.compact(text), "phrases_do_not_cover_text"),
    ]
    error = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        error = F.when(condition, F.lit(name)).otherwise(error)
    return scripts.join(copies, "script_id", "left").withColumn("error", error).drop("_copies")


def _segment(text: Column, final: Column, forced: Column) -> Column:
    return F.struct(text.alias("text"), final.alias("sentence_final"), forced.alias("forced"))


def segments(scripts: DataFrame) -> DataFrame:
    """Three segmentations of each script: as given, by sentence, and hybrid.

    Hybrid keeps short safe sentences, cuts long ones into clauses, and falls
    back to the given phrases for the whole script where that fails.
    """
    closed = lambda t: X.strip(t).rlike(CLOSED)
    given = F.transform(
        "existing_phrases",
        lambda p: _segment(
            X.strip(p["text"]), F.coalesce(p["sentence_final"], closed(p["text"])), F.coalesce(p["forced"], F.lit(False))
        ),
    )
    # each projection below feeds several uses, so Spark keeps it as a step of its own
    cut = scripts.select("script_id", "seed", given.alias("given"), X.sentences_multi(F.col("text")).alias("sents"))

    def judged(s: Column) -> Column:
        short = (X.audible(s) <= X.SOFT_LIMIT) & X.safe(s)
        return F.struct(short.alias("short"), F.when(short, F.array(s)).otherwise(X.clauses(s)).alias("parts"))

    tried = cut.withColumn("tried", F.transform("sents", judged))
    # a long sentence that stayed whole, or an unsafe piece, sinks the script's hybrid form
    failed = F.exists(
        "tried", lambda t: ~t["short"] & ((F.size(t["parts"]) < 2) | F.exists(t["parts"], lambda p: ~X.safe(p)))
    )
    staged = tried.select("script_id", "seed", "given", "sents", F.flatten("tried.parts").alias("parts"), failed.alias("failed"))
    whole = F.transform("sents", lambda s: _segment(s, closed(s), F.lit(False)))
    mixed = F.transform("parts", lambda s: _segment(s, closed(s), ~closed(s)))
    form = lambda mode, strategy, segs, why: F.struct(
        F.lit(mode).alias("mode"), strategy.alias("strategy"), segs.alias("segs"), why.alias("fallback_reason")
    )
    none = F.lit(None).cast("string")
    forms = F.array(
        form("existing_phrase", F.lit("provided_existing_phrase"), F.col("given"), none),
        form("sentence", F.lit("whole_sentence"), whole, none),
        form(
            "hybrid",
            F.when(F.col("failed"), "existing_phrase_fallback").otherwise("sentence_or_semantic_clause"),
            F.when(F.col("failed"), F.col("given")).otherwise(mixed),
            F.when(F.col("failed"), F.lit(FALLBACK)),
        ),
    )
    rows = staged.select("script_id", "seed", F.inline(forms)).select(
        "script_id", "seed", "mode", "strategy", "fallback_reason", F.posexplode("segs").alias("segment_index", "_s")
    )
    out = rows.select("script_id", "seed", "mode", "strategy", "fallback_reason", "segment_index", "_s.*")
    return out.withColumns(
        {
            "segment_id": F.concat_ws(".", "script_id", "mode", F.format_string("s%03d", "segment_index")),
            "token_bound": X.token_bound(F.col("text")),
            "estimated_seconds": X.estimated_seconds(F.col("text")),
            "safety_reasons": X.safety_reasons(F.col("text")),
        }
    )


def jobs(segs: DataFrame, budget: int = 4) -> DataFrame:
    """One generation job per segment and candidate, in place: no join."""
    index = F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("candidate_index")
    rows = segs.select("*", index)
    candidate = F.concat_ws(".", "script_id", "mode", F.format_string("c%03d", "candidate_index"))
    rows = rows.withColumn("candidate_id", candidate).withColumn(
        "job_id", F.concat_ws(".", "candidate_id", F.format_string("s%03d", "segment_index"))
    )
    stem = F.concat_ws("/", F.lit("segments"), "mode", "script_id", "candidate_id", "job_id")
    return rows.select(
        "job_id", "candidate_id", "candidate_index", "script_id", "mode", "segment_id", "segment_index", "text",
        derive_seed(F.col("seed"), F.col("candidate_index"), F.col("segment_index")).alias("seed"),
        (F.size("safety_reasons") == 0).alias("execution_eligible"),
        F.concat(stem, F.lit(".wav")).alias("audio_path"),
        F.concat(stem, F.lit(".json")).alias("metadata_path"),
    )


def candidates(scripts: DataFrame, budget: int = 4) -> DataFrame:
    """The planned complete assemblies: budget per script and mode."""
    fan = F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")
    rows = scripts.select("script_id", "seed", fan).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))).alias("candidate_index")
    )
    name = F.concat_ws(".", "script_id", "mode", F.format_string("c%03d", "candidate_index"))
    rows = rows.withColumn("candidate_id", name)
    stem = F.concat_ws("/", F.lit("candidates"), "mode", "script_id", "candidate_id")
    return rows.select(
        "candidate_id", "candidate_index", "script_id", "mode",
        derive_seed(F.col("seed"), F.col("candidate_index"), F.lit(0)).alias("seed"),
        F.concat(stem, F.lit(".wav")).alias("audio_path"), F.concat(stem, F.lit(".json")).alias("metadata_path"),
    )


RESERVED_SUFFIXES = ("_voice.wav", "pins.json")


def path_errors(rows: DataFrame, key: str, root: str, reserved: tuple[str, ...] = RESERVED_SUFFIXES) -> DataFrame:
    """Unsafe, misplaced or reserved output paths, one row per finding.

    ``rows``: key, mode, audio_path, metadata_path. ``root`` is the top folder
    that audio must stay in, followed by its mode; ``reserved`` are the endings of
    the names that production output uses.
    """

    def entry(kind: str, suffix: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(suffix).alias("suffix"), F.col(kind).alias("path"))

    long = rows.select(key, "mode", F.inline(F.array(entry("audio_path", ".wav"), entry("metadata_path", ".json"))))
    path = F.regexp_replace(F.coalesce("path", F.lit("")), r"\\", "/")
    lower = F.lower(path)
    unsafe = (path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)") | ~F.endswith(lower, F.col("suffix"))
    outside = (F.col("kind") == "audio_path") & ~F.startswith(path, F.concat(F.lit(f"{root}/"), F.col("mode"), F.lit("/")))
    production = F.lit(False)
    for suffix in reserved:
        production = production | lower.endswith(suffix)
    found = F.array_compact(
        F.array(
            F.when(unsafe, F.lit("unsafe_output_path")),
            F.when(~unsafe & outside, F.lit("path_outside_mode_namespace")),
            F.when(~unsafe & production, F.lit("forbidden_production_name")),
        )
    )
    return long.select(key, "kind", "path", F.explode(found).alias("error"))


def duplicates(rows: DataFrame, column: str, error: str) -> DataFrame:
    """Values that are empty or occur more than once."""
    counted = rows.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1 OR value = ''").select("value", "n", F.lit(error).alias("error"))


def reference_errors(cands: DataFrame, job_rows: DataFrame) -> DataFrame:
    """Candidates that name no job, or one that does not exist. ``cands``: candidate_id, segment_job_ids."""
    named = cands.select("candidate_id", F.explode_outer("segment_job_ids").alias("job_id"))
    lost = named.join(job_rows.select("job_id").distinct(), "job_id", "left_anti")
    return lost.select("candidate_id").distinct()


def plan_counts(job_rows: DataFrame, cands: DataFrame) -> DataFrame:
    """Jobs, eligible jobs and candidates per mode, empty modes included."""
    dim = job_rows.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    j = job_rows.groupBy("mode").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if("execution_eligible").alias("n_eligible"))
    c = cands.groupBy("mode").agg(F.count(F.lit(1)).alias("n_candidates"))
    out = dim.join(j, "mode", "left").join(c, "mode", "left").na.fill(0)
    good = (F.col("n_candidates") > 0) & (F.col("n_jobs") > 0) & (F.col("n_jobs") == F.col("n_eligible"))
    return out.withColumn("status", F.when(good, "pass").otherwise("fail"))


def budget_errors(scripts: DataFrame, cands: DataFrame, budget: int) -> DataFrame:
    """Script and mode pairs whose number of candidates is not the budget."""
    want = scripts.select("script_id", F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode")).distinct()
    have = cands.groupBy("script_id", "mode").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["script_id", "mode"], "left").na.fill(0, ["n"]).where(F.col("n") != budget)


def rollup(job_results: DataFrame) -> DataFrame:
    """Candidate outcome from its segments. ``job_results``: candidate_id, script_id,
    mode, job_id, status, generation_seconds, tokens, duration_seconds.

    Reasons stay as one row per failed segment (see ``segment_failures``).
    """
    return job_results.groupBy("candidate_id", "script_id", "mode").agg(
        F.when(F.bool_and(F.col("status") == "pass"), "pass").otherwise("fail").alias("status"),
        F.count_if(F.col("status") != "pass").alias("n_failed"),
        F.count(F.lit(1)).alias("n_segments"),
        F.round(F.sum(F.coalesce("generation_seconds", F.lit(0.0))), 6).alias("generation_seconds"),
        F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
    )


def segment_failures(job_results: DataFrame) -> DataFrame:
    return job_results.where("status <> 'pass'").select(
        "candidate_id", F.concat(F.lit("segment_failed:"), F.col("job_id")).alias("reason")
    )


def assembled(cands: DataFrame, job_rows: DataFrame) -> DataFrame:
    """Segments of each candidate in the order the candidate names them."""
    named = cands.select("candidate_id", F.posexplode("segment_job_ids").alias("place", "job_id"))
    return named.join(job_rows.select("job_id", "segment_id", "text"), "job_id")


def signal_fails(value: Column) -> Column:
    return F.lower(value.cast("string")).isin("true", "fail", "failed", "detected")


def validator_failures(results: DataFrame) -> DataFrame:
    """(mode, validator_name, reason, n): why each mode's validators failed; a failing row without a reason is ``unspecified``."""
    reasons = F.col("v.reasons") if "reasons" in results.select(F.explode("validations").alias("v")).select("v.*").columns else F.lit(None).cast("array<string>")
    told = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, reasons).otherwise(F.array(F.lit("unspecified")))
    rows = results.select("mode", F.explode("validations").alias("v")).where("v.status = 'fail'")
    return rows.select("mode", "v.validator_name", F.explode(told).alias("reason")).groupBy("mode", "validator_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def failure_reasons(results: DataFrame) -> DataFrame:
    """Adds ``failures``: sorted distinct reasons why a candidate does not count."""
    told = F.coalesce("failure_reasons", F.array().cast("array<string>"))
    bare = F.when((F.coalesce("status", F.lit("")) != "pass") & (F.size(told) == 0), F.array(F.lit("generation_status_not_pass"))).otherwise(
        F.array().cast("array<string>")
    )
    signals = F.coalesce(
        F.transform(
            F.filter(F.map_entries("signals"), lambda e: F.coalesce(signal_fails(e["value"]), F.lit(False))),
            lambda e: F.concat(F.lit("signal:"), e["key"]),
        ),
        F.array().cast("array<string>"),
    )
    gates = F.coalesce(
        F.transform(
            F.filter("validations", lambda v: F.coalesce(v["hard_gate"] & (v["status"] == "fail"), F.lit(False))),
            lambda v: F.concat(F.lit("hard_gate:"), F.coalesce(v["validator_name"], F.lit("unknown"))),
        ),
        F.array().cast("array<string>"),
    )
    return results.withColumn("failures", F.array_sort(F.array_distinct(F.concat(told, bare, signals, gates))))


def _validation(name: str) -> Column:
    return F.get(F.filter("validations", lambda v: v["validator_name"] == name), 0)


def _score(name: str, keys: tuple[str, ...], invert: str | None = None) -> Column:
    """First finite number: the row's own ``score`` if named, then its metrics, then 1 - ``invert``."""
    v = _validation(name)
    number = lambda k: finite(v["metrics"][k].try_cast("double"))
    found = ([finite(v["score"])] if "score" in keys else []) + [number(k) for k in keys]
    if invert:
        raw = number(invert)
        found.append(F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - raw)))
    return F.coalesce(*found)


def analyse(results: DataFrame) -> DataFrame:
    """One row per mode, empty modes included: counts, means, totals, real-time factor."""
    dim = results.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    rows = failure_reasons(results).withColumns(
        {
            "_content": _score("content_accuracy", ("content_score", "score"), "normalized_edit_distance"),
            "_speaker": _score("speaker_similarity", ("primary_chatterbox_similarity", "primary_similarity", "speaker_similarity", "score")),
            "_prosody": _score("existing_prosody_gates", ("score",)),
            "_transition": _score("phrase_transition", ("transition_score", "score")),
            "_dur": finite(F.col("duration_seconds")),
            "_gen": finite(F.col("generation_seconds")),
            "_asm": finite(F.col("assembly_seconds")),
        }
    )
    failed = F.size("failures") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    grouped = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(failed).alias("failed_candidate_count"),
        *[F.round(F.avg(c), 6).alias(n) for c, n in (
            ("_content", "mean_content_accuracy"), ("_speaker", "mean_speaker_similarity"),
            ("_prosody", "mean_existing_prosody_score"), ("_transition", "mean_phrase_transition_score"),
            ("_dur", "mean_duration_seconds"), ("_gen", "mean_generation_seconds"), ("_asm", "mean_assembly_seconds"))],
        *[F.count_if(F.coalesce(signal_fails(F.col("signals")[s]), F.lit(False))).alias(f"signal_{s}") for s in SIGNALS],
        total("_dur").alias("_d"), total("_gen").alias("_g"), total("_asm").alias("_a"),
    )
    counts = ["candidate_count", "failed_candidate_count", *[f"signal_{s}" for s in SIGNALS]]
    out = dim.join(grouped, "mode", "left").na.fill(0, counts).na.fill(0.0, ["_d", "_g", "_a"])
    n = F.col("candidate_count")
    return out.withColumns(
        {
            "successful_candidate_count": n - F.col("failed_candidate_count"),
            "failure_rate": F.round(F.try_divide(F.col("failed_candidate_count").cast("double"), n), 6),
            "total_duration_seconds": F.round("_d", 6),
            "total_generation_seconds": F.round("_g", 6),
            "total_assembly_seconds": F.round("_a", 6),
            "total_processing_seconds": F.round(F.col("_g") + F.col("_a"), 6),
            "real_time_factor": F.round(F.try_divide(F.col("_g") + F.col("_a"), F.col("_d")), 6),
        }
    ).drop("_d", "_g", "_a")


TIMING = (
    "mode", "candidate_count", "total_generation_seconds", "mean_generation_seconds", "total_assembly_seconds",
    "mean_assembly_seconds", "total_processing_seconds", "total_duration_seconds", "real_time_factor",
)


def timing(analysis: DataFrame) -> DataFrame:
    return analysis.select(*TIMING)


def failure_histogram(results: DataFrame) -> DataFrame:
    rows = failure_reasons(results).select("mode", F.explode("failures").alias("reason"))
    return rows.groupBy("mode", "reason").agg(F.count(F.lit(1)).alias("n"))


def status_counts(results: DataFrame) -> DataFrame:
    """Per mode and validator: how many candidates have each status; absent is not_run, odd is unknown."""

    def entry(name: str) -> Column:
        status = F.coalesce(_validation(name)["status"], F.lit("not_run"))
        known = F.when(status.isin(*STATUSES), status).otherwise("unknown")
        return F.struct(F.lit(name).alias("validator_name"), known.alias("status"))

    long = results.select("mode", F.inline(F.array(*[entry(n) for n in VALIDATORS])))
    return long.groupBy("mode", "validator_name").pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0)


def fairness(results: DataFrame) -> DataFrame:
    """Scripts whose modes do not have the same, non-zero number of candidates are violations."""
    per = results.groupBy("script_id").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in MODES])
    fair = (F.least(*MODES) == F.greatest(*MODES)) & (F.least(*MODES) > 0)
    return per.withColumn("fair", fair)


def blind(results: DataFrame, experiment_id: str) -> DataFrame:
    """Blind ids of eligible candidates in hash order.

    The whole row is the answer key; ``public`` and ``answer_key`` project it.
    Numbering runs in hash chunks, so there is no single-task sort.
    """
    fit = failure_reasons(results).where((F.size("failures") == 0) & F.col("audio_path").isNotNull() & (F.col("audio_path") != ""))
    mixed = fit.withColumn("_h", F.sha2(F.concat(F.lit(f"{experiment_id}|"), F.col("candidate_id"), F.lit("|blind-order")), 256))
    placed = number_rows(mixed, [], [F.col("_h"), F.col("candidate_id")], [F.substring("_h", 1, 4)], "_n")
    return placed.withColumn("blind_id", F.format_string("B%04d", "_n")).select(
        "blind_id", F.col("_n").alias("blind_rank"), F.concat(F.lit(f"{experiment_id}."), F.col("script_id")).alias("comparison_id"),
        "script_id", "candidate_id", "mode", "audio_path",
    )


def public(blinded: DataFrame) -> DataFrame:
    """What listeners may see: no mode, no source path."""
    return blinded.select(
        "blind_id", "script_id", "comparison_id", F.concat(F.lit("blind_audio/"), F.col("blind_id"), F.lit(".wav")).alias("package_path")
    )


def answer_key(blinded: DataFrame) -> DataFrame:
    return blinded.select("blind_id", "candidate_id", "mode", "audio_path")


def tally(votes: DataFrame, blinded: DataFrame) -> DataFrame:
    """Votes per mode; a vote must name a blind id of its own comparison.

    ``votes``: comparison_id, listener_id, preferred_blind_id.
    """
    known = blinded.select("comparison_id", F.col("blind_id").alias("preferred_blind_id"), "mode")
    joined = votes.join(known, ["comparison_id", "preferred_blind_id"], "left")
    return joined.groupBy(F.coalesce("mode", F.lit("invalid_vote")).alias("mode")).agg(
        F.count(F.lit(1)).alias("votes"), F.count_distinct("listener_id").alias("listeners")
    )
