"""Mode experiments: scripts from documents, candidate results from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import derive_seed
from ..operators import experiment as E
from ..session import spread
from . import bindings as B
from .text_queries import ENDERS, WS, kept_sql, strip_sql

BUDGET = 2
EXPERIMENT = "exp-1"
MODE_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'existing_phrase' WHEN 1 THEN 'sentence' ELSE 'hybrid' END"


def scripts(spark, d):
    """Documents as scripts; their batch lines are the given phrases."""
    docs = spread(B.table(spark, d, "documents"))
    phrases = F.transform(
        X.batch_lines(F.col("text")),
        lambda t: F.struct(t.alias("text"), F.lit(None).cast("boolean").alias("sentence_final"), (F.length(t) > 60).alias("forced")),
    )
    return docs.select(
        F.concat(F.lit("d"), "doc_id").alias("script_id"), "text", (F.col("doc_id") * 1000003).alias("seed"), phrases.alias("existing_phrases"), "lang", "n_chars"
    )


def plan_input_validate(spark, d):
    s = scripts(spark, d).withColumn("script_id", F.when(F.col("n_chars") < 60, F.lit("dup")).otherwise(F.col("script_id")))
    s = s.withColumn("seed", F.when(F.col("lang") != "de", F.col("seed")))
    s = s.withColumn("existing_phrases", F.when(F.col("n_chars") % 2 == 0, F.slice("existing_phrases", 1, 3)).otherwise(F.col("existing_phrases")))
    return E.validate(s).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("scripts"))


LINES = kept_sql(f"regexp_split_to_array(text, '{X.LINE_END}')")
SCRIPTS_SQL = f"""
lines AS (SELECT *, {LINES} AS ls FROM documents),
given AS (SELECT *, {kept_sql(f"flatten(list_transform(ls, lambda x: string_split(regexp_replace(x, '([{ENDERS}]){WS}+', '\\1' || chr(1), 'g'), chr(1))))")} AS ps FROM lines)"""
COMPACT = lambda e: f"regexp_replace({e}, '{WS}+', '', 'g')"


def segment_modes(spark, d):
    s = E.segments(scripts(spark, d))
    return s.select(
        "segment_id", "mode", "strategy", "fallback_reason", "segment_index", "sentence_final", "forced", F.sha2("text", 256).alias("h"), "token_bound", "estimated_seconds",
        F.array_join("safety_reasons", ",").alias("reasons"),
    )


def aud(e):
    return "length(regexp_replace(" + e + ", '[^\\p{L}\\p{N}]', '', 'g'))"


def safe_sql(e):
    return f"(strlen({e})+2 <= 2048 AND round(greatest(25e-2, {aud(e)}/4e0),3) <= 32e0)"


def clause_cte(source, text):
    """Clause regrouping of (id, text) rows as a recursion, giving id and list of clauses."""
    return f"""cl_pieces AS (SELECT id, t, {kept_sql("string_split(regexp_replace(t, '(" + X.CLAUSE_BOUNDARY + ")', '\\1' || chr(1), 'g'), chr(1))")} AS ps FROM ({source}) q),
cl_walk AS (SELECT id, ps, 2 AS i, ps[1] AS open, CAST(NULL AS VARCHAR) AS closed, 0 AS pos FROM cl_pieces WHERE len(ps) >= 2
  UNION ALL SELECT id, ps, i+1, CASE WHEN nxt THEN ps[i] ELSE j END, CASE WHEN nxt THEN open END, pos + nxt::INT
  FROM (SELECT *, open || ' ' || ps[i] AS j, {aud("open || ' ' || ps[i]")} > 80 OR i > len(ps) AS nxt FROM cl_walk WHERE i <= len(ps) + 1) q),
{text} AS (SELECT id, list(closed ORDER BY pos) AS cs FROM cl_walk WHERE closed IS NOT NULL GROUP BY id UNION ALL SELECT id, [{strip_sql('t')}] FROM cl_pieces WHERE len(ps) < 2)"""


SEGMENTS_SQL = f"""WITH RECURSIVE {SCRIPTS_SQL},
tx AS (SELECT *, {strip_sql('text')} AS t0 FROM given),
se AS (SELECT *, CASE WHEN len(raw) > 0 AND {COMPACT("array_to_string(raw, '')")} = {COMPACT('t0')} THEN raw ELSE [t0] END AS sents FROM
  (SELECT *, {kept_sql(f"regexp_extract_all(t0, '{X.SENTENCE}')")} AS raw FROM tx) q),
st AS (SELECT doc_id, pos, s, {aud('s')} <= 80 AND {safe_sql('s')} AS short FROM (SELECT doc_id, unnest(range(len(sents))) AS pos, unnest(sents) AS s FROM se) q),
{clause_cte("SELECT doc_id * 1000000 + pos AS id, s AS t FROM st WHERE NOT short", "clausal")},
parts AS (SELECT st.doc_id, st.pos, CASE WHEN short THEN [s] ELSE c.cs END AS cs, NOT short AND len(c.cs) < 2 AS stuck FROM st LEFT JOIN clausal c ON c.id = st.doc_id*1000000+st.pos),
hy AS (SELECT doc_id, flatten(list(cs ORDER BY pos)) AS cs, bool_or(stuck OR len(list_filter(cs, lambda p: NOT {safe_sql('p')})) > 0) AS failed FROM parts GROUP BY doc_id),
al AS (
  SELECT doc_id, 'existing_phrase' AS mode, 'provided_existing_phrase' AS strategy, CAST(NULL AS VARCHAR) AS fb, ps AS txt, true AS giv FROM given
  UNION ALL SELECT doc_id, 'sentence', 'whole_sentence', NULL, sents, false FROM se
  UNION ALL SELECT h.doc_id, 'hybrid', CASE WHEN failed THEN 'existing_phrase_fallback' ELSE 'sentence_or_semantic_clause' END, CASE WHEN failed THEN '{E.FALLBACK}' END, CASE WHEN failed THEN g.ps ELSE h.cs END, failed
    FROM hy h JOIN given g ON g.doc_id=h.doc_id),
seg AS (SELECT doc_id, mode, strategy, fb, giv, unnest(range(len(txt)))::INT AS idx, unnest(txt) AS t FROM al),
fin AS (SELECT *, 'd' || doc_id AS script_id, regexp_matches({strip_sql('t')}, '{E.CLOSED}') AS closed, CAST(strlen(t)+2 AS INT) AS tb, round(greatest(25e-2, {aud('t')}/4e0),3) AS es FROM seg)"""
SEGMENT_TAIL = """ SELECT script_id || '.' || mode || '.' || format('s{:03d}', idx) AS segment_id, mode, strategy, fb AS fallback_reason, idx AS segment_index, closed AS sentence_final,
  CASE WHEN giv THEN length(t) > 60 WHEN mode='hybrid' THEN NOT closed ELSE false END AS forced, sha256(t) AS h, tb AS token_bound, es AS estimated_seconds,
  rtrim(concat(CASE WHEN tb>2048 THEN 'conservative_text_token_upper_bound_exceeded,' ELSE '' END, CASE WHEN es>32e0 THEN 'experiment_audio_safety_margin_exceeded,' ELSE '' END), ',') AS reasons FROM fin"""
JOBS_SQL = SEGMENTS_SQL + """,
jobs AS (SELECT f.*, c AS ci, script_id || '.' || mode || '.' || format('c{:03d}', c) AS cid, (doc_id*1000003 + 104729*c + 7919*idx) % 2147483647 AS seed, tb<=2048 AND es<=32e0 AS okay FROM fin f, (SELECT unnest([0,1]) AS c) k)"""


def jobs(spark, d):
    return E.jobs(E.segments(scripts(spark, d)), BUDGET)


def explode_jobs(spark, d):
    return jobs(spark, d).select("job_id", "candidate_id", "mode", "seed", "execution_eligible", "audio_path")


def derive_seed_q(spark, d):
    o = B.table(spark, d, "orders")
    return o.select(
        "o_orderkey", derive_seed(F.col("o_orderkey") * 1000003, F.col("o_custkey"), F.col("o_orderkey") % 13).alias("plan_seed"),
        derive_seed(F.col("o_orderkey") * 1000003, F.col("o_custkey"), F.lit(1), 2**31).alias("take_seed"),
    )


def candidates(spark, d):
    s = scripts(spark, d)
    few = F.when(F.col("lang") == "fr", 1).otherwise(BUDGET)
    rows = E.candidates(s, BUDGET).join(s.select("script_id", few.alias("_keep")), "script_id")
    return rows.where("mode <> 'hybrid' OR candidate_index < _keep").drop("_keep")


def plan_counts(spark, d):
    return E.plan_counts(jobs(spark, d), candidates(spark, d)).select("mode", "n_jobs", "n_eligible", "n_candidates", "status")


def budget_check(spark, d):
    return E.budget_errors(scripts(spark, d), candidates(spark, d), BUDGET)


def order_paths(spark, d):
    """Job outputs named after orders, some of them wrong on purpose."""
    o = B.table(spark, d, "orders")
    k, mode = F.col("o_orderkey").cast("string"), F.expr(MODE_SQL)
    audio = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("segments/"), mode, F.lit("/../"), k, F.lit(".wav")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("other/"), k, F.lit(".wav")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("segments/"), mode, F.lit("/"), k, F.lit("_voice.wav")))
        .otherwise(F.concat(F.lit("segments/"), mode, F.lit("\\"), k, F.lit(".WAV")))
    )
    meta = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("/"), k)).otherwise(F.concat(k, F.lit(".json")))
    return o.select(k.alias("job_id"), mode.alias("mode"), audio.alias("audio_path"), meta.alias("metadata_path"))


def plan_path_rules(spark, d):
    return E.path_errors(order_paths(spark, d), "job_id", "segments").select("job_id", "kind", "error")


def duplicates_check(spark, d):
    l = B.table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("job_id"))
    return E.duplicates(l, "job_id", "duplicate_or_empty_job_id")


def job_ref_check(spark, d):
    """Orders name the lines 1..3 as their jobs; lineitem holds those that exist."""
    names = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat_ws(".", F.col("o_orderkey").cast("string"), i.cast("string")))
    c = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(names).alias("segment_job_ids")
    )
    j = B.table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("job_id"))
    return E.reference_errors(c, j)


def candidate_assemble_join(spark, d):
    l = B.table(spark, d, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("job_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")
    ).groupBy("job_id").agg(F.max("p").cast("string").alias("segment_id"), F.max("s").cast("string").alias("text"))
    names = F.transform(F.sequence(F.lit(7), F.lit(1)), lambda i: F.concat_ws(".", F.col("o_orderkey").cast("string"), i.cast("string")))
    c = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), names.alias("segment_job_ids"))
    return E.assembled(c, l).select("candidate_id", "place", "job_id", "segment_id", "text")


def job_results(spark, d):
    l, o = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("script_id"), F.expr(MODE_SQL).alias("mode"),
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("job_id"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("status"),
        F.col("l_quantity").alias("generation_seconds"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).alias("tokens"),
    )


def candidate_rollup(spark, d):
    return E.rollup(job_results(spark, d))


def segment_failures(spark, d):
    return E.segment_failures(job_results(spark, d))


def results(spark, d):
    """Orders as complete candidates with signals and two validations."""
    o = B.table(spark, d, "orders")
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    none = F.lit(None)
    v = lambda name, status, hard, score, metrics: F.struct(
        F.lit(name).alias("validator_name"), status.alias("status"), F.lit(hard).alias("hard_gate"), score.cast("double").alias("score"), metrics.cast("map<string,string>").alias("metrics")
    )
    content = v(
        "content_accuracy", F.when(k % 5 == 0, "fail").when(k % 5 == 1, "odd").otherwise("pass"), True,
        F.when(k % 4 == 0, (k % 10) / 10.0), F.create_map(F.lit("normalized_edit_distance"), s((k % 8) / 4.0)),
    )
    speaker = v("speaker_similarity", F.when(k % 7 == 0, "fail").otherwise("pass"), False, none, F.create_map(F.lit("speaker_similarity"), s((k % 9) / 8.0)))
    return o.select(
        F.concat(F.lit("c"), k).alias("candidate_id"), s(F.col("o_custkey")).alias("script_id"), F.expr(MODE_SQL).alias("mode"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"),
        F.when(k % 6 == 0, F.array(F.lit("told"))).otherwise(F.array().cast("array<string>")).alias("failure_reasons"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("a/"), k, F.lit(".wav"))).alias("audio_path"),
        (F.col("o_totalprice") / 5000).alias("duration_seconds"), (F.col("o_totalprice") / 1000).alias("generation_seconds"), (k % 7).cast("double").alias("assembly_seconds"),
        F.create_map(F.lit("repetition"), F.when(F.col("o_orderpriority") == "1-URGENT", "Detected").otherwise("not_run"),
                     F.lit("abnormal_silence"), F.when(F.col("o_orderpriority") == "2-HIGH", "true").otherwise("pass")).alias("signals"),
        F.when(k % 11 == 0, F.array(speaker)).otherwise(F.array(content, speaker)).alias("validations"),
    )


RESULTS_SQL = f"""
results AS (SELECT *, o_orderkey AS k, 'c' || o_orderkey AS candidate_id, CAST(o_custkey AS VARCHAR) AS script_id, {MODE_SQL} AS mode, o_totalprice/5e3 AS dur, o_totalprice/1e3 AS gen, CAST(o_orderkey % 7 AS DOUBLE) AS asm,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not_run' WHEN o_orderkey % 5 = 0 THEN 'fail' WHEN o_orderkey % 5 = 1 THEN 'unknown' ELSE 'pass' END AS cs, CASE WHEN o_orderkey % 7 = 0 THEN 'fail' ELSE 'pass' END AS ss,
  CASE WHEN o_orderstatus <> 'P' THEN 'a/' || o_orderkey || '.wav' END AS audio_path,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 10)/1e1 ELSE greatest(0e0, 1e0-(o_orderkey % 8)/4e0) END END AS content, (o_orderkey % 9)/8e0 AS speaker FROM orders),
failed AS (SELECT *, rtrim(concat(CASE WHEN o_orderstatus='F' AND k%6<>0 THEN 'generation_status_not_pass,' ELSE '' END, CASE WHEN cs='fail' THEN 'hard_gate:content_accuracy,' ELSE '' END,
  CASE WHEN o_orderpriority='2-HIGH' THEN 'signal:abnormal_silence,' ELSE '' END, CASE WHEN o_orderpriority='1-URGENT' THEN 'signal:repetition,' ELSE '' END, CASE WHEN k%6=0 THEN 'told,' ELSE '' END), ',') AS failures FROM results)"""
BLIND_SQL = """
blinded AS (SELECT 'B' || format('{:04d}', n) AS blind_id, n AS blind_rank, 'exp-1.' || script_id AS comparison_id, script_id, candidate_id, mode, audio_path FROM
  (SELECT *, row_number() OVER (ORDER BY sha256('exp-1|' || candidate_id || '|blind-order'), candidate_id) AS n FROM failed WHERE failures='' AND audio_path IS NOT NULL) q)"""


def validator_failures(spark, d):
    return E.validator_failures(results(spark, d))


def failure_reasons(spark, d):
    return E.failure_reasons(results(spark, d)).select("candidate_id", "mode", F.array_join("failures", ",").alias("failures"))


def failure_histogram(spark, d):
    return E.failure_histogram(results(spark, d))


def mode_analysis(spark, d):
    return E.analyse(results(spark, d))


def mode_timing(spark, d):
    return E.timing(E.analyse(results(spark, d)))


def status_counts(spark, d):
    return E.status_counts(results(spark, d)).withColumnRenamed("pass", "n_pass").withColumnRenamed("fail", "n_fail")


def fairness_check(spark, d):
    return E.fairness(results(spark, d))


def blinded(spark, d):
    return E.blind(results(spark, d), EXPERIMENT)


def blind_order(spark, d):
    return E.answer_key(blinded(spark, d))


def blind_comparisons(spark, d):
    return E.public(blinded(spark, d))


def preference_tally(spark, d):
    """Each user votes once per event for a blind number, in the comparison of some order."""
    b = blinded(spark, d)
    e = B.table(spark, d, "events")
    votes = e.join(b.select(F.col("blind_rank").alias("event_id"), "comparison_id", "blind_id"), "event_id").select(
        "comparison_id", F.col("user_id").alias("listener_id"),
        F.when(F.col("event_type") == "error", F.concat("blind_id", F.lit("x"))).otherwise(F.col("blind_id")).alias("preferred_blind_id"),
    )
    return E.tally(votes, b)


ANALYSIS_SQL = B.with_sql(RESULTS_SQL, "modes AS (SELECT unnest(['existing_phrase','sentence','hybrid']) AS mode)", tail="""
SELECT m.mode, count(k) AS candidate_count, count(k) FILTER (failures<>'') AS failed_candidate_count, count(k) FILTER (failures='') AS successful_candidate_count, round(count(k) FILTER (failures<>'')/CAST(count(k) AS DOUBLE),6) AS failure_rate,
  round(avg(content),6) AS mean_content_accuracy, round(avg(speaker),6) AS mean_speaker_similarity, CAST(NULL AS DOUBLE) AS mean_existing_prosody_score, CAST(NULL AS DOUBLE) AS mean_phrase_transition_score,
  round(avg(dur),6) AS mean_duration_seconds, round(avg(gen),6) AS mean_generation_seconds, round(avg(asm),6) AS mean_assembly_seconds, 0 AS signal_hallucination, count(k) FILTER (o_orderpriority='1-URGENT') AS signal_repetition,
  0 AS signal_speaker_drift, count(k) FILTER (o_orderpriority='2-HIGH') AS signal_abnormal_silence, round(sum(dur),6) AS total_duration_seconds, round(sum(gen),6) AS total_generation_seconds, round(sum(asm),6) AS total_assembly_seconds,
  round(sum(gen)+sum(asm),6) AS total_processing_seconds, round((sum(gen)+sum(asm))/sum(dur),6) AS real_time_factor FROM modes m LEFT JOIN failed f ON f.mode=m.mode GROUP BY m.mode""")
QUERIES = {
    "validator_failures": (validator_failures, B.with_sql(RESULTS_SQL, tail="""SELECT mode, 'content_accuracy' AS validator_name, 'unspecified' AS reason, count(*) AS n FROM results WHERE cs='fail' GROUP BY ALL
        UNION ALL SELECT mode, 'speaker_similarity', 'unspecified', count(*) FROM results WHERE ss='fail' GROUP BY ALL""")),
    "plan_input_validate": (plan_input_validate, B.with_sql(SCRIPTS_SQL, f"""c AS (SELECT *, CASE WHEN n_chars<60 THEN 'dup' ELSE 'd' || doc_id END AS sid, CASE WHEN n_chars % 2 = 0 THEN ps[1:3] ELSE ps END AS pp FROM given),
        e AS (SELECT CASE WHEN count(*) OVER (PARTITION BY sid) > 1 THEN 'script_id_not_unique_or_safe' WHEN {strip_sql('text')} = '' OR len(pp)=0 THEN 'text_or_phrases_missing' WHEN lang='de' THEN 'seed_not_integer'
        WHEN {COMPACT("array_to_string(pp, '')")} <> {COMPACT('text')} THEN 'phrases_do_not_cover_text' ELSE 'none' END AS error FROM c)""", tail="SELECT error, count(*) AS scripts FROM e GROUP BY error")),
    "segment_modes": (segment_modes, SEGMENTS_SQL + SEGMENT_TAIL),
    "explode_jobs": (explode_jobs, JOBS_SQL + """ SELECT cid || '.' || format('s{:03d}', idx) AS job_id, cid AS candidate_id, mode, seed, okay AS execution_eligible,
        'segments/' || mode || '/' || script_id || '/' || cid || '/' || cid || '.' || format('s{:03d}', idx) || '.wav' AS audio_path FROM jobs"""),
    "derive_seed": (derive_seed_q, """SELECT o_orderkey, (o_orderkey*1000003 + 104729*o_custkey + 7919*(o_orderkey % 13)) % 2147483647 AS plan_seed, (o_orderkey*1000003 + 104729*o_custkey + 7919) % 2147483648 AS take_seed FROM orders"""),
    "plan_counts": (plan_counts, JOBS_SQL + """, cc AS (SELECT 'existing_phrase' AS mode, count(*)*2 AS n FROM documents UNION ALL SELECT 'sentence', count(*)*2 FROM documents UNION ALL SELECT 'hybrid', sum(CASE WHEN lang='fr' THEN 1 ELSE 2 END) FROM documents)
        SELECT j.mode, j.n AS n_jobs, j.e AS n_eligible, CAST(cc.n AS BIGINT) AS n_candidates, CASE WHEN j.n=j.e THEN 'pass' ELSE 'fail' END AS status FROM (SELECT mode, count(*) AS n, count(*) FILTER (okay) AS e FROM jobs GROUP BY mode) j JOIN cc ON cc.mode=j.mode"""),
    "budget_check": (budget_check, "SELECT 'd' || doc_id AS script_id, 'hybrid' AS mode, 1 AS n FROM documents WHERE lang='fr'"),
    "plan_path_rules": (plan_path_rules, """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'metadata_path' AS kind, 'unsafe_output_path' AS error FROM orders WHERE o_orderstatus='P'
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'audio_path', CASE o_orderpriority WHEN '1-URGENT' THEN 'unsafe_output_path' WHEN '2-HIGH' THEN 'path_outside_mode_namespace' ELSE 'forbidden_production_name' END FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')"""),
    "duplicates_check": (duplicates_check, "SELECT l_orderkey || '.' || l_linenumber AS value, count(*) AS n, 'duplicate_or_empty_job_id' AS error FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "job_ref_check": (job_ref_check, """SELECT o_orderkey AS candidate_id FROM orders WHERE o_orderstatus='P' OR (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey=o_orderkey AND l_linenumber BETWEEN 1 AND 3) < 3"""),
    "candidate_assemble_join": (candidate_assemble_join, """SELECT l_orderkey AS candidate_id, 7-l_linenumber AS place, l_orderkey || '.' || l_linenumber AS job_id, CAST(max(l_partkey) AS VARCHAR) AS segment_id, CAST(max(l_suppkey) AS VARCHAR) AS text
        FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_linenumber BETWEEN 1 AND 7 GROUP BY l_orderkey, l_linenumber"""),
    "candidate_rollup": (candidate_rollup, f"""SELECT o_orderkey AS candidate_id, o_custkey AS script_id, {MODE_SQL} AS mode, CASE WHEN bool_or(l_returnflag='R') THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (l_returnflag='R') AS n_failed, count(*) AS n_segments,
        round(sum(l_quantity),6) AS generation_seconds, CAST(sum(CASE WHEN l_linestatus='F' THEN l_partkey ELSE 0 END) AS BIGINT) AS tokens FROM lineitem JOIN orders ON o_orderkey=l_orderkey GROUP BY ALL"""),
    "segment_failures": (segment_failures, "SELECT l_orderkey AS candidate_id, 'segment_failed:' || l_orderkey || '.' || l_linenumber AS reason FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_returnflag='R'"),
    "failure_reasons": (failure_reasons, B.with_sql(RESULTS_SQL, tail="SELECT candidate_id, mode, failures FROM failed")),
    "failure_histogram": (failure_histogram, B.with_sql(RESULTS_SQL, tail="SELECT mode, reason, count(*) AS n FROM (SELECT mode, unnest(string_split(failures, ',')) AS reason FROM failed WHERE failures<>'') q GROUP BY ALL")),
    "mode_analysis": (mode_analysis, ANALYSIS_SQL),
    "mode_timing": (mode_timing, f"SELECT {', '.join(E.TIMING)} FROM ({ANALYSIS_SQL}) z"),
    "status_counts": (status_counts, B.with_sql(RESULTS_SQL, """long AS (SELECT mode, 'content_accuracy' AS validator_name, cs AS s FROM results UNION ALL SELECT mode, 'speaker_similarity', ss FROM results
        UNION ALL SELECT mode, v, 'not_run' FROM results, (SELECT unnest(['audio_sanity','existing_prosody_gates','phrase_transition','boundary_alignment']) AS v) q)""",
        tail="SELECT mode, validator_name, count(*) FILTER (s='pass') AS n_pass, count(*) FILTER (s='fail') AS n_fail, count(*) FILTER (s='unknown') AS unknown, count(*) FILTER (s='not_run') AS not_run FROM long GROUP BY ALL")),
    "fairness_check": (fairness_check, B.with_sql(RESULTS_SQL, tail="""SELECT script_id, existing_phrase, sentence, hybrid, existing_phrase=sentence AND sentence=hybrid AND hybrid>0 AS fair FROM
        (SELECT script_id, count(*) FILTER (mode='existing_phrase') AS existing_phrase, count(*) FILTER (mode='sentence') AS sentence, count(*) FILTER (mode='hybrid') AS hybrid FROM results GROUP BY script_id) q""")),
    "blind_order": (blind_order, B.with_sql(RESULTS_SQL, BLIND_SQL, tail="SELECT blind_id, candidate_id, mode, audio_path FROM blinded")),
    "blind_comparisons": (blind_comparisons, B.with_sql(RESULTS_SQL, BLIND_SQL, tail="SELECT blind_id, script_id, comparison_id, 'blind_audio/' || blind_id || '.wav' AS package_path FROM blinded")),
    "preference_tally": (preference_tally, B.with_sql(RESULTS_SQL, BLIND_SQL, tail="""SELECT CASE WHEN event_type='error' THEN 'invalid_vote' ELSE mode END AS mode, count(*) AS votes, count(DISTINCT user_id) AS listeners
        FROM events JOIN blinded ON blind_rank=event_id GROUP BY ALL""")),
}
