"""User-supplied validators, table functions, stores and decoders on the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import korean, text as X
from ..functions.numeric import sigmoid
from ..functions.vectors import to_int16
from ..operators import audio, bank, content, experiment as E, shadow
from ..operators.ordered import number_rows, previous_row, running_before
from ..session import scratch_path
from ..sources import sinks
from . import bindings as B
from .bank_queries import BANKED, IDENT, bank_revisions, pinned_phrases
from .experiment_queries import ANALYSIS_SQL, results
from .ranking_queries import PAIRED, candidates, fixed_model

from .text_queries import HDOC, PHRASES_SQL, QUIET, WS, align_sql, docs, hangul_docs, turns


def row_check(row):
    """A check a user might write: it trips over questions and odd syllable counts."""
    if row["question"]:
        raise LookupError("no model for questions")
    rate = 60.0 / (row["n_syl"] - 13)
    return ("pass" if abs(rate) > 4 else "fail"), rate, ([] if abs(rate) > 4 else ["too_slow"])


def checked(spark, d):
    t = B.takes(spark, d).select(*IDENT, "n_syl", "question")
    return shadow.guarded_validator("mos", False, row_check)(t)


def exception_rows(spark, d):
    r = checked(spark, d)
    return r.select(*IDENT, "status", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


CHECK_SQL = """
checked AS (SELECT *, CASE WHEN question OR n_syl = 13 THEN 'unknown' WHEN abs(60e0/(n_syl-13)) > 4 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN NOT question AND n_syl <> 13 THEN 60e0/(n_syl-13) END AS score,
  CASE WHEN question THEN 'validator_exception:LookupError' WHEN n_syl = 13 THEN 'validator_exception:ZeroDivisionError' WHEN abs(60e0/(n_syl-13)) > 4 THEN '' ELSE 'too_slow' END AS reasons FROM takes)"""


def validator_plugin(spark, d):
    """A DataFrame validator next to a row check; takes it skips are not_run."""
    t = B.takes(spark, d)
    steep = t.where("numeric_heavy").select(
        *IDENT, F.lit("audio_sanity").alias("validator_name"), F.when(F.col("end_slope") < -30, "fail").otherwise("pass").alias("status"),
        F.lit(True).alias("hard_gate"), F.col("end_slope").alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit(None).cast("map<string,double>").alias("metrics"),
    )
    v = shadow.complete_validations(t, steep.unionByName(checked(spark, d)))
    return v.groupBy("validator_name", "status").agg(F.count(F.lit(1)).alias("takes"), F.round(F.sum("score"), 4).alias("total"))


def is_question_shadow(spark, d):
    return hangul_docs(spark, d).select("doc_id", X.is_question_shadow(F.col("text")).alias("shadow"), X.is_question(F.col("text")).alias("production"))


def compact(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(X.compact(F.col("text")), 256).alias("h"))


def sigmoid_q(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", F.round(sigmoid((F.col("value") - 40) / 7), 6).alias("p"), F.round(sigmoid(-F.col("value") * 1000), 6).alias("floor"))


def utility(spark, d):
    m = fixed_model()
    return candidates(spark, d).groupBy("project_id", "sentence_class").agg(F.round(F.avg(m.utility()), 6).alias("mean_utility"), F.round(F.max(m.utility()), 6).alias("best"))


def force_split(spark, d):
    """Forced pieces of each script."""
    p = content.phrase_table(hangul_docs(spark, d), ["doc_id"])
    return p.where("forced").select("doc_id", "phrase_idx", F.sha2("text", 256).alias("h"), "sentence_final")


def phrase_udtf(spark, d):
    """The table function called from SQL over the script table."""
    spark.udtf.register("cut_phrases", content.make_phrase_udtf())
    scripts = hangul_docs(spark, d).select("doc_id", "lang", X.respell(F.col("text")).alias("spoken"))
    return spark.sql("SELECT doc_id, lang, phrase_idx, sha2(text, 256) AS h, sentence_final, forced FROM cut_phrases(TABLE({scripts}), 'spoken')", scripts=scripts)


def align_udf(spark, d):
    """The alignment of turns cut at single blanks, all four counts."""
    t = turns(spark, d).withColumns({"e": F.split("expected", " "), "a": F.split("actual", " ")}).withColumn("al", korean.align("e", "a"))
    return t.select("conv_id", "turn", *[F.col(f"al.{c}").alias(c) for c in korean.ALIGNMENT])


def config_hash(spark, d):
    """Sanity configurations as suppliers would ask for them: one tag per pair of replaced thresholds."""
    c = B.table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 1000 + 8000).cast("int").alias("rate"), ((F.col("s_suppkey") % 8 + 1) / F.lit(8.0)).alias("shortest"))
    return c.select("s_suppkey", audio.SanityConfig.config_hash_of(expected_sample_rate_hz=F.col("rate"), minimum_duration_seconds=F.col("shortest")).alias("config_hash"))


CONFIG_SQL = "SELECT s_suppkey, sha256('{' || " + " || ',' || ".join(
    f"""'"{name}":' || """ + {"expected_sample_rate_hz": "CAST(s_nationkey*1000+8000 AS INT)", "minimum_duration_seconds": "CAST((s_suppkey % 8 + 1)/8e0 AS VARCHAR)"}.get(name, "'" + json.dumps(value) + "'")
    for name, value in sorted(R.SANITY.items())) + " || '}') AS config_hash FROM supplier"


def scan_wav(spark, d):
    """Embeddings written as 16-bit WAV bytes inside Spark, then decoded."""
    e = B.table(spark, d, "embeddings").withColumn("pcm", to_int16(F.transform("embedding", lambda x: x.cast("double"))))
    half = lambda x: F.lpad(F.hex(F.pmod(x, F.lit(65536))), 4, "0")
    le16 = lambda x: F.concat(F.substring(half(x), 3, 2), F.substring(half(x), 1, 2))
    le32 = lambda x: F.concat(le16(F.pmod(x, F.lit(65536))), le16(F.floor(x / 65536)))
    size = F.size("pcm") * 2
    head = F.concat(
        F.lit(b"RIFF".hex()), le32(size + 36), F.lit(b"WAVEfmt ".hex()), le32(F.lit(16)), le16(F.lit(1)), le16(F.lit(1)), le32(F.lit(24000)),
        le32(F.lit(48000)), le16(F.lit(2)), le16(F.lit(16)), F.lit(b"data".hex()), le32(size),
    )
    body = F.array_join(F.transform("pcm", le16), "")
    wav = F.when(F.col("label") == 5, F.unhex(F.substring(F.concat(head, body), 1, 120))).otherwise(F.unhex(F.concat(head, body)))
    files = e.select(F.concat(F.lit("v"), "vec_id").alias("path"), wav.alias("content"))
    r = audio.decode(files)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 32768)
    return r.select("path", "sample_rate_hz", "channels", "sample_width", F.size("samples").alias("n"), F.round(total, 3).alias("total"), "decode_error")


def bank_store(spark, d):
    """Three ingest runs into Parquet tables: all files, all again, then known and unreadable files only."""
    parsed = bank_revisions(spark, d, pinned_phrases(spark, d)).select(
        *IDENT, "path", "sha256", F.col("revision_seq").cast("bigint").alias("seq"), F.col("generated_at").alias("modified"), "ok", "why", "n_syl", "dur",
        "tail_delta", "range_st", "pinned_take", F.lit(None).cast("string").alias("error"),
    )
    store, along = bank.Bank(spark, scratch_path(spark, "bank")), ("phrase_id",)
    store.ingest(parsed, None, "r1", along)
    again = store.ingest(parsed, None, "r2", along)
    broken = parsed.groupBy("project_id").agg(F.max("seq").alias("seq")).select(
        "project_id", F.lit("broken").alias("path"), "seq", F.lit("take_json_error").alias("error")
    )
    store.ingest(parsed.where("take_id = 0").unionByName(broken, allowMissingColumns=True), None, "r3", along)
    listed = store.table("errors").groupBy("project_id").agg(F.count(F.lit(1)).alias("listed_errors"))
    takes = store.table("takes").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(F.col("decision") == "selected").alias("selected"), F.round(F.sum("syllables_per_second"), 3).alias("rate_sum")
    )
    events = store.table("events").groupBy("project_id").agg(F.count(F.lit(1)).alias("events"))
    return takes.join(again, "project_id").join(events, "project_id").join(listed, "project_id").select(
        "project_id", "stored", "selected", "events", "rate_sum", "inserted", "unchanged", "errors", "listed_errors"
    )


def sink_exclusive(spark, d):
    """The analysis bundle written once and its long metrics read back."""
    r = results(spark, d)
    path = sinks.write_bundle(E.analyse(r), E.blind(r, "exp-1"), scratch_path(spark, "bundle"))
    return spark.read.schema("mode string, metric string, value double").csv(f"{path}/metrics")


FORMS = {"plain": [], "chunked": None, "listed": [(None,), (1,), (2,)]}


def ordered_scans_nulls(spark, d):
    """Row number, previous row and running total over null keys and null times, by each of the three plans."""
    rows = B.table(spark, d, "events").select(
        "event_id", F.nullif(F.col("user_id") % 20, F.lit(3)).alias("k"), F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("t"), F.round("value", 2).cast("decimal(18,2)").alias("v")
    )
    chunk, order = [F.date_trunc("day", F.col("t"))], ["t", "event_id"]
    out = None
    for form, hot in FORMS.items():
        one = number_rows(rows, ["k"], [F.col(c) for c in order], chunk, "n", hot)
        one = previous_row(one, ["k"], order, chunk, {"before": "event_id"}, hot)
        one = running_before(one, ["k"], [F.col(c) for c in order], chunk, {"total": ("sum", F.col("v"))}, hot)
        one = one.select(F.lit(form).alias("form"), "event_id", "k", "n", "before", F.col("total").cast("double").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "ordered_scans_nulls": (ordered_scans_nulls, """WITH r AS (SELECT event_id, nullif(user_id % 20, 3) AS k, CASE WHEN event_id % 11 <> 0 THEN ts END AS t, CAST(round(value, 2) AS DECIMAL(18,2)) AS v FROM events),
        w AS (SELECT event_id, k, row_number() OVER o AS n, lag(event_id) OVER o AS before, CAST(coalesce(sum(v) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS total
          FROM r WINDOW o AS (PARTITION BY k ORDER BY t NULLS FIRST, event_id))
        SELECT form, w.* FROM w, (SELECT unnest(['plain', 'chunked', 'listed']) AS form) f"""),
    "exception_rows": (exception_rows, B.with_sql(B.TAKES_SQL, CHECK_SQL, tail="SELECT project_id, block_id, phrase_id, take_id, status, round(score,6) AS score, reasons FROM checked")),
    "validator_plugin": (validator_plugin, B.with_sql(B.TAKES_SQL, CHECK_SQL, """
        v AS (SELECT 'mos' AS validator_name, status, score FROM checked UNION ALL SELECT 'audio_sanity', CASE WHEN NOT numeric_heavy THEN 'not_run' WHEN end_slope < -30 THEN 'fail' ELSE 'pass' END, CASE WHEN numeric_heavy THEN end_slope END FROM takes
        UNION ALL SELECT n, 'not_run', NULL FROM takes, (SELECT unnest(['content_asr','speaker_identity','existing_prosody_gate']) AS n) q)""",
        tail="SELECT validator_name, status, count(*) AS takes, round(sum(score),4) AS total FROM v GROUP BY ALL")),
    "is_question_shadow": (is_question_shadow, B.with_sql(HDOC, tail=f"SELECT doc_id, regexp_matches(text, '\\?{WS}*\\z') OR regexp_matches(text, '{QUIET}[.?!…]*{WS}*\\z') AS shadow, regexp_matches(text, '{QUIET}[. ]*\\z') AS production FROM hdocs")),
    "compact": (compact, f"SELECT doc_id, sha256(regexp_replace(text, '{WS}+', '', 'g')) AS h FROM documents"),
    "sigmoid": (sigmoid_q, "SELECT event_id, round(1e0/(1e0+exp(-(value-40e0)/7e0)),6) AS p, CASE WHEN value > 0 THEN round(1e0/(1e0+exp(least(value*1e3, 700e0))),6) ELSE 5e-1 END AS floor FROM events"),
    "utility": (utility, B.with_sql(*PAIRED, tail="SELECT project_id, sentence_class, round(avg(u),6) AS mean_utility, round(max(u),6) AS best FROM cand GROUP BY ALL")),
    "force_split": (force_split, PHRASES_SQL + "SELECT doc_id, phrase_idx, sha256(text) AS h, sentence_final FROM phrases WHERE forced"),
    "config_hash": (config_hash, CONFIG_SQL),
    "phrase_udtf": (phrase_udtf, PHRASES_SQL + "SELECT p.doc_id, lang, phrase_idx, sha256(p.text) AS h, sentence_final, forced FROM phrases p JOIN documents d ON d.doc_id = p.doc_id"),
    "align_udf": (align_udf, align_sql("SELECT a.conv_id, a.turn, string_split(a.text, ' ') AS e, string_split(b.text, ' ') AS a FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1",
        "conv_id, turn, distance, deletions, insertions, substitutions")),
    "scan_wav": (scan_wav, """SELECT 'v' || vec_id AS path, CASE WHEN label<>5 THEN 24000 END AS sample_rate_hz, CASE WHEN label<>5 THEN 1 END AS channels, CASE WHEN label<>5 THEN 2 END AS sample_width, CASE WHEN label<>5 THEN len(embedding) END AS n,
        CASE WHEN label<>5 THEN round(list_sum(list_transform(embedding, lambda x: round_even(CAST(x AS DOUBLE)*CASE WHEN x>=0 THEN 32767e0 ELSE 32768e0 END,0))),3) END AS total, CASE WHEN label=5 THEN 'truncated' END AS decode_error FROM embeddings"""),
    "bank_store": (bank_store, B.with_sql(*BANKED, """fresh AS (SELECT project_id, phrase_id, take_id, sha256, max(decision) AS decision, min_by(n_syl/dur, revision_seq) AS r1, count(*) AS deliveries FROM bank GROUP BY ALL),
        ev AS (SELECT project_id, count(*) AS events FROM fresh WHERE decision='selected' GROUP BY project_id)""",
        tail="""SELECT f.project_id, count(*) AS stored, count(*) FILTER (decision='selected') AS selected, max(e.events) AS events, round(sum(r1),3) AS rate_sum, 0 AS inserted, CAST(sum(deliveries) AS BIGINT) AS unchanged, 0 AS errors, 1 AS listed_errors
        FROM fresh f JOIN ev e ON e.project_id=f.project_id GROUP BY f.project_id""")),
    "sink_exclusive": (sink_exclusive, f"WITH z AS ({ANALYSIS_SQL}) " + "\nUNION ALL ".join(f"SELECT mode, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM z" for m in sinks.CSV_METRICS)),
}
