"""Pitch frames, sample sanity, loudness plans and speaker similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import to_int16
from ..operators import audio, gates, measure
from ..operators.ordered import exact_quantiles, number_rows
from . import bindings as B

HOP = 256 / 24000.0
CONFIG = audio.SanityConfig(
    expected_sample_rate_hz=100, maximum_leading_silence_seconds=0.02, maximum_trailing_silence_seconds=0.02,
    maximum_internal_silence_seconds=0.06, abrupt_end_window_seconds=0.05, abrupt_end_max_rms_dbfs=-30.0, maximum_tail_seconds=0.03,
)


def numbered(spark, d):
    """Events of a user in time order, as a dense series."""
    e = B.table(spark, d, "events")
    return number_rows(e, ["user_id"], [F.col("ts"), F.col("event_id")], [F.date_trunc("day", F.col("ts"))], "n", B.hot_users(spark, d))


NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def frames(spark, d):
    f = numbered(spark, d).select(
        "user_id", (F.col("n") * F.lit(HOP)).alias("t"), F.when(F.col("event_type") != "view", F.col("value") + 80.0).alias("f0")
    )
    return f, f.groupBy("user_id").agg((F.max("t") + F.lit(HOP)).alias("dur"))


def measured(spark, d):
    f, lengths = frames(spark, d)
    return measure.pitch(f, lengths, ["user_id"], B.hot_users(spark, d))


def rounded(df, *names):
    return df.select("user_id", *[F.round(n, 6).alias(n) for n in names])


H = "(256e0/24000e0)"
ST = "12e0*log2(f0/med)"
FRAMES_SQL = f"""
{NUMBERED},
frames AS (SELECT user_id, n*{H} AS t, CASE WHEN event_type <> 'view' THEN value + 80e0 END AS f0 FROM numbered),
lens AS (SELECT user_id, max(t)+{H} AS dur FROM frames GROUP BY ALL),
meds AS (SELECT user_id, median(f0) AS med, count(f0) AS nv, max(CASE WHEN f0 IS NOT NULL THEN t END) AS fin FROM frames GROUP BY ALL),
v AS (SELECT f.*, m.med, m.nv, m.fin, l.dur, {ST} AS st, row_number() OVER (PARTITION BY f.user_id ORDER BY t) AS ra, row_number() OVER (PARTITION BY f.user_id ORDER BY t DESC) AS rd
  FROM frames f JOIN meds m ON m.user_id=f.user_id JOIN lens l ON l.user_id=f.user_id WHERE f0 IS NOT NULL),
agg AS (SELECT user_id, max(dur) AS dur, max(med) AS med, max(nv) AS nv, quantile_cont(st, 9e-1) - quantile_cont(st, 1e-1) AS rng, median(f0) FILTER (ra<=5) AS first_hz, median(f0) FILTER (rd<=5) AS last_hz,
  count(*) FILTER (t > dur-55e-2) AS ns, regr_slope(st, t) FILTER (t > dur-55e-2) AS slope, count(*) FILTER (t > fin-25e-2) AS nt, count(*) FILTER (t > fin-6e-1 AND t <= fin-25e-2) AS np,
  median(f0) FILTER (t > fin-25e-2) AS tail, median(f0) FILTER (t > fin-6e-1 AND t <= fin-25e-2) AS prev, count(*) FILTER (t > fin-2e-1) AS nr, regr_slope(st, t) FILTER (t > fin-2e-1) AS glide,
  max_by(st, t) AS last_st, min(st) FILTER (t > fin-2e-1) AS low FROM v GROUP BY user_id),
m AS (SELECT l.user_id, l.dur AS d, a.*, l.dur >= 25e-2 AND coalesce(a.nv,0) >= 10 AS good FROM lens l LEFT JOIN agg a ON a.user_id=l.user_id)"""


def measure_pitch(spark, d):
    m = measured(spark, d)
    return m.select("user_id", "measurable", *[F.round(n, 6).alias(n) for n in ("dur", "median_hz", "range_st", "end_slope", "first_hz", "last_hz")])


def measure_tail(spark, d):
    return rounded(measured(spark, d), "tail_delta")


def measure_glide(spark, d):
    return rounded(measured(spark, d), "final_glide", "final_rebound")


def value_quantiles(spark, d):
    q = exact_quantiles(B.table(spark, d, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 5.0)
    return q.select("event_type", F.col("_count").alias("n"), *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


def samples(spark, d):
    """Events as samples at 100 Hz: quiet below 20, else scaled."""
    x = F.when(F.col("value") < 20, 0.0).otherwise((F.col("value") - 45.0) / 60.0)
    return numbered(spark, d).select(
        F.col("user_id").alias("path"), F.lit(100).alias("sample_rate_hz"), (F.col("n") - 1).alias("i"), x.alias("x")
    )


SAMPLES_SQL = f"""
{NUMBERED},
samples AS (SELECT user_id AS path, n-1 AS i, CASE WHEN value < 20 THEN 0e0 ELSE (value-45e0)/60e0 END AS x FROM numbered),
loud AS (SELECT path, i, i - lag(i) OVER (PARTITION BY path ORDER BY i) - 1 AS gap FROM samples WHERE abs(x) > 1e-3),
edges AS (SELECT path, min(i) AS f, max(i) AS l, max(gap) AS gap FROM loud GROUP BY ALL),
base AS (SELECT s.path, count(*) AS n, max(abs(x)) AS peak, sqrt(avg(x*x)) AS rms, avg((abs(x)>=999e-3)::INT) AS clip, avg(x) AS dc FROM samples s GROUP BY ALL),
fin AS (SELECT s.path, sqrt(avg(x*x)) AS er FROM samples s JOIN base b ON b.path=s.path WHERE i >= n-5 GROUP BY ALL),
st AS (SELECT b.*, er, coalesce(f,n)/1e2 AS lead_s, CASE WHEN l IS NULL THEN n ELSE n-1-l END/1e2 AS trail_s, coalesce(gap,0)/1e2 AS int_s, 20e0*log10(greatest(er,1e-12)) AS end_db
  FROM base b JOIN fin ON fin.path=b.path LEFT JOIN edges e ON e.path=b.path)"""


def audio_stats(spark, d):
    s = audio.stats(samples(spark, d), CONFIG, hot=B.hot_users(spark, d, "path"))
    return s.select(
        "path", "sample_count", "zero_waveform",
        *[F.round(c, 6).alias(c) for c in ("duration_seconds", "peak", "peak_dbfs", "rms", "rms_dbfs", "crest_factor_db", "clipping_ratio", "dc_offset", "end_window_rms_dbfs")],
    )


def edge_silence(spark, d):
    s = audio.stats(samples(spark, d), CONFIG, hot=B.hot_users(spark, d, "path"))
    return s.select("path", "leading_silence_seconds", "trailing_silence_seconds")


def internal_silence_run(spark, d):
    return audio.stats(samples(spark, d), CONFIG, hot=B.hot_users(spark, d, "path")).select("path", "longest_internal_silence_seconds")


def audio_gate(spark, d):
    g = audio.gate(audio.stats(samples(spark, d), CONFIG, hot=B.hot_users(spark, d, "path")), CONFIG)
    return g.select("path", "status", F.array_join("reasons", ",").alias("reasons"))


def embeddings(spark, d):
    return B.table(spark, d, "embeddings")


def similarities(spark, d):
    e = embeddings(spark, d)
    return audio.similarity(e, e.where("vec_id = 0"))


def cosine(spark, d):
    return similarities(spark, d).select("vec_id", F.round("similarity", 6).alias("similarity"))


def group():
    label = F.col("label")
    named = F.when(label < 2, "candidate").when(label == 2, "approved").when(label == 9, "rejected")
    return named.when(label == 3, audio.EXTRA_GROUP)


SIM_SQL = """
sims AS (SELECT e.vec_id, e.label, list_sum(list_transform(list_zip(e.embedding, r.embedding), lambda p: CAST(p[1] AS DOUBLE)*CAST(p[2] AS DOUBLE)))
   / sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)*x)) * list_sum(list_transform(r.embedding, lambda x: CAST(x AS DOUBLE)*x))) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) r),
g AS (SELECT *, CASE WHEN label<2 THEN 'candidate' WHEN label=2 THEN 'approved' WHEN label=9 THEN 'rejected' END AS grp FROM sims),
cal AS (SELECT count(*) AS n, (min(s) FILTER (grp IN ('candidate','approved')) + max(s) FILTER (grp='rejected'))/2 AS th, count(*) FILTER (grp='candidate') AS n_candidate, count(*) FILTER (grp='approved') AS n_approved,
   count(*) FILTER (grp='rejected') AS n_rejected, min(s) FILTER (grp='rejected') AS mn, max(s) FILTER (grp='candidate') AS mx FROM g)"""


def calibration(spark, d):
    return audio.calibrate(similarities(spark, d).withColumn("group", group()), score="similarity")


def speaker_calibrate(spark, d):
    c = calibration(spark, d)
    return c.select(
        "status", "sample_count", F.round("threshold", 6).alias("threshold"), "false_accepts", "false_rejects", "n_candidate", "n_approved", "n_rejected",
        F.round("min_rejected", 6).alias("min_rejected"), F.round("max_candidate", 6).alias("max_candidate"),
    )


def speaker_gate(spark, d):
    g = audio.speaker_gate(similarities(spark, d), calibration(spark, d))
    return g.select("vec_id", "status", "hard_gate", "reason")


def speaker_reference_join(spark, d):
    """Without a calibration nothing passes or fails."""
    none = spark.range(1).select(F.lit("insufficient_data").alias("status"), F.lit(None).cast("double").alias("threshold"))
    g = audio.speaker_gate(similarities(spark, d), none)
    return g.groupBy("label").agg(F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if("hard_gate").alias("hard"), F.round(F.max("similarity"), 6).alias("best"))


def segment_levels(spark, d):
    p = audio.level_plan(embeddings(spark, d), ["label"], 1000, "embedding")
    return p.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("rms", "gain", "peak", "track_peak", "guard", "peak_after")])


def pcm_clamp(spark, d):
    e = embeddings(spark, d).select("vec_id", to_int16(F.transform("embedding", lambda x: x.cast("double") * 4.0)).alias("pcm"))
    total = F.aggregate("pcm", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.select("vec_id", total.alias("total"), F.array_max("pcm").alias("top"), F.array_min("pcm").alias("low"))


def rtf(spark, d):
    """Orders as syntheses: price as seconds, clock readings from order and ship dates."""
    o = B.table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 3141.59265 - 5).alias("generation_seconds"), (F.col("o_orderkey") % 50).cast("double").alias("audio_seconds"),
        (F.col("o_custkey") % 7).cast("double").alias("started"), (F.col("o_orderkey") % 11).cast("double").alias("finished"), F.lit(5.0).alias("pcm_ready"),
    )
    r = gates.timing_errors(o)
    return r.select("o_orderkey", F.round("rtf", 6).alias("rtf"), F.array_join("errors", ",").alias("errors"))


F6 = lambda e, n: f"round(CASE WHEN good THEN {e} END, 6) AS {n}"
QUERIES = {
    "measure_pitch": (measure_pitch, B.with_sql(FRAMES_SQL, tail="SELECT user_id, good AS measurable, round(d,6) AS dur, " + ", ".join([F6("med", "median_hz"), F6("rng", "range_st"),
        F6("CASE WHEN ns>=5 THEN coalesce(slope,0e0) ELSE 0e0 END", "end_slope"), F6("first_hz", "first_hz"), F6("last_hz", "last_hz")]) + " FROM m")),
    "measure_tail": (measure_tail, B.with_sql(FRAMES_SQL, tail="SELECT user_id, " + F6("CASE WHEN nt>=3 AND np>=3 THEN 12e0*log2(tail/prev) END", "tail_delta") + " FROM m")),
    "measure_glide": (measure_glide, B.with_sql(FRAMES_SQL, tail="SELECT user_id, " + F6("CASE WHEN nr>=4 THEN coalesce(glide,0e0) END", "final_glide") + ", " + F6("CASE WHEN nr>=4 THEN last_st-low END", "final_rebound") + " FROM m")),
    "value_quantiles": (value_quantiles, "SELECT event_type, count(value) AS n, round(quantile_cont(value,1e-1),6) AS p10, round(quantile_cont(value,5e-1),6) AS p50, round(quantile_cont(value,9e-1),6) AS p90 FROM events GROUP BY event_type"),
    "audio_stats": (audio_stats, B.with_sql(SAMPLES_SQL, tail="""SELECT path, n AS sample_count, peak=0e0 AS zero_waveform, round(n/1e2,6) AS duration_seconds, round(peak,6) AS peak, round(20e0*log10(greatest(peak,1e-12)),6) AS peak_dbfs, round(rms,6) AS rms,
        round(20e0*log10(greatest(rms,1e-12)),6) AS rms_dbfs, round(CASE WHEN rms>0 THEN 20e0*log10(greatest(peak/rms,1e-12)) ELSE CAST('inf' AS DOUBLE) END,6) AS crest_factor_db, round(clip,6) AS clipping_ratio, round(dc,6) AS dc_offset, round(end_db,6) AS end_window_rms_dbfs FROM st""")),
    "edge_silence": (edge_silence, B.with_sql(SAMPLES_SQL, tail="SELECT path, lead_s AS leading_silence_seconds, trail_s AS trailing_silence_seconds FROM st")),
    "internal_silence_run": (internal_silence_run, B.with_sql(SAMPLES_SQL, tail="SELECT path, int_s AS longest_internal_silence_seconds FROM st")),
    "audio_gate": (audio_gate, B.with_sql(SAMPLES_SQL, tail="""SELECT path, CASE WHEN why='' THEN 'pass' ELSE 'fail' END AS status, why AS reasons FROM (SELECT *, rtrim(concat(CASE WHEN n/1e2<1e-1 THEN 'file_too_short,' ELSE '' END,
        CASE WHEN peak=0 THEN 'zero_waveform,' ELSE '' END, CASE WHEN peak>89e-2 THEN 'peak_guard_exceeded,' ELSE '' END, CASE WHEN clip>1e-3 THEN 'clipping_ratio_exceeded,' ELSE '' END, CASE WHEN abs(dc)>2e-2 THEN 'dc_offset_exceeded,' ELSE '' END,
        CASE WHEN lead_s>2e-2 THEN 'leading_silence_too_long,' ELSE '' END, CASE WHEN trail_s>2e-2 THEN 'trailing_silence_too_long,' ELSE '' END, CASE WHEN int_s>6e-2 THEN 'internal_silence_too_long,' ELSE '' END,
        CASE WHEN trail_s>3e-2 THEN 'tail_too_long,' ELSE '' END, CASE WHEN end_db>-30e0 THEN 'abrupt_end,' ELSE '' END), ',') AS why FROM st) q""")),
    "cosine": (cosine, B.with_sql(SIM_SQL, tail="SELECT vec_id, round(s,6) AS similarity FROM sims")),
    "speaker_calibrate": (speaker_calibrate, B.with_sql(SIM_SQL, tail="""SELECT CASE WHEN n_candidate>0 AND n_approved>0 AND n_rejected>0 THEN 'calibrated_candidate' ELSE 'insufficient_data' END AS status, n AS sample_count, round(th,6) AS threshold,
        (SELECT count(*) FILTER (grp='rejected' AND s>=th) FROM g, cal) AS false_accepts, (SELECT count(*) FILTER (grp IN ('candidate','approved') AND s<th) FROM g, cal) AS false_rejects,
        n_candidate, n_approved, n_rejected, round(mn,6) AS min_rejected, round(mx,6) AS max_candidate FROM cal""")),
    "speaker_gate": (speaker_gate, B.with_sql(SIM_SQL, tail="SELECT vec_id, CASE WHEN s>=th THEN 'pass' ELSE 'fail' END AS status, true AS hard_gate, CASE WHEN s<th THEN 'primary_similarity_below_calibrated_threshold' END AS reason FROM sims, cal")),
    "speaker_reference_join": (speaker_reference_join, B.with_sql(SIM_SQL, tail="SELECT label, count(*) AS unknown, 0 AS hard, round(max(s),6) AS best FROM sims GROUP BY label")),
    "segment_levels": (segment_levels, """WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN i-1<12 THEN (i-1)/11e0 ELSE 1e0 END * CASE WHEN len(embedding)-i<12 THEN (len(embedding)-i)/11e0 ELSE 1e0 END) AS s FROM embeddings),
        g AS (SELECT *, sqrt(list_sum(list_transform(s, lambda x: x*x))/len(s)) AS rms FROM f), h AS (SELECT *, 1e-1/greatest(rms,1e-9) AS gain, list_max(list_transform(s, lambda x: abs(x)))*1e-1/greatest(rms,1e-9) AS peak FROM g),
        t AS (SELECT *, max(peak) OVER (PARTITION BY label) AS tp FROM h) SELECT vec_id, label, round(rms,6) AS rms, round(gain,6) AS gain, round(peak,6) AS peak, round(tp,6) AS track_peak,
        round(CASE WHEN tp>89e-2 THEN 89e-2/tp ELSE 1e0 END,6) AS guard, round(peak*CASE WHEN tp>89e-2 THEN 89e-2/tp ELSE 1e0 END,6) AS peak_after FROM t"""),
    "pcm_clamp": (pcm_clamp, """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, round_even(CAST(x AS DOUBLE)*4e0*CASE WHEN x>=0 THEN 32767e0 ELSE 32768e0 END, 0))) AS INT)) AS pcm FROM embeddings)
        SELECT vec_id, CAST(list_sum(pcm) AS BIGINT) AS total, list_max(pcm) AS top, list_min(pcm) AS low FROM p"""),
    "rtf": (rtf, """WITH o AS (SELECT o_orderkey, o_totalprice/314159265e-5-5e0 AS g, CAST(o_orderkey % 50 AS DOUBLE) AS a, o_custkey % 7 AS st, o_orderkey % 11 AS fi FROM orders)
        SELECT o_orderkey, CASE WHEN a<>0 THEN round(g/a,6) END AS rtf, rtrim(concat(CASE WHEN fi<st THEN 'finish_precedes_start,' ELSE '' END, CASE WHEN 5<fi THEN 'pcm_precedes_finish,' ELSE '' END, CASE WHEN a<=0 THEN 'audio_duration_not_positive,' ELSE '' END,
        CASE WHEN g<0 THEN 'generation_negative,' ELSE '' END, CASE WHEN a<>0 AND g/a<0 THEN 'rtf_negative,' ELSE '' END), ',') AS errors FROM o"""),
}
