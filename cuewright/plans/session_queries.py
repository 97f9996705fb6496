"""Live sessions over the events table, as batch jobs and as streams; files and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment as E, sessions as S
from ..operators.digest import digest_sql
from ..session import cut_lineage, scratch_path
from ..sources import manifest as M, readers, sinks
from ..streaming import jobs, processors
from . import bindings as B
from .bank_queries import DELIVERIES_SQL
from .experiment_queries import ANALYSIS_SQL, results
from .take_queries import SCORED, scored


def shape(e):
    """Event rows as session events of every kind used below."""
    ts = F.col("ts").cast("timestamp")
    t = F.unix_micros(ts) / 1e6
    kind = (
        F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "issue").when(F.col("event_type") == "signup", "pause").otherwise("continue")
    )
    return e.select(
        F.col("user_id").alias("session_id"), ts.alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(F.col("event_type") == "signup", "invalidate").otherwise("synth").alias("role"),
        F.date_format("ts", "MMdd").alias("generation_id"), t.alias("start"), (t + F.col("value") * 40).alias("finish"),
        F.col("value").alias("rtf"), (F.col("event_type") == "purchase").alias("sentence_final"), F.col("value").alias("seconds"),
    )


def events(spark, d):
    return shape(B.table(spark, d, "events"))


def hot(spark, d):
    return B.hot_users(spark, d, "session_id")


#: How far behind the newest row a streamed row may arrive.
LATENESS = "2 days"
PARTS = 4


def arrivals(spark, d):
    """The events in four parts as they arrive: most at once, some half a day late, some five days."""
    e = B.table(spark, d, "events")
    at, last = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id") % 10
    low, high = e.agg(F.min(at), F.max(at)).first()
    delay = F.when(last == 0, 5 * 86_400_000_000).when(last < 3, 43_200_000_000).otherwise(0)
    part = F.least(F.lit(PARTS - 1), F.floor((at + delay - low) / F.lit((high - low) // PARTS + 1)))
    return [shape(e.where(part == i)) for i in range(PARTS)]


def streamed(spark, d, processor, of=lambda e: e):
    """What a processor makes of the events in time, up to the watermark."""
    return jobs.behind_watermark(arrivals(spark, d), LATENESS, lambda e: jobs.keyed(of(e), processor, LATENESS))[0]


def synth(df):
    return df.withColumn("kind", F.col("role"))


EV = """
ev AS (SELECT user_id AS session_id, ts, event_id AS seq, event_type, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'issue' WHEN 'signup' THEN 'pause' ELSE 'continue' END AS kind,
  strftime(ts, '%m%d') AS generation_id, epoch_us(ts)/1e6 AS start, epoch_us(ts)/1e6 + value*40e0 AS finish, value AS rtf FROM events)"""
STALE_SQL = B.with_sql(EV, """
tracked AS (SELECT *, last_value(CASE WHEN event_type='signup' THEN generation_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS moved,
  first_value(CASE WHEN event_type<>'signup' THEN generation_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening FROM ev)""",
    tail="SELECT session_id, seq, generation_id, coalesce(moved, opening) AS current_generation, generation_id <> coalesce(moved, opening) AS stale FROM tracked WHERE event_type <> 'signup'")
PLAY = """
play AS (SELECT *, row_number() OVER w AS n, greatest(0e0, start - lag(finish) OVER w) AS g0, lag(finish) OVER w AS pf, avg(rtf) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS roll
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
played AS (SELECT *, CASE WHEN pf IS NOT NULL THEN g0 END AS gap, coalesce(pf IS NOT NULL AND g0 > 2e-2, false) AS underrun FROM play)"""
SENT_SQL = B.with_sql(EV, """
sn AS (SELECT *, coalesce(sum((event_type='purchase')::INT) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ev)""",
    tail="""SELECT session_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS frames, round(sum(rtf),6) AS seconds, max(seq) AS last_seq FROM sn GROUP BY session_id, sentence HAVING bool_or(event_type='purchase')""")
STATE = """
fl AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('pause','continue') THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'continue') AS flag FROM ev),
live AS (SELECT *, lead(kind) OVER (PARTITION BY session_id ORDER BY ts, seq) AS nxt FROM fl WHERE kind='issue' OR (kind IN ('start','complete') AND flag='continue')),
started AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS item_index FROM live WHERE kind='start'),
items AS (SELECT session_id, unnest(range(1, n+1)) AS item_index FROM (SELECT session_id, count(DISTINCT strftime(ts, '%m%d')) AS n FROM ev GROUP BY ALL) q),
states AS (SELECT i.session_id, i.item_index, CASE WHEN s.seq IS NULL THEN 'PENDING' WHEN nxt='complete' THEN 'PASS' WHEN nxt='issue' THEN 'ISSUE' WHEN nxt IS NULL THEN 'RECOVERED' ELSE 'PLAYING' END AS state
  FROM items i LEFT JOIN started s ON s.session_id=i.session_id AND s.item_index=i.item_index)"""


def stale_discard(spark, d):
    r = S.discard_stale(synth(events(spark, d)), hot(spark, d))
    return r.select("session_id", "seq", "generation_id", "current_generation", "stale")


def playback_metrics(spark, d):
    p = S.playback(events(spark, d), hot(spark, d))
    return p.select("session_id", "seq", F.round("gap", 5).alias("gap"), "underrun", F.round("rolling_rtf", 6).alias("rolling_rtf"))


def session_snapshot(spark, d):
    e = events(spark, d)
    submitted = e.groupBy("session_id").agg((F.min("start") - 1.5).alias("submitted"))
    s = S.session_snapshot(S.playback(e, hot(spark, d)), submitted)
    return s.select(
        "session_id", "phrases", F.round("ttfa_seconds", 3).alias("ttfa_seconds"), "underrun_count", F.round("average_rtf", 6).alias("average_rtf"),
        F.round("recent_gap", 4).alias("recent_gap"),
    )


def recent_phrases(spark, d):
    return S.recent_phrases(S.playback(events(spark, d), hot(spark, d))).select("session_id", "seq", F.col("recency").cast("bigint").alias("recency"))


def sentence_buffer(spark, d):
    s = S.sentence_buffer(events(spark, d), hot(spark, d))
    return s.select("session_id", "sentence", "frames", F.round("seconds", 6).alias("seconds"), "last_seq")


def items(spark, d):
    e = events(spark, d).groupBy("session_id").agg(F.count_distinct("generation_id").alias("n"))
    return e.select("session_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("item_index"))


def batch_state_machine(spark, d):
    return S.batch_states(events(spark, d), items(spark, d), recover=True, hot=hot(spark, d)).select("session_id", "item_index", "state")


def batch_counts(spark, d):
    return S.batch_counts(S.batch_states(events(spark, d), items(spark, d), hot=hot(spark, d)))


TAGS = ("cue/1", "cue/2")


def stored_sessions(spark, d):
    """Conversations as stored sessions; a role stands for the state, the turn count for the schema."""
    c = B.table(spark, d, "conversations")
    state = F.when(F.col("turn") == 1, "PLAYING").when(F.col("role") == "user", "PASS").otherwise("PENDING")
    item = F.struct("turn", F.concat(F.lit("S"), "turn").alias("item_id"), "text", state.alias("state"))
    # a stored session is one document with all of its items, so it is one row here too
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n"))
    return docs.select(
        F.col("conv_id").alias("session_id"), F.col("n").alias("modified"),
        F.when(F.col("n") % 4 == 0, "cue/9").when(F.col("n") % 4 == 1, "cue/1").otherwise("cue/2").alias("schema_version"),
        F.when(F.col("n") > 6, 99).otherwise(1).alias("active_index"),
        F.transform("items", lambda i: F.struct(i["item_id"], i["text"], i["state"])).alias("items"),
    )


STORED = """
cn AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL)"""


def session_load(spark, d):
    return S.load_sessions(stored_sessions(spark, d), TAGS).select("session_id", "pos", "item_id", "state")


def recent_session(spark, d):
    s = stored_sessions(spark, d).withColumn("owner", F.col("active_index"))
    return S.latest_session(s, "owner", TAGS).select("owner", "session_id", "modified", "schema_version")


def plain_times(k):
    """Window bounds as wall-clock times, which read the same in any session time zone."""
    bounds = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    return k.select(*bounds, "kind", "n", F.round("rtf_sum", 6).alias("rtf_sum"), "rtf_max")


def windowed_kpis(spark, d):
    k = S.kpis(events(spark, d), "1 day", "12 hours")
    return plain_times(k)


# ---- the same as streams ------------------------------------------------------------------------


def stream_stale_discard(spark, d):
    return streamed(spark, d, processors.StaleFilter, synth)


def stream_playback(spark, d):
    p = streamed(spark, d, processors.Playback)
    return p.select("session_id", "seq", F.round("gap", 5).alias("gap"), "underrun", F.round("rolling_rtf", 6).alias("rolling_rtf"))


def stream_sentence_buffer(spark, d):
    s = streamed(spark, d, processors.SentenceBuffer)
    return s.select("session_id", "sentence", "frames", F.round("seconds", 6).alias("seconds"), "last_seq")


def item_count(spark, d):
    e = events(spark, d).groupBy("session_id").agg(F.count_distinct("generation_id").alias("n"))
    return e.select("session_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("item_index"))


def told_items(spark, d):
    """Items with a text that others share, some to be tested again, some passed before."""
    i = F.col("item_index")
    state = F.when(i % 7 == 3, "RETEST_PENDING").when(i % 9 == 2, "PASS").otherwise("PENDING")
    return item_count(spark, d).select("session_id", "item_index", F.concat(F.lit("T"), i % 4).alias("text"), state.alias("state"))


def resuming(e):
    """Some neutral events ask for a sentence again; no item has the text T4."""
    asks = (F.col("kind") == "continue") & (F.col("seq") % 6 == 0) & (F.col("session_id") % 3 > 0)
    return e.withColumns({"kind": F.when(asks, "resume").otherwise(F.col("kind")), "text": F.when(asks, F.concat(F.lit("T"), F.col("seq") % 5))})


def batch_resume(spark, d):
    """States of items in sessions two thirds of which go back to earlier sentences."""
    return S.batch_states(resuming(events(spark, d)), told_items(spark, d), recover=True, hot=hot(spark, d)).select("session_id", "item_index", "state")


def stream_batch_states(spark, d):
    """The same from a stream: state of every item by the last change up to the watermark."""
    ranked = S.ranked_items(told_items(spark, d), hot(spark, d)).transform(cut_lineage)
    changes = streamed(spark, d, processors.BatchMachine, lambda e: S.with_targets(resuming(e), ranked))
    return S.last_changes(changes, ranked, recover=False).select("session_id", "item_index", "state")


def stream_ingest(spark, d):
    """Deliveries in three parts; two of them bring many revisions again."""
    raw = B.table(spark, d, "documents").select(
        F.col("source").alias("project_id"), F.concat_ws("/", "lang", F.floor(F.col("n_chars") / 50).cast("string")).alias("path"),
        F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"),
    )
    again = raw.withColumn("seq", F.col("seq") + 1_000_000_000)
    parts = [raw.where("seq % 3 = 0"), raw.where("seq % 3 = 1").unionByName(again.where("seq % 2 = 0")), raw.where("seq % 3 = 2").unionByName(again)]
    base = scratch_path(spark, "ingest")
    jobs.deliver(parts, f"{base}/inbox", [lambda: jobs.ingest(jobs.folder_stream(spark, f"{base}/inbox", raw.schema), f"{base}/store", f"{base}/state")])
    return spark.read.parquet(f"{base}/store").select("project_id", "path", "sha256", "seq")


def stream_kpis(spark, d):
    """Closed days, each emitted once."""
    return plain_times(jobs.behind_watermark(arrivals(spark, d), LATENESS, lambda e: jobs.windowed_kpis(e, "1 day", None, LATENESS))[0])


def stream_sliding_kpis(spark, d):
    return plain_times(jobs.behind_watermark(arrivals(spark, d), LATENESS, lambda e: jobs.windowed_kpis(e, "1 day", "12 hours", LATENESS))[0])


def plain_activity(k):
    bounds = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")]
    return k.select("session_id", *bounds, "n", F.round("rtf_sum", 6).alias("rtf_sum"), "rtf_max", "sentences")


GAP = "6 hours"


def session_windows(spark, d):
    return plain_activity(S.activity(events(spark, d), GAP))


def stream_session_windows(spark, d):
    """Closed stretches of activity."""
    return plain_activity(jobs.behind_watermark(arrivals(spark, d), LATENESS, lambda e: jobs.session_kpis(e, GAP, LATENESS))[0])


def stream_late_rows(spark, d):
    """The side table: rows too late for the windows, by the part they came in."""
    late = jobs.behind_watermark(arrivals(spark, d), LATENESS, lambda e: jobs.windowed_kpis(e, "1 day", None, LATENESS))[1]
    return late.groupBy("session_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.sum("seq").alias("seq_sum"))


# ---- files and manifests ------------------------------------------------------------------------


def take_files(spark, d):
    """Takes as the JSON files they would be stored in, some of them damaged."""
    s = scored(spark, d)
    doc = F.to_json(
        F.struct(
            F.col("take_id").alias("take"), "ok", F.col("why"), "n_syl", F.col("numeric_heavy").alias("numeric"),
            F.struct("range_st", "end_slope", "tail_delta").alias("metrics"),
        )
    )
    content = F.when(F.col("question") & F.col("forced"), F.concat(F.lit("{oops "), doc)).when(
        F.col("question") & F.col("sentence_final"), F.lit("[1, 2]")
    ).otherwise(doc)
    name = F.concat(F.lit("/data/"), "project_id", F.lit("/"), "block_id", F.lit("/P"), F.lpad(F.col("phrase_id").cast("string"), 7, "0"), F.lit("_t"), "take_id", F.lit(".json"))
    return s.select(name.alias("path"), content.alias("content"))


def scan_takes(spark, d):
    good, _ = readers.parse_takes(take_files(spark, d))
    return good.select(
        "block_id", F.col("phrase_idx").cast("bigint").alias("phrase_id"), "take_id", "ok", F.array_join("why", ",").alias("why"), "n_syl", "numeric_heavy",
        F.round("range_st", 6).alias("range_st"), "end_slope", F.round("tail_delta", 6).alias("tail_delta"), F.col("dur").alias("absent"),
    )


def discover_takes(spark, d):
    """Error rows of the recursive, case-insensitive scan."""
    _, bad = readers.parse_takes(take_files(spark, d).withColumn("path", F.replace("path", F.lit("/P"), F.lit("/p"))), ignore_case=True)
    return bad


def scan_jobs(spark, d):
    """Job documents of one block per sentence, written by Spark and parsed back."""
    docs = B.table(spark, d, "documents")
    lines = F.split("text", "\n")
    blocks = F.transform(lines, lambda t, i: F.struct(F.concat(F.lit("B"), i + 1).alias("id"), t.alias("text"), (F.col("doc_id") + i).alias("seed")))
    raw = docs.select(F.col("doc_id").cast("string").alias("path"), F.to_json(F.struct(blocks.alias("blocks"))).alias("content"))
    return readers.parse_jobs(raw).select("path", "block_pos", "block_id", F.sha2("text", 256).alias("h"), "seed")


def scan_phrases(spark, d):
    docs = B.table(spark, d, "documents")
    item = lambda t: F.when(F.length(t) < 15, F.to_json(F.array(t))).otherwise(
        F.to_json(F.struct(t.alias("text"), F.when(F.length(t) > 40, t.contains(",")).alias("sentence_final")))
    )
    content = F.concat(F.lit("["), F.array_join(F.transform(F.split("text", "\n"), item), ","), F.lit("]"))
    raw = docs.select(F.concat(F.lit("/x/"), "doc_id", F.lit("/phrases.json")).alias("path"), content.alias("content"))
    r = readers.parse_phrases(raw)
    return r.select("block_id", "phrase_idx", F.sha2("text", 256).alias("h"), "sentence_final", "forced")


def scan_pins(spark, d):
    o = B.table(spark, d, "orders")
    content = F.concat(F.lit('{"'), F.format_string("P%02d", "o_orderkey"), F.lit('": '), F.col("o_custkey") % 5, F.lit(', "note": 7, "P1x": 3}'))
    raw = o.select(F.concat(F.lit("/x/B"), "o_custkey", F.lit("_pins.json")).alias("path"), content.alias("content"))
    return readers.parse_pins(raw)


def scan_reports(spark, d):
    e = B.table(spark, d, "embeddings")
    # the product stays a float as in SQL; next to an integer literal Spark would widen it to a double
    picks = F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(20).cast("float")).cast("int"))
    content = F.to_json(F.struct(F.concat(F.lit("B"), "vec_id").alias("id"), picks.alias("picks")))
    raw = e.select(F.concat(F.lit("/x/B"), "vec_id", F.lit("_report.json")).alias("path"), content.alias("content"))
    return readers.parse_reports(raw)


def page_files(spark, d):
    return B.table(spark, d, "pages").withColumn("path", F.concat_ws("#", "url", "page_id"))


def file_manifest(spark, d):
    m = M.manifest(page_files(spark, d), "path", "html").withColumn("site", F.regexp_extract("path", "//([^/]*)/", 1))
    return M.fingerprint(m, ["site"])


def later_pages(spark, d):
    p = page_files(spark, d).where(~F.col("url").contains("/fr/")).withColumn(
        "html", F.when(F.col("url").contains("?"), F.concat("html", F.lit("<!-- x -->"))).otherwise(F.col("html"))
    )
    extra = page_files(spark, d).where(F.col("url").contains("/en/")).withColumn("path", F.concat("path", F.lit("-copy")))
    return p.unionByName(extra)


def manifest_diff(spark, d):
    a, b = (M.manifest(x(spark, d), "path", "html") for x in (page_files, later_pages))
    return M.diff(a, b)


def read_only_check(spark, d):
    a, b = (M.manifest(x(spark, d), "path", "html") for x in (page_files, later_pages))
    return M.read_only_verified(a, b)


def manifest_verify(spark, d):
    p = page_files(spark, d).withColumn("h", F.sha2("html", 256))
    k, n = F.col("page_id"), F.length("html")
    expected = p.select(F.col("path").alias("name"), F.col("h").alias("source_sha256"))
    recorded = p.where(k % 7 != 0).select(
        F.col("path").alias("name"), F.when(n % 5 == 0, "old").otherwise(F.col("h")).alias("source_sha256"), F.col("h").alias("artifact_sha256"), (n % 3 != 0).alias("valid")
    )
    actual = p.where(n % 4 != 0).select(F.col("path").alias("name"), F.when(k % 2 == 0, F.lit("bad")).otherwise(F.col("h")).alias("artifact_sha256"))
    return M.verify(expected, recorded, actual)


def sink_json_safe(spark, d):
    """Non-finite numbers at every depth, written as JSON and read back."""
    e = B.table(spark, d, "events")
    odd = F.when(F.col("value") < 20, F.lit(float("nan"))).when(F.col("value") > 60, F.lit(float("inf"))).otherwise(F.col("value"))
    df = e.select("event_id", odd.alias("v"), F.array(odd, F.lit(1.0)).alias("a"), F.struct(odd.alias("x")).alias("s"))
    path = scratch_path(spark, "report")
    sinks.write_report(df, path, forbid_inside=d)
    back = spark.read.schema("event_id bigint, v double, a array<double>, s struct<x:double>").json(path)
    return back.select("event_id", "v", F.get("a", 0).alias("a0"), F.col("s.x").alias("x"))


def sink_guard(spark, d):
    """A report may be written beside the input folder, never inside it."""
    lines = B.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    outside = sinks.write_report(lines, scratch_path(spark, "guarded"), forbid_inside=d)
    try:
        inside = sinks.write_report(lines, f"{d.rstrip('/')}/x/../report", forbid_inside=d)
    except ValueError:
        inside = "refused"
    return spark.read.schema("l_returnflag string, n bigint").json(outside).withColumn("inside", F.lit(inside))


def sink_csv_long(spark, d):
    return sinks.long_metrics(E.analyse(results(spark, d)))


def sink_markdown(spark, d):
    return sinks.markdown_rows(E.analyse(results(spark, d)))


def deterministic_order(spark, d):
    """Identity order at the sink: the row number that a sorted output would have."""
    from ..operators.ordered import number_in_order

    s = B.takes(spark, d)
    at = ["project_id", "block_id", "phrase_id", "take_id"]
    return number_in_order(s.select(*at), at, "output_line").select(*at, "output_line")


# What the streams see: parts by arrival, rows behind the horizon left out, results up to the last watermark (milliseconds).
ARRIVED = f"""
span AS (SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts))) // {PARTS} + 1 AS width FROM events),
arrived AS (SELECT e.*, least({PARTS - 1}, (epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN 5 * 86400000000 WHEN event_id % 10 < 3 THEN 43200000000 ELSE 0 END - low) // width) AS part FROM events e, span),
newest AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL '{LATENESS}' AS horizon FROM arrived GROUP BY part),
timed AS (SELECT a.*, coalesce(a.ts < n.horizon, false) AS late FROM arrived a JOIN newest n ON n.part = a.part),
seen AS (SELECT * FROM timed WHERE NOT late),
mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '{LATENESS}' AS mark FROM seen)"""
SEEN = EV.replace("FROM events", "FROM seen")
DUE = "date_trunc('milliseconds', ts) <= (SELECT mark FROM mark)"


def of_seen(*parts, tail):
    """The batch twin over the rows that a stream sees."""
    return B.with_sql(ARRIVED, SEEN, *parts, tail=tail)


ACTIVE = """
gaps AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL '6 hours', true)::INT AS opens FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
stretches AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, seq) AS stretch FROM gaps),
active AS (SELECT session_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL '6 hours' AS "end", count(*) AS n, round(sum(rtf),6) AS rtf_sum, max(rtf) AS rtf_max,
  count(*) FILTER (event_type='purchase') AS sentences FROM stretches GROUP BY session_id, stretch)"""
WINDOWS = """w AS (SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '12 hours']) AS st FROM ev)"""
STALE_ROWS = STALE_SQL[STALE_SQL.index("tracked AS"):STALE_SQL.rindex("SELECT session_id, seq")]
SENT_ROWS = SENT_SQL[SENT_SQL.index("sn AS"):SENT_SQL.rindex("SELECT session_id, CAST(sentence")]
CLOSED = 'WHERE "end" <= (SELECT mark FROM mark)'


def walk_sql(rows, last):
    """Sessions walked event by event with a list of states; ``last`` is what an item's state becomes at the end."""
    return f"""
told AS (SELECT session_id, list(CASE WHEN i % 7 = 3 THEN 'RETEST_PENDING' WHEN i % 9 = 2 THEN 'PASS' ELSE 'PENDING' END ORDER BY i) AS states, list('T' || (i % 4) ORDER BY i) AS texts
  FROM (SELECT user_id AS session_id, unnest(range(1, n+1)) AS i FROM (SELECT user_id, count(DISTINCT strftime(ts, '%m%d')) AS n FROM events GROUP BY ALL) q) q2 GROUP BY session_id),
asked AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn, CASE WHEN kind='continue' AND seq % 6 = 0 AND session_id % 3 > 0 THEN 'resume' ELSE kind END AS kind, 'T' || (seq % 5) AS text FROM {rows}),
steps AS (SELECT session_id, 0 AS rn, states, texts, 0 AS active, false AS paused FROM told
  UNION ALL SELECT session_id, rn + 1, list_transform(states, lambda s, i: CASE WHEN i = k AND kind = 'start' THEN 'PLAYING' WHEN i = t AND kind = 'resume' THEN 'PENDING'
      WHEN i = active AND kind = 'issue' THEN 'ISSUE' WHEN i = active AND kind = 'complete' AND NOT paused THEN 'PASS' ELSE s END), texts,
    CASE WHEN kind = 'start' AND NOT paused THEN k WHEN kind = 'issue' OR kind = 'complete' AND NOT paused OR kind = 'resume' AND t > 0 THEN 0 ELSE active END,
    CASE WHEN kind = 'pause' THEN true WHEN kind = 'continue' OR kind = 'resume' AND t > 0 THEN false ELSE paused END
  FROM (SELECT s.*, a.kind, CASE WHEN a.kind = 'start' AND NOT s.paused THEN coalesce(list_position(list_transform(s.states, lambda x: x IN ('PENDING', 'RETEST_PENDING')), true), 0) ELSE 0 END AS k,
      coalesce(list_position(s.texts, a.text), 0) AS t FROM steps s JOIN asked a ON a.session_id = s.session_id AND a.rn = s.rn + 1) q),
ended AS (SELECT session_id, max_by(states, rn) AS states, max_by(active, rn) AS active FROM steps GROUP BY session_id),
walked AS (SELECT session_id, list_transform(states, lambda s, i: {last}) AS states FROM ended)"""


WALKED = "SELECT session_id, unnest(range(1, len(states)+1)) AS item_index, unnest(states) AS state FROM walked"
CSV_SQL = "\nUNION ALL ".join(f"SELECT mode, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM z" for m in sinks.CSV_METRICS)
PF = "pf AS (SELECT *, url || '#' || page_id AS path FROM pages)"
QUERIES = {
    "sink_guard": (sink_guard, "SELECT l_returnflag, count(*) AS n, 'refused' AS inside FROM lineitem GROUP BY 1"),
    "stale_discard": (stale_discard, STALE_SQL),
    "playback_metrics": (playback_metrics, B.with_sql(EV, PLAY, tail="SELECT session_id, seq, round(gap,5) AS gap, underrun, round(roll,6) AS rolling_rtf FROM played")),
    "session_snapshot": (session_snapshot, B.with_sql(EV, PLAY, tail="""SELECT session_id, count(*) AS phrases, 15e-1 AS ttfa_seconds, count(*) FILTER (underrun) AS underrun_count, round(max_by(roll, n),6) AS average_rtf,
        round(avg(gap) FILTER (n > c-20),4) AS recent_gap FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS c FROM played) q GROUP BY session_id""")),
    "recent_phrases": (recent_phrases, B.with_sql(EV, tail="SELECT session_id, seq, recency FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS recency FROM ev) q WHERE recency<=3")),
    "sentence_buffer": (sentence_buffer, SENT_SQL),
    "batch_state_machine": (batch_state_machine, B.with_sql(EV, STATE, tail="SELECT session_id, item_index, replace(state, 'RECOVERED', 'PENDING') AS state FROM states")),
    "batch_counts": (batch_counts, B.with_sql(EV, STATE, tail="""SELECT session_id, count(*) FILTER (state='PENDING') AS pending, count(*) FILTER (state IN ('PLAYING','RECOVERED')) AS playing, count(*) FILTER (state='PASS') AS pass,
        count(*) FILTER (state='ISSUE') AS issue, 0 AS paused, 0 AS retest_pending FROM states GROUP BY session_id""")),
    "session_load": (session_load, B.with_sql(STORED, tail="""SELECT c.conv_id AS session_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn)-1 AS INT) AS pos, 'S' || turn AS item_id,
        CASE WHEN turn=1 THEN CASE WHEN n<=6 AND n>1 AND row_number() OVER (PARTITION BY c.conv_id ORDER BY turn)=2 THEN 'PENDING' ELSE 'PLAYING' END WHEN role='user' THEN 'PASS' ELSE 'PENDING' END AS state FROM conversations c JOIN cn ON cn.conv_id=c.conv_id WHERE n%4<>0""")),
    "recent_session": (recent_session, B.with_sql(STORED, tail="""SELECT owner, conv_id AS session_id, n AS modified, CASE WHEN n%4=1 THEN 'cue/1' ELSE 'cue/2' END AS schema_version FROM (SELECT *, CASE WHEN n>6 THEN 99 ELSE 1 END AS owner,
        row_number() OVER (PARTITION BY n>6 ORDER BY n DESC, conv_id DESC) AS r FROM cn WHERE n%4<>0) q WHERE r=1""")),
    "windowed_kpis": (windowed_kpis, B.with_sql(EV, """w AS (SELECT *, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '12 hours']) AS st FROM ev)""",
        tail="""SELECT st AS start, st + INTERVAL '1 day' AS "end", kind, count(*) AS n, round(sum(rtf),6) AS rtf_sum, max(rtf) AS rtf_max FROM w GROUP BY ALL""")),
    "session_windows": (session_windows, B.with_sql(EV, ACTIVE, tail="SELECT * FROM active")),
    "stream_stale_discard": (stream_stale_discard, of_seen(STALE_ROWS, tail=f"""SELECT session_id, seq, generation_id, coalesce(moved, opening) AS current_generation, generation_id <> coalesce(moved, opening) AS stale
        FROM tracked WHERE event_type <> 'signup' AND {DUE}""")),
    "stream_playback": (stream_playback, of_seen(PLAY, tail=f"SELECT session_id, seq, round(gap,5) AS gap, underrun, round(roll,6) AS rolling_rtf FROM played WHERE {DUE}")),
    "stream_sentence_buffer": (stream_sentence_buffer, of_seen(SENT_ROWS, tail=f"""SELECT session_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS frames, round(sum(rtf),6) AS seconds, max(seq) AS last_seq
        FROM sn WHERE {DUE} GROUP BY session_id, sentence HAVING bool_or(event_type='purchase')""")),
    "batch_resume": (batch_resume, B.with_sql(EV, walk_sql("ev", "CASE WHEN i = active AND s = 'PLAYING' THEN 'PENDING' ELSE s END"), tail=WALKED)),
    "stream_batch_states": (stream_batch_states, of_seen(walk_sql(f"(SELECT * FROM ev WHERE {DUE}) ev", "s"), tail=WALKED)),
    "stream_ingest": (stream_ingest, B.with_sql(DELIVERIES_SQL, tail="""SELECT project_id, path, sha256, min_by(seq, struct_pack(p := part, s := seq)) AS seq FROM (
        SELECT project_id, path, sha256, seq, CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS part FROM deliveries UNION ALL
        SELECT project_id, path, sha256, seq + 1000000000, 1 FROM deliveries WHERE (seq + 1000000000) % 2 = 0 UNION ALL
        SELECT project_id, path, sha256, seq + 1000000000, 2 FROM deliveries) q GROUP BY ALL""")),
    "stream_kpis": (stream_kpis, of_seen(tail=f"""SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL '1 day' AS "end", kind, count(*) AS n, round(sum(rtf),6) AS rtf_sum, max(rtf) AS rtf_max
        FROM ev GROUP BY ALL) q {CLOSED}""")),
    "stream_sliding_kpis": (stream_sliding_kpis, of_seen(WINDOWS, tail=f"""SELECT * FROM (SELECT st AS start, st + INTERVAL '1 day' AS "end", kind, count(*) AS n, round(sum(rtf),6) AS rtf_sum, max(rtf) AS rtf_max FROM w GROUP BY ALL) q {CLOSED}""")),
    "stream_session_windows": (stream_session_windows, of_seen(ACTIVE, tail=f"SELECT * FROM active {CLOSED}")),
    "stream_late_rows": (stream_late_rows, B.with_sql(ARRIVED, tail="""SELECT user_id AS session_id, CAST(part AS INT) AS batch, count(*) AS n, min(event_id) AS first_seq, CAST(sum(event_id) AS BIGINT) AS seq_sum
        FROM timed WHERE late GROUP BY ALL""")),
    "scan_takes": (scan_takes, B.with_sql(*SCORED, tail="""SELECT block_id, phrase_id, take_id, ok, why, CAST(n_syl AS DOUBLE) AS n_syl, numeric_heavy, round(range_st,6) AS range_st, end_slope, round(tail_delta,6) AS tail_delta, CAST(NULL AS DOUBLE) AS absent
        FROM scored WHERE NOT (question AND (forced OR sentence_final))""")),
    "discover_takes": (discover_takes, B.with_sql(*SCORED, tail="""SELECT '/data/' || project_id || '/' || block_id || '/p' || lpad(CAST(phrase_id AS VARCHAR), 7, '0') || '_t' || take_id || '.json' AS path,
        CASE WHEN forced THEN 'take_json_error:JSONDecodeError' ELSE 'take_json_error:ValueError' END AS error FROM scored WHERE question AND (forced OR sentence_final)""")),
    "scan_jobs": (scan_jobs, """SELECT path, i AS block_pos, 'B' || (i+1) AS block_id, sha256(t) AS h, doc_id + i AS seed FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, unnest(range(len(ls)))::INT AS i, unnest(ls) AS t FROM
        (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) q) q2"""),
    "scan_phrases": (scan_phrases, """SELECT block_id, i AS phrase_idx, sha256(t) AS h, length(t) > 40 AND contains(t, ',') AS sentence_final, false AS forced FROM (SELECT CAST(doc_id AS VARCHAR) AS block_id, unnest(range(len(ls)))::INT AS i, unnest(ls) AS t FROM
        (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) q) q2 WHERE length(t) >= 15"""),
    "scan_pins": (scan_pins, "SELECT 'B' || o_custkey AS block_id, CAST(o_orderkey AS INT) AS phrase_idx, CAST(o_custkey % 5 AS INT) AS take_id FROM orders"),
    "scan_reports": (scan_reports, """SELECT 'B' || vec_id AS block_id, unnest(range(len(embedding)))::INT AS phrase_idx, CAST(floor(abs(unnest(embedding))*20) AS INT) AS take_id FROM embeddings"""),
    "file_manifest": (file_manifest, B.with_sql(PF, """r AS (SELECT regexp_extract(path, '//([^/]*)/', 1) AS site, sha256(path || ':' || sha256(html)) AS r FROM pf)""", tail=digest_sql("r", "site", "r"))),
    "manifest_diff": (manifest_diff, B.with_sql(PF, tail="""SELECT path, CASE WHEN contains(url,'/fr/') THEN 'removed' WHEN contains(url,'?') THEN 'changed' ELSE 'same' END AS change FROM pf
        UNION ALL SELECT path || '-copy', 'added' FROM pf WHERE contains(url,'/en/')""")),
    "read_only_check": (read_only_check, """SELECT count(*) FILTER (contains(url,'/en/')) AS added, count(*) FILTER (contains(url,'/fr/')) AS removed, count(*) FILTER (NOT contains(url,'/fr/') AND contains(url,'?')) AS changed,
        count(*) FILTER (NOT contains(url,'/fr/') AND NOT contains(url,'?')) AS same, false AS read_only_verified FROM pages"""),
    "manifest_verify": (manifest_verify, B.with_sql(PF, """v AS (SELECT path AS name, CASE WHEN page_id%7=0 THEN 'manifest_missing' WHEN length(html)%3=0 THEN 'manifest_invalid' WHEN length(html)%5=0 THEN 'source_mismatch'
        WHEN length(html)%4=0 THEN 'artifact_missing' WHEN page_id%2=0 THEN 'artifact_hash_mismatch' END AS reason FROM pf)""", tail="SELECT *, reason IS NULL AS hit FROM v")),
    "sink_json_safe": (sink_json_safe, "SELECT event_id, v, v AS a0, v AS x FROM (SELECT event_id, CASE WHEN value BETWEEN 20 AND 60 THEN value END AS v FROM events) q"),
    "sink_csv_long": (sink_csv_long, f"WITH z AS ({ANALYSIS_SQL}) {CSV_SQL}"),
    "sink_markdown": (sink_markdown, "SELECT mode, '| ' || mode || ' | ' || candidate_count || ' | ' || failed_candidate_count || " + " || ".join(
        f"' | ' || coalesce(CAST({c} AS VARCHAR), 'not_run')" for c in ("failure_rate", "mean_content_accuracy", "mean_speaker_similarity", "mean_phrase_transition_score")) + f" || ' |' AS line FROM ({ANALYSIS_SQL}) z"),
    "deterministic_order": (deterministic_order, B.with_sql(B.TAKES_SQL, tail="SELECT project_id, block_id, phrase_id, take_id, row_number() OVER (ORDER BY project_id, block_id, phrase_id, take_id) AS output_line FROM takes")),
}
