"""Streams that see the events shuffled over several micro-batches agree with the batch operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cuewright.operators import sessions as S
from cuewright.plans import session_queries as Q
from cuewright.streaming import jobs, processors

SF = "/root/testdata/sf0.001"
LATENESS = "60 days"


@pytest.fixture(scope="module")
def parts(spark):
    """The events shuffled over four parts, and a row of another session that lets the watermark pass them all."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    last = e.orderBy("event_id").limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "ts": (F.col("ts") + F.expr("INTERVAL 200 days")).cast(e.schema["ts"].dataType)})
    return [Q.shape(x) for x in [*[e.where(F.pmod(F.hash("event_id"), F.lit(4)) == i) for i in range(4)], last]]


def run(parts, processor, of=lambda e: e):
    out, late = jobs.behind_watermark(parts, LATENESS, lambda e: jobs.keyed(of(e), processor, LATENESS))
    assert late.count() == 0
    return out.where("session_id >= 0")


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_stale(spark, parts):
    got = run(parts, processors.StaleFilter, Q.synth)
    want = S.discard_stale(Q.synth(Q.events(spark, SF)))
    cols = ["session_id", "seq", "generation_id", "stale"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))
    assert got.where("stale").count() > 0


def test_playback(spark, parts):
    got = run(parts, processors.Playback)
    want = S.playback(Q.events(spark, SF))
    cols = ["session_id", "seq", "underrun", F.coalesce("gap", F.lit(-1.0)), "rolling_rtf"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))


def test_playback_buckets(spark, monkeypatch):
    want = rows(S.playback(Q.events(spark, SF)).select("session_id", "seq", "rolling_rtf", F.coalesce("gap", F.lit(-1.0))))
    monkeypatch.setattr(S, "BUCKET", 16)
    assert rows(S.playback(Q.events(spark, SF)).select("session_id", "seq", "rolling_rtf", F.coalesce("gap", F.lit(-1.0)))) == want


def test_sentences(spark, parts):
    got = run(parts, processors.SentenceBuffer)
    cols = ["session_id", "sentence", "frames", "seconds", "last_seq"]
    assert rows(got.select(*cols)) == rows(S.sentence_buffer(Q.events(spark, SF)).select(*cols))


def walk(events, states, texts):
    """(states) after (kind, text) events, item by item."""
    states, paused, active = list(states), False, None
    for kind, text in events:
        if kind in ("pause", "continue"):
            paused = kind == "pause"
        elif kind == "resume" and text in texts:
            paused, active = False, None
            states[texts.index(text)] = "PENDING"
        elif kind == "start" and not paused:
            active = next((i for i, s in enumerate(states) if s in S.OPEN), None)
            if active is not None:
                states[active] = "PLAYING"
        elif active is not None and (kind == "issue" or (kind == "complete" and not paused)):
            states[active], active = ("ISSUE" if kind == "issue" else "PASS"), None
    return states


def told(spark, sessions, n):
    """Items with shared texts and first states of every kind; few items, so that sessions run out of them."""
    i = F.col("item_index")
    state = F.when(i % 4 == 3, "RETEST_PENDING").when(i % 5 == 2, "PASS").when(i == 6, "ISSUE").otherwise("PENDING")
    return sessions.distinct().select("session_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("item_index")).withColumns({"text": F.concat(F.lit("T"), i % 4), "state": state})


def by_walking(e, n):
    by, want = {}, {}
    for r in sorted(e.collect(), key=lambda r: (r["ts"], r["seq"])):
        by.setdefault(r["session_id"], []).append((r["kind"], r["text"] if "text" in r else None))
    for session, happened in by.items():
        first = ["RETEST_PENDING" if i % 4 == 3 else "PASS" if i % 5 == 2 else "ISSUE" if i == 6 else "PENDING" for i in range(1, n + 1)]
        for i, state in enumerate(walk(happened, first, [f"T{i % 4}" for i in range(1, n + 1)]), 1):
            want[session, i] = state
    return want


@pytest.mark.parametrize("n", [3, 8, 40])
def test_item_states_by_walking(spark, n):
    plain = Q.events(spark, SF)
    for e in (plain, Q.resuming(plain)):
        got = S.batch_states(e, told(spark, e.select("session_id"), n))
        assert {(r["session_id"], r["item_index"]): r["state"] for r in got.collect()} == by_walking(e, n)


def test_items_of_a_stream(spark, parts):
    ranked = S.ranked_items(told(spark, Q.events(spark, SF).select("session_id"), 8)).cache()
    got = S.last_changes(run(parts, processors.BatchMachine, lambda e: S.with_targets(Q.resuming(e), ranked)), ranked, recover=False)
    assert {(r["session_id"], r["item_index"]): r["state"] for r in got.collect()} == by_walking(Q.resuming(Q.events(spark, SF)), 8)


def test_ingest_over_batches_and_restart(spark, tmp_path):
    src, store, state = (f"{tmp_path}/{n}" for n in ("src", "store", "state"))
    shape = "project_id string, path string, sha256 string, seq long"
    put = lambda data: spark.createDataFrame(data, shape).coalesce(1).write.mode("append").json(src)
    put([("p", "a", "1", 1), ("p", "a", "1", 2), ("p", "b", "1", 3)])
    run = lambda: jobs.ingest(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(src), store, state).awaitTermination()
    run()
    put([("p", "a", "1", 4), ("p", "a", "2", 5)])
    put([("p", "b", "1", 0), (None, "a", "1", 6), (None, "a", "1", 7)])
    run()
    got = spark.read.parquet(store).select("project_id", "path", "sha256", "seq").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("p", "a", "1", 1), ("p", "a", "2", 5), ("p", "b", "1", 3), (None, "a", "1", 6)], key=str)
    # nothing of the store is read: with its files gone, what was delivered is still known
    moved = f"{tmp_path}/other"
    put([("p", "a", "2", 9), ("p", "c", "1", 10)])
    jobs.ingest(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(src), moved, state).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(moved).select("path", "seq").collect()] == [("c", 10)]


def at(*times):
    return [datetime.fromisoformat(f"2024-01-{t}") for t in times]


def events_of(spark, times):
    made = [(1, t, i, "start", 1.0, False) for i, t in enumerate(times)]
    return spark.createDataFrame(made, "session_id long, ts timestamp, seq long, kind string, rtf double, sentence_final boolean").coalesce(1)


def test_late_rows_go_to_the_side_table(spark):
    parts = [events_of(spark, at("01 00:10", "05 00:00")), events_of(spark, at("06 00:00", "04 00:00", "03 23:59")), events_of(spark, at("01 00:20", "09 00:00"))]
    out, late = jobs.behind_watermark(parts, "1 day", lambda e: jobs.windowed_kpis(e, "1 day", None, "1 day"))
    assert {r["start"].day: r["n"] for r in out.collect()} == {1: 1, 4: 1, 5: 1, 6: 1}
    assert sorted((r["batch"], r["ts"].day) for r in late.collect()) == [(1, 3), (2, 1)]


def test_sessions_merge_over_batches(spark):
    parts = [events_of(spark, at("01 00:00", "01 08:00")), events_of(spark, at("01 04:00", "02 00:00")), events_of(spark, at("20 00:00"))]
    out, late = jobs.behind_watermark(parts, "3 days", lambda e: jobs.session_kpis(e, "5 hours", "3 days"))
    assert sorted((r["start"].hour, r["n"], r["end"].hour) for r in out.collect()) == [(0, 1, 5), (0, 3, 13)] and late.count() == 0


def test_a_replayed_batch_moves_no_row(spark, tmp_path):
    base, inbox = f"{tmp_path}/split", f"{tmp_path}/inbox"
    first = events_of(spark, at("01 00:00", "05 00:00"))
    again = lambda: jobs.split_late(jobs.folder_stream(spark, inbox, first.schema), base, "1 day")
    jobs.deliver([first, events_of(spark, at("02 00:00", "08 00:00"))], inbox, [again])
    before = sorted(spark.read.parquet(f"{base}/rows").inputFiles())
    # the last batch's commit is lost, so that it runs again
    for name in ("1", ".1.crc"):
        (tmp_path / "split" / "state" / "commits" / name).unlink()
    again().awaitTermination()
    assert sorted(spark.read.parquet(f"{base}/rows").inputFiles()) == before
    assert [r["batch"] for r in jobs.late_rows(spark, base, first.schema).collect()] == [1]
