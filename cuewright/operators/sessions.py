"""Playback sessions as event tables: staleness, timing, sentences, item states."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ordered import Hot, join_null_safe, number_rows, ordered_fold, running_before

SESSION = "session_id"
UNDERRUN_SECONDS = 0.02
ROLLING, GAPS_KEPT, RECENT = 10, 20, 3
BUCKET = 4096


def day_chunk(ts: str = "ts") -> list[Column]:
    return [F.date_trunc("day", F.col(ts))]


def discard_stale(events: DataFrame, hot: Hot = None) -> DataFrame:
    """Marks synthesis results of a generation the session has left.

    ``events``: session_id, ts, seq, kind (synth | invalidate), generation_id.
    The current generation is the last invalidation's, and before any of those
    the first synthesis sets it.
    """
    moved = F.when(F.col("kind") == "invalidate", F.struct("ts", "seq", "generation_id"))
    run = running_before(events, [SESSION], [F.col("ts"), F.col("seq")], day_chunk(), {"_last": ("max", moved)}, hot)
    opening = events.where("kind = 'synth'").groupBy(SESSION).agg(
        F.min_by("generation_id", F.struct("ts", "seq")).alias("_first")
    )
    out = join_null_safe(run.where("kind = 'synth'"), opening, [SESSION])
    current = F.coalesce(F.col("_last.generation_id"), F.col("_first"))
    return out.withColumn("current_generation", current).withColumn(
        "stale", F.col("generation_id") != current
    ).drop("_last", "_first")


def _with_context(numbered: DataFrame, depth: int) -> DataFrame:
    """Buckets of consecutive rows, each led by the ``depth`` rows before it.

    A window that looks back at most ``depth`` rows is then exact inside one
    (session, bucket), so a hot session spreads over its buckets.
    """
    bucket = F.floor((F.col("n") - 1) / BUCKET)
    late = F.pmod(F.col("n") - 1, F.lit(BUCKET)) >= BUCKET - depth
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("context"))
    ahead = F.struct((bucket + 1).alias("bucket"), F.lit(True).alias("context"))
    return numbered.select("*", F.inline(F.array_compact(F.array(own, F.when(late, ahead)))))


def playback(events: DataFrame, hot: Hot = None) -> DataFrame:
    """Gap to the previous phrase, underrun flag and rolling factor of each phrase.

    ``events``: session_id, ts, seq, start, finish (seconds), rtf.
    """
    numbered = number_rows(events, [SESSION], [F.col("ts"), F.col("seq")], day_chunk(), "n", hot)
    w = W.partitionBy(SESSION, "bucket").orderBy("n")
    back = w.rowsBetween(-(ROLLING - 1), 0)
    gap = F.greatest(F.lit(0.0), F.col("start") - F.lag("finish").over(w))
    rows = _with_context(numbered, ROLLING).withColumns(
        {"gap": F.when(F.lag("finish").over(w).isNotNull(), gap), "rolling_rtf": F.avg("rtf").over(back)}
    )
    return rows.where("NOT context").withColumn("underrun", F.coalesce(F.col("gap") > UNDERRUN_SECONDS, F.lit(False))).drop(
        "context", "bucket"
    )


def session_snapshot(played: DataFrame, submitted: DataFrame) -> DataFrame:
    """Per session: time to first audio, phrases, underruns, current rolling factor, last gaps' mean."""
    sizes = played.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("phrases"),
        F.min("start").alias("_first"),
        F.count_if("underrun").alias("underrun_count"),
        F.max_by("rolling_rtf", "n").alias("average_rtf"),
    )
    recent = played.select(SESSION, "n", "gap").join(sizes.select(SESSION, "phrases"), SESSION).where(
        F.col("n") > F.col("phrases") - GAPS_KEPT
    ).groupBy(SESSION).agg(F.avg("gap").alias("recent_gap"))
    return sizes.join(recent, SESSION).join(submitted, SESSION).select(
        SESSION, "phrases", (F.col("_first") - F.col("submitted")).alias("ttfa_seconds"), "underrun_count", "average_rtf", "recent_gap"
    )


def recent_phrases(played: DataFrame) -> DataFrame:
    """The last three phrases of each session."""
    place = F.row_number().over(W.partitionBy(SESSION).orderBy(F.col("n").desc()))
    return played.withColumn("recency", place).where(F.col("recency") <= RECENT)


def sentence_buffer(events: DataFrame, hot: Hot = None) -> DataFrame:
    """Closed sentences: the frames up to and including each final one.

    ``events``: session_id, ts, seq, sentence_final, seconds. Frames after the
    last final stay in the buffer and are not emitted.
    """
    run = running_before(
        events, [SESSION], [F.col("ts"), F.col("seq")], day_chunk(), {"sentence": ("sum", F.col("sentence_final").cast("int"))}, hot
    )
    return run.groupBy(SESSION, "sentence").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("seconds").alias("seconds"), F.bool_or("sentence_final").alias("_closed"),
        F.max("seq").alias("last_seq"),
    ).where("_closed").drop("_closed")


STATES = ("PENDING", "PLAYING", "PASS", "ISSUE", "PAUSED", "RETEST_PENDING")


OPEN = ("PENDING", "RETEST_PENDING")


class ItemWalk:
    """One session's walk through its items, event by event.

    Items that are open at first are known by their rank among these, others by
    the rank they follow plus a half. What is kept is the next rank, the item that
    plays, whether the session is paused, and the items re-opened out of turn.
    """

    def __init__(self, following: int = 1, active: tuple | None = None, paused: bool = False, reopened: Iterable[tuple] = ()):
        self.following, self.active, self.paused = following, active, paused
        self.reopened = sorted(reopened)

    def step(self, kind: str, rank: float | None, index: int | None, n_open: int) -> tuple | None:
        """(rank, index, state) of the item that changes, if any; a start without an open item gives NONE.

        ``rank`` and ``index`` name the item a resume asks for, null if there is none.
        """
        if kind in ("pause", "continue"):
            self.paused = kind == "pause"
        elif kind == "resume" and rank is not None:
            self.paused, self.active = False, None
            if (rank < self.following or rank % 1) and (rank, index) not in self.reopened:
                insort(self.reopened, (rank, index))
            return rank, index, "PENDING"
        elif kind == "start" and not self.paused:
            if self.reopened and (self.reopened[0][0] < self.following or self.following > n_open):
                self.active = self.reopened.pop(0)
            elif self.following <= n_open:
                self.active = (float(self.following), None)
                self.following += 1
            else:
                self.active = None
                return None, None, "NONE"
            return *self.active, "PLAYING"
        elif self.active and (kind == "issue" or (kind == "complete" and not self.paused)):
            done, self.active = self.active, None
            return *done, "ISSUE" if kind == "issue" else "PASS"
        return None


def ranked_items(items: DataFrame, hot: Hot = None) -> DataFrame:
    """Items with their ``rank`` among those that are open at first, and their first ``state``."""
    known = items if "state" in items.columns else items.withColumn("state", F.lit("PENDING"))
    is_open = F.col("state").isin(*OPEN)
    order, chunk = [F.col("item_index")], [F.floor(F.col("item_index") / BUCKET)]
    before = running_before(known, [SESSION], order, chunk, {"_open": ("sum", is_open.cast("int"))}, hot)
    return before.withColumn("rank", F.col("_open") + F.when(is_open, 1.0).otherwise(0.5)).drop("_open")


def with_targets(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Events with the item each resume asks for (the first with that text), and how many items are open at first.

    ``ranked`` is a stored or batch table; ``events`` may be a stream.
    """
    first = ranked.groupBy(SESSION, "text").agg(F.min_by(F.struct("rank", "item_index"), "item_index").alias("_t"))
    sizes = ranked.groupBy(SESSION).agg(F.count_if(F.col("rank") % 1 == 0).alias("n_open"))
    asked = F.when(F.col("kind") == "resume", F.col("text"))
    out = events.withColumn("_asked", asked).join(first.withColumnsRenamed({SESSION: "_s", "text": "_x"}), (F.col(SESSION) == F.col("_s")) & (F.col("_asked") == F.col("_x")), "left")
    out = out.select(*events.columns, F.col("_t.rank").alias("rank"), F.col("_t.item_index").alias("index"))
    return out.join(sizes, SESSION, "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))


CHANGES = "session_id bigint, at bigint, seq bigint, rank double, item_index bigint, state string"


def _walked(targets: DataFrame) -> DataFrame:
    """Every change of the sessions, by walking each in order."""

    def fold():
        walks = {}

        def handle(key, rows):
            if key not in walks:
                walks.clear()
                walks[key] = ItemWalk()
            out = []
            for at, seq, kind, rank, index, n_open in rows:
                absent = rank is None or rank != rank
                change = walks[key].step(kind, None if absent else rank, None if absent else int(index), n_open)
                if change:
                    out.append((*key, at, seq, *change))
            return out

        return handle

    rows = targets.select(SESSION, F.unix_micros("ts").alias("at"), "seq", "kind", "rank", "index", "n_open")
    return ordered_fold(rows, [SESSION], ["at", "seq"], fold, CHANGES)


def last_changes(changes: DataFrame, ranked: DataFrame, recover: bool) -> DataFrame:
    """State of every item after all changes; one that never changed keeps its first state."""
    order = F.struct("at", "seq")
    if recover:
        ends = changes.groupBy(SESSION).agg(F.max(order).alias("_end"))
        cut_short = (F.col("state") == "PLAYING") & (order == F.col("_end"))
        changes = changes.join(ends, SESSION).withColumn("state", F.when(cut_short, "PENDING").otherwise(F.col("state")))
    last = changes.where("state <> 'NONE'").groupBy(SESSION, "rank", (F.col("rank") % 1 > 0).alias("_closed"), F.when(F.col("rank") % 1 > 0, F.col("item_index")).alias("_i")).agg(
        F.max_by("state", order).alias("_state")
    )
    named = ranked.withColumn("_i", F.when(F.col("rank") % 1 > 0, F.col("item_index")))
    joined = named.join(last.drop("_closed").withColumnsRenamed({SESSION: "_s", "rank": "_r", "_i": "_j"}), (F.col(SESSION) == F.col("_s")) & (F.col("rank") == F.col("_r")) & F.col("_i").eqNullSafe(F.col("_j")), "left")
    return joined.withColumn("state", F.coalesce("_state", "state")).drop("rank", "_i", "_s", "_r", "_j", "_state")


def batch_states(events: DataFrame, items: DataFrame, recover: bool = False, hot: Hot = None) -> DataFrame:
    """State of every item after the session's events.

    ``events``: session_id, ts, seq, kind (start | complete | issue | pause |
    continue | resume), text (of a resume). ``items``: session_id, item_index (from
    1), optionally text and a first state. Starts and completions count only
    while not paused; each start takes the first open item; what directly follows
    a start among the effective events settles it. A resume re-opens the first
    item with its text, ends the pause and leaves what plays.

    Sessions that resume are walked in order, one task a session: what a start
    takes then depends on all re-opened items. All others are split by rank.
    """
    ranked = ranked_items(items, hot)
    if "text" not in events.columns:
        return _unresumed(events, ranked, recover, hot)
    resuming = events.where("kind = 'resume'").select(SESSION).distinct()
    walked = last_changes(_walked(with_targets(events.join(resuming, SESSION, "left_semi"), ranked)), ranked.join(resuming, SESSION, "left_semi"), recover)
    plain = _unresumed(events.join(resuming, SESSION, "left_anti").drop("text"), ranked.join(resuming, SESSION, "left_anti"), recover, hot)
    return walked.unionByName(plain)


def _unresumed(events: DataFrame, ranked: DataFrame, recover: bool, hot: Hot) -> DataFrame:
    flag = F.when(F.col("kind").isin("pause", "continue"), F.struct("ts", "seq", (F.col("kind") == "pause").alias("paused")))
    order = [F.col("ts"), F.col("seq")]
    run = running_before(events, [SESSION], order, day_chunk(), {"_flag": ("max", flag)}, hot)
    paused = F.coalesce(F.col("_flag.paused"), F.lit(False))
    live = run.where((F.col("kind") == "issue") | (F.col("kind").isin("start", "complete") & ~paused)).select(
        SESSION, "ts", "seq", "kind"
    )
    # the follower of an event is seen from the follower's side, as its predecessor
    numbered = number_rows(live, [SESSION], order, day_chunk(), "n", hot)
    starts = running_before(
        numbered.where("kind = 'start'"), [SESSION], [F.col("n")], [F.floor(F.col("n") / BUCKET)], {"_k": ("sum", F.lit(1))}, hot
    ).select(SESSION, "n", (F.col("_k") + 1).cast("double").alias("rank"))
    after = numbered.select(SESSION, (F.col("n") - 1).alias("n"), F.col("kind").alias("then"))
    settled = starts.join(after, [SESSION, "n"], "left")
    state = F.when(F.col("then") == "complete", "PASS").when(F.col("then") == "issue", "ISSUE")
    if recover:
        state = state.when(F.col("then").isNull(), "PENDING")
    settled = settled.select(SESSION, "rank", state.otherwise("PLAYING").alias("_state"))
    return ranked.join(settled, [SESSION, "rank"], "left").withColumn("state", F.coalesce("_state", "state")).drop("_state", "rank")


def batch_counts(states: DataFrame) -> DataFrame:
    """Items per state and session, zero states included."""
    return states.groupBy(SESSION).agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])


def resume_from(states: DataFrame, texts: DataFrame) -> DataFrame:
    """Re-opens the first item whose text equals the session's requested one.

    ``states``: session_id, item_index, text, state. ``texts``: session_id, text.
    """
    hit = states.join(texts, [SESSION, "text"]).groupBy(SESSION).agg(F.min("item_index").alias("item_index")).withColumn(
        "_hit", F.lit(True)
    )
    return states.join(hit, [SESSION, "item_index"], "left").withColumn(
        "state", F.when(F.col("_hit"), "PENDING").otherwise(F.col("state"))
    ).drop("_hit")


SCHEMAS = ("session/1", "session/2")


def load_sessions(stored: DataFrame, schemas: tuple[str, ...] = SCHEMAS) -> DataFrame:
    """Stored session documents made safe to resume, one row per item.

    ``stored``: session_id, modified, schema_version, active_index, items
    (array of item_id, text, state). Unknown schemas and states are refused; the
    item that was playing starts over.
    """
    ok = F.col("schema_version").isin(*schemas) & (F.size("items") > 0) & F.forall("items", lambda i: i["state"].isin(*STATES))
    kept = stored.where(ok).withColumn(
        "active_index",
        F.when((F.col("active_index") >= 0) & (F.col("active_index") < F.size("items")), F.col("active_index")),
    )
    rows = kept.select(SESSION, "modified", "active_index", F.posexplode("items").alias("pos", "_i"))
    redo = (F.col("pos") == F.col("active_index")) & (F.col("_i.state") == "PLAYING")
    return rows.select(
        SESSION, "modified", "pos", "_i.item_id", "_i.text", F.when(redo, "PENDING").otherwise(F.col("_i.state")).alias("state")
    )


def latest_session(stored: DataFrame, owner: str, schemas: tuple[str, ...] = SCHEMAS) -> DataFrame:
    """Newest loadable session of each owner."""
    ok = F.col("schema_version").isin(*schemas) & (F.size("items") > 0) & F.forall("items", lambda i: i["state"].isin(*STATES))
    rest = [c for c in stored.columns if c != owner]
    newest = stored.where(ok).groupBy(owner).agg(F.max_by(F.struct(*rest), F.struct("modified", SESSION)).alias("_s"))
    return newest.select(owner, "_s.*")


def kpis(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Counts and factors per event-time window and kind; also works on a stream with a watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rtf").alias("rtf_sum"), F.max("rtf").alias("rtf_max")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "rtf_sum", "rtf_max")


def activity(events: DataFrame, gap: str) -> DataFrame:
    """Stretches of a session without a pause of more than ``gap``; also works on a stream with a watermark."""
    return events.groupBy(SESSION, F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rtf").alias("rtf_sum"), F.max("rtf").alias("rtf_max"), F.count_if("sentence_final").alias("sentences")
    ).select(SESSION, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rtf_sum", "rtf_max", "sentences")
