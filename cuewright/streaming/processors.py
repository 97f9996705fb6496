"""Keyed state for live sessions, in event-time order.

Rows of a session may arrive in any order within the allowed lateness. Each waits
in list state until the watermark has passed it; an event-time timer then hands
the rows that are due to the rule in order, so a row's result never depends on
how rows were cut into batches. Rows are appended to state chunk by chunk as
they arrive. What waits is bounded by the lateness, what a rule itself keeps by
a few values: the current generation, the last finish time and at most ten
factors, the open sentence, or the items re-opened out of turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import CHANGES, ItemWalk

ROLLING = 10
UNDERRUN_SECONDS = 0.02
#: Rows appended to state at a time.
CHUNK_ROWS = 10_000


class InOrder(StatefulProcessor):
    """Buffers rows behind the watermark; a subclass sees them once, sorted by time and ``seq``.

    ``INPUT`` names the columns a rule reads, ``seq`` first; ``OUTPUT`` its result,
    the key first. The input's ``at`` is the event time in microseconds.
    """

    INPUT: dict[str, str]
    OUTPUT: str

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Declares the rule's own state."""

    def handle_due(self, key, rows: Iterable[tuple]) -> list[tuple]:
        """Results of the rows that are due; rows are (event time, tuple of the ``INPUT`` columns)."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{name} {kind}" for name, kind in self.INPUT.items())
        self.waiting = handle.getListState("waiting", f"at bigint, {columns}")
        self.timer = handle.getValueState("timer", "at bigint")
        self.opened(handle)

    def _wake(self, at: int) -> None:
        """A timer for the earliest waiting row, unless an earlier one is set."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is None or at < known:
            self.handle.registerTimer(at // 1000)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        columns, earliest = ("at", *self.INPUT), None
        while chunk := list(islice(rows, CHUNK_ROWS)):
            at = [chunk[0].__fields__.index(c) for c in columns]
            waiting = [tuple([row[i] for i in at]) for row in chunk]
            self.waiting.appendList(waiting)
            first = min(row[0] for row in waiting)
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] // 1000 <= now else later).append(tuple(row))
        out = []
        if due:
            due.sort(key=lambda row: row[:2])
            out = self.handle_due(key, [(row[0], row[1:]) for row in due])
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        self.timer.clear()
        if later:
            self._wake(min(row[0] for row in later))
        made = Row(*[part.split()[0] for part in self.OUTPUT.split(", ")])
        yield from (made(*row) for row in out)

    def close(self) -> None:
        pass


class StaleFilter(InOrder):
    """Marks results of a generation the session has left."""

    INPUT = {"seq": "bigint", "kind": "string", "generation_id": "string"}
    OUTPUT = "session_id bigint, seq bigint, generation_id string, current_generation string, stale boolean"

    def opened(self, handle):
        self.current = handle.getValueState("current", "generation_id string")

    def handle_due(self, key, rows):
        current = self.current.get()[0] if self.current.exists() else None
        out = []
        for _, (seq, kind, generation) in rows:
            if kind == "invalidate":
                current = generation
            else:
                current = generation if current is None else current
                out.append((key[0], seq, generation, current, generation != current))
        if current is not None:
            self.current.update((current,))
        return out


class Playback(InOrder):
    """Gap, underrun and rolling factor of each phrase; state is one time and ten factors."""

    INPUT = {"seq": "bigint", "start": "double", "finish": "double", "rtf": "double"}
    OUTPUT = "session_id bigint, seq bigint, gap double, underrun boolean, rolling_rtf double"

    def opened(self, handle):
        self.finished = handle.getValueState("finished", "finish double")
        self.factors = handle.getListState("factors", "rtf double")

    def handle_due(self, key, rows):
        last = self.finished.get()[0] if self.finished.exists() else None
        recent = [r[0] for r in self.factors.get()] if self.factors.exists() else []
        out = []
        for _, (seq, start, finish, rtf) in rows:
            gap = None if last is None else max(0.0, start - last)
            recent = [*recent, rtf][-ROLLING:]
            out.append((key[0], seq, gap, gap is not None and gap > UNDERRUN_SECONDS, sum(recent) / len(recent)))
            last = finish
        self.finished.update((last,))
        self.factors.put([(r,) for r in recent])
        return out


class SentenceBuffer(InOrder):
    """Emits a sentence when its final frame is due; state is the open sentence's totals."""

    INPUT = {"seq": "bigint", "sentence_final": "boolean", "seconds": "double"}
    OUTPUT = "session_id bigint, sentence bigint, frames bigint, seconds double, last_seq bigint"

    def opened(self, handle):
        self.begun = handle.getValueState("open", "sentence bigint, frames bigint, seconds double, last_seq bigint")

    def handle_due(self, key, rows):
        number, frames, seconds, top = self.begun.get() if self.begun.exists() else (0, 0, 0.0, -1)
        out = []
        for _, (seq, final, length) in rows:
            frames, seconds, top = frames + 1, seconds + length, max(top, seq)
            if final:
                out.append((key[0], number, frames, seconds, top))
                number, frames, seconds, top = number + 1, 0, 0.0, -1
        self.begun.update((number, frames, seconds, top))
        return out


class BatchMachine(InOrder):
    """Walks a session's items through their states; emits each item when it changes.

    Events come with the item a resume asks for and the number of open items
    (``sessions.with_targets``, a join with the items' table).
    """

    INPUT = {"seq": "bigint", "kind": "string", "rank": "double", "index": "bigint", "n_open": "bigint"}
    OUTPUT = CHANGES

    def opened(self, handle):
        self.place = handle.getValueState("place", "following bigint, rank double, index bigint, paused boolean")
        self.reopened = handle.getListState("reopened", "rank double, index bigint")

    def handle_due(self, key, rows):
        following, rank, index, paused = self.place.get() if self.place.exists() else (1, None, None, False)
        held = [tuple(r) for r in self.reopened.get()] if self.reopened.exists() else []
        walk = ItemWalk(following, None if rank is None else (rank, index), paused, held)
        out = []
        for at, (seq, *event) in rows:
            change = walk.step(*event)
            if change:
                out.append((key[0], at, seq, *change))
        self.place.update((walk.following, *(walk.active or (None, None)), walk.paused))
        if walk.reopened:
            self.reopened.put(walk.reopened)
        else:
            self.reopened.clear()
        return out
