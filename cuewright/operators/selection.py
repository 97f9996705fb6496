"""Choosing takes: candidates per phrase, sequences per block, timelines."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from heapq import nsmallest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import rules as R
from ..functions.numeric import outside
from ..functions.prosody import reset_st
from ..session import cut_lineage
from .ordered import Hot, join_null_safe, number_rows, ordered_fold, previous_row, running_before, running_in_order

PHRASE = ["project_id", "block_id", "phrase_id"]
BLOCK = ["project_id", "block_id"]
CHUNK_ROWS = 65536


def index_chunk(column: str) -> list[Column]:
    return [F.floor(F.col(column) / CHUNK_ROWS)]


def ranking_score(column: str = "quality") -> Column:
    """Scores compare at nine decimals, so float noise never decides a tie."""
    return F.round(F.col(column), 9)


def _tiers(scored: DataFrame, pins: DataFrame | None) -> DataFrame:
    measured = scored.where("dur IS NOT NULL")
    if pins is None:
        return measured.withColumn("tier", F.when(F.col("ok"), 1).otherwise(2))
    chosen = pins.select(*PHRASE, F.col("take_id").alias("_pin"))
    return (
        measured.join(chosen, PHRASE, "left")
        .withColumn("tier", F.when(F.col("_pin") == F.col("take_id"), 0).when(F.col("ok"), 1).otherwise(2))
        .drop("_pin")
    )


def candidates(scored: DataFrame, pins: DataFrame | None = None, limit: int = R.CANDIDATES_PER_PHRASE) -> DataFrame:
    """The pinned take alone; else the best passing takes; else the best measured ones.

    The limit is pushed below the shuffle by Spark's window group limit, so a
    phrase with very many takes sends at most ``limit`` rows per map task.
    """
    best_first = W.partitionBy(*PHRASE).orderBy("tier", ranking_score().desc(), "take_id")
    short = _tiers(scored, pins).withColumn("candidate", F.row_number().over(best_first)).where(
        F.col("candidate") <= limit
    )
    leading = F.min("tier").over(W.partitionBy(*PHRASE))
    return short.withColumn("_tier", leading).where("tier = _tier").drop("_tier")


def _place() -> Column:
    return F.struct(F.col("tier"), (-ranking_score()).alias("s"), F.col("take_id"))


def best_take(scored: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """One row per phrase, by a map-side combined ``min_by``: no sort, no window."""
    keep = ["take_id", "tier", "ok", "quality", "dur", "end_slope", "first_hz", "last_hz"]
    rank = _place()
    return (
        _tiers(scored, pins)
        .groupBy(*PHRASE)
        .agg(F.min_by(F.struct(*keep), rank).alias("pick"), F.count(F.lit(1)).alias("n_takes"))
        .select(*PHRASE, "pick.*", "n_takes")
    )


def pick_and_named(
    scored: DataFrame, named: Column, measures: Column, flags: dict[str, Column], keys: tuple[str, ...] = tuple(reversed(PHRASE))
) -> DataFrame:
    """Of each phrase with a measured take, the ``measures`` of its best take (``pick``) and of the take that
    ``named`` tells (``named``, null where there is none), and aggregates, in one pass over the takes.

    Takes that lie sorted by ``keys`` are not sorted again.
    """
    tiered = scored.withColumn("tier", F.when(F.col("ok"), 1).otherwise(2))
    return (
        # the sort below compares numbers first
        tiered.groupBy(*keys)
        .agg(
            F.min_by(measures, F.when(F.col("dur").isNotNull(), _place())).alias("pick"),
            F.max(F.when(F.col("take_id") == named, measures)).alias("named"),
            *[c.alias(n) for n, c in flags.items()],
        )
        .where("pick IS NOT NULL")
    )


def stale_filter(takes: DataFrame, phrases: DataFrame, text: str = "text_hash") -> DataFrame:
    """Drops stored takes whose recorded text is no longer the phrase's text."""
    current = phrases.select(*PHRASE, F.col(text).alias("_now"))
    return takes.join(current, PHRASE).where(F.col(text).isNull() | (F.col(text) == F.col("_now"))).drop("_now")


def with_reset(picks: DataFrame, order: str = "phrase_idx", hot: Hot = None) -> DataFrame:
    """Pitch reset from the previous phrase of the block and whether it is in bounds."""
    out = previous_row(picks, BLOCK, [order], index_chunk(order), {"prev_last_hz": "last_hz"}, hot)
    out = out.withColumn("reset_st", reset_st(F.col("first_hz"), F.col("prev_last_hz")))
    return out.withColumn("reset_ok", ~outside(F.col("reset_st"), R.RESET_BAND))


def block_median(picks: DataFrame, value: str = "end_slope") -> DataFrame:
    """Median slope per block. Slopes are stored at two decimals, so Spark's
    partial state per block is a short value-count map, not the rows."""
    return picks.groupBy(*BLOCK).agg(F.median(value).alias("median_slope"), F.count(F.lit(1)).alias("n_phrases"))


def median_outside(value: Column, band: tuple[float, float]) -> Column:
    """Aggregate: does the median of a group leave the band; null for a group without values.

    Told by how many values lie beyond each bound and, where that is half of them,
    by the two next to it: a few numbers per group, whatever its size.
    """
    low, high = band
    n, under, over = F.count(value), F.count_if(value < low), F.count_if(value > high)
    middle = lambda a, b: F.lit(0.5) * a + F.lit(0.5) * b
    at_low = middle(F.max(F.when(value < low, value)), F.min(F.when(value >= low, value)))
    at_high = middle(F.max(F.when(value <= high, value)), F.min(F.when(value > high, value)))
    below = F.when(under * 2 == n, at_low < low).otherwise(under * 2 > n)
    above = F.when(over * 2 == n, at_high > high).otherwise(over * 2 > n)
    return F.when(n > 0, below | above)


def step_gain(quality: Column, first_hz: Column, previous_last_hz: Column) -> Column:
    """What a take adds to a sequence: its quality, less what its jump from the take before costs, if both have a pitch."""
    jump = F.when(first_hz > 0, reset_st(first_hz, previous_last_hz))
    cost = F.abs(jump - R.RESET_TARGET) * R.RESET_WEIGHT + F.when(outside(jump, R.RESET_BAND), R.RESET_MISS_PENALTY).otherwise(0.0)
    return quality - F.coalesce(F.nanvl(cost, F.lit(0.0)), F.lit(0.0))


def beam_assemble(cands: DataFrame, order: str = "phrase_id", hot: Hot = None) -> DataFrame:
    """Best sequence of takes per block under a width-3 beam.

    What each candidate would gain behind each candidate of the phrase before is
    a table of at most four by four columns a phrase, computed for all phrases at
    once. Only the choice of the best three sums depends on the step before, so
    only that runs as two ordered folds: forward over the phrases of a block
    keeping three scores, writing back-pointers; then backward following them.
    State is constant per block, but one block stays one task.
    """
    packed = (
        cands.withColumn("_c", F.struct("candidate", "take_id", "quality", "first_hz", "last_hz"))
        .groupBy(*BLOCK, order)
        .agg(F.array_sort(F.collect_list("_c")).alias("_cands"))
        .withColumn("_ends", F.col("_cands.last_hz"))
    )
    led = previous_row(packed, BLOCK, [order], index_chunk(order), {"_before": "_ends"}, hot)
    # the first phrase of a block follows one take without a pitch
    before = F.coalesce("_before", F.array(F.lit(None).cast("double")))
    gains = F.transform(before, lambda end: F.transform("_cands", lambda c: step_gain(c["quality"], c["first_hz"], end)))
    tables = led.select(*BLOCK, order, F.col("_cands.take_id").alias("takes"), F.flatten(gains).alias("gains"))

    def forward():
        state = {"key": None}

        def handle(key, rows):
            if key != state["key"]:
                state.update(key=key, held=[(0.0, 0)])
            out = []
            for phrase, takes, gains in rows:
                table, width = list(gains), len(takes)
                # compared at nine decimals; of equal ones the better beam, then the better candidate
                ends = [
                    (-round(score + gain, 9), slot, i, score + gain)
                    for slot, (score, at) in enumerate(state["held"])
                    for i, gain in enumerate(table[at * width : (at + 1) * width])
                ]
                best = nsmallest(R.BEAM_WIDTH, ends)
                state["held"] = [(total, i) for _, _, i, total in best]
                out.append((*key, phrase, [int(takes[i]) for _, _, i, _ in best], [slot for _, slot, _, _ in best], float(best[0][3])))
            return out

        return handle

    def backward():
        state = {"key": None, "slot": 0}

        def handle(key, rows):
            if key != state["key"]:
                state.update(key=key, slot=0)
            out = []
            for at, takes, parents, score, _ in rows:
                slot = state["slot"]
                out.append((*key, at, int(takes[slot]), float(score)))
                state["slot"] = parents[slot]
            return out

        return handle

    trail = ordered_fold(
        tables, BLOCK, [order], forward,
        f"project_id string, block_id string, {order} bigint, takes array<int>, parents array<int>, beam_score double",
    ).withColumn("_back", -F.col(order))
    return ordered_fold(
        trail, BLOCK, ["_back"], backward,
        f"project_id string, block_id string, {order} bigint, take_id int, beam_score double",
    )


class SortedCounts:
    """How often each of a fixed set of values occurs: changes and medians in logarithmic time (a Fenwick tree)."""

    def __init__(self, cells: Iterable[tuple[float, int]]):
        cells = sorted(cells)
        self.values = [v for v, _ in cells]
        self.total = sum(n for _, n in cells)
        self.tree = [0, *(n for _, n in cells)]
        for i in range(1, len(self.tree)):
            above = i + (i & -i)
            if above < len(self.tree):
                self.tree[above] += self.tree[i]
        self.top = 1 << max(0, len(cells).bit_length() - 1)

    def add(self, value: float, n: int) -> None:
        i = bisect_left(self.values, value) + 1
        self.total += n
        while i < len(self.tree):
            self.tree[i] += n
            i += i & -i

    def at(self, rank: int) -> float:
        """The value at a rank, from 0."""
        i, step = 0, self.top
        while step:
            if i + step < len(self.tree) and self.tree[i + step] <= rank:
                i += step
                rank -= self.tree[i]
            step >>= 1
        return self.values[i]

    def median(self) -> float:
        return (self.at((self.total - 1) // 2) + self.at(self.total // 2)) / 2


def median_repair(picks: DataFrame, scored: DataFrame, order: str = "phrase_id") -> DataFrame:
    """Replacement takes that bring a block's median slope back into its band.

    ``picks`` holds the chosen take per phrase with ``end_slope, question,
    forced``; ``scored`` every take with ``ok``. Only blocks out of band are
    streamed. A block's slopes travel as (value, count) header rows, those of its
    alternatives with a count of zero, and a phrase's alternatives as one row per
    distinct slope. A move is tried in time logarithmic in the distinct slopes.
    Returns one row per replaced phrase.
    """
    band, middle = R.BLOCK_MEDIAN_BAND, sum(R.BLOCK_MEDIAN_BAND) / 2
    off = block_median(picks).where(outside(F.col("median_slope"), band)).select(*BLOCK)
    off_picks = picks.join(off, BLOCK, "left_semi")
    movable = off_picks.where(~F.col("question") & ~F.col("forced")).select(
        *PHRASE, F.col("end_slope").alias("pick_slope")
    )
    alternatives = (
        scored.where("ok")
        .groupBy(*PHRASE, "end_slope")
        .agg(F.min("take_id").alias("n"))
        .join(movable, PHRASE)
        .select(*BLOCK, F.lit(1).alias("part"), order, "end_slope", F.col("n").cast("bigint").alias("n"), "pick_slope")
    )

    slopes = off_picks.select(*BLOCK, "end_slope", F.lit(1).alias("n")).unionByName(alternatives.select(*BLOCK, "end_slope", F.lit(0).alias("n")))
    headers = slopes.groupBy(*BLOCK, "end_slope").agg(F.sum("n").alias("n")).select(
        *BLOCK, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias(order), "end_slope",
        F.col("n").cast("bigint").alias("n"), F.lit(0.0).alias("pick_slope"),
    )

    def fold():
        state = {"key": None}

        def handle(key, rows):
            if key != state["key"]:
                state.update(key=key, cells=[], counts=None, median=None, done_at=None)
            out = []
            for kind, at, slope, n, pick in rows:
                if kind == 0:
                    state["cells"].append((slope, n))
                    continue
                if state["counts"] is None:
                    counts = SortedCounts(state["cells"])
                    state.update(counts=counts, median=counts.median(), cells=[])
                if at == state["done_at"] or band[0] <= state["median"] <= band[1]:
                    continue
                counts = state["counts"]
                counts.add(pick, -1)
                counts.add(slope, 1)
                median = counts.median()
                if abs(median - middle) < abs(state["median"] - middle):
                    state.update(median=median, done_at=at)
                    out.append((*key, at, int(n), float(slope), float(median)))
                else:
                    counts.add(slope, -1)
                    counts.add(pick, 1)
            return out

        return handle

    return ordered_fold(
        headers.unionByName(alternatives), BLOCK, ["part", order, "end_slope"], fold,
        f"project_id string, block_id string, {order} bigint, new_take_id int, new_slope double, median_after double",
    )


def apply_repair(picks: DataFrame, repairs: DataFrame, order: str = "phrase_id") -> DataFrame:
    return picks.join(repairs, [*BLOCK, order], "left").withColumn(
        "take_id", F.coalesce("new_take_id", "take_id")
    ).withColumn("end_slope", F.coalesce("new_slope", "end_slope")).drop("new_take_id", "new_slope", "median_after")


def assemble(scored: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Candidates, beam and median repair: the final take of every phrase."""
    chosen = beam_assemble(candidates(scored, pins))
    flags = scored.select(
        *PHRASE, "take_id", "end_slope", "first_hz", "last_hz", "dur", "question", "forced", "sentence_final"
    )
    picks = chosen.join(flags, [*PHRASE, "take_id"])
    replaced = apply_repair(picks.select(*PHRASE, "take_id", "end_slope"), median_repair(picks, scored))
    return replaced.select(*PHRASE, "take_id").join(flags, [*PHRASE, "take_id"])


def guard(
    baseline: DataFrame, proposals: DataFrame, takes: DataFrame, pins: DataFrame, hot: Hot = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept proposed takes only for blocks where every check holds.

    ``baseline``: BLOCK, phrase_idx, take_id (every phrase). ``proposals``: BLOCK,
    phrase_idx, take_id. ``takes``: BLOCK, phrase_idx, take_id, ok, end_slope,
    first_hz, last_hz. ``pins``: BLOCK, phrase_idx, take_id.
    Returns (final picks, one status row per block, one row per reason).
    """
    at = [*BLOCK, "phrase_idx"]
    base = baseline.select(*at, F.col("take_id").alias("base_take"))
    held = pins.select(*at).distinct().withColumn("_pinned", F.lit(True))
    wanted = proposals.select(*at, F.col("take_id").alias("want_take"))
    known = takes.select(
        *at, F.col("take_id").alias("want_take"), (F.col("ok") & F.col("end_slope").isNotNull()).alias("_usable")
    )
    asked = (
        wanted.join(held, at, "left")
        .join(base.select(*at, F.lit(True).alias("_known")), at, "left")
        .join(known, [*at, "want_take"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_known").isNull(), F.lit("invalid_phrase_index"))
            .when(F.col("_pinned"), F.lit(None))
            .when(~F.coalesce("_usable", F.lit(False)), F.lit("invalid_or_failed_take")),
        )
        .select(*at, "want_take", "_pinned", "reason")
    )
    asked = cut_lineage(asked)
    bad = asked.where("reason IS NOT NULL").select(*at, "reason")
    swaps = asked.where("reason IS NULL AND _pinned IS NULL").select(*at, "want_take")
    trial = base.join(swaps, at, "left").withColumn("take_id", F.coalesce("want_take", "base_take"))
    # read by four checks below: written once to the shared checkpoint folder
    rows = cut_lineage(
        trial.join(takes.select(*at, "take_id", "end_slope", "first_hz", "last_hz"), [*at, "take_id"], "left")
    )
    trial = rows.select(*at, "base_take", "take_id")
    missing = rows.where("end_slope IS NULL").select(*at, F.lit("selected_take_metrics_missing").alias("reason"))
    early = cut_lineage(bad.unionByName(missing))
    blocks_bad = early.select(*BLOCK).distinct()
    asking = proposals.select(*BLOCK).distinct()
    sound = rows.join(asking, BLOCK, "left_semi").join(blocks_bad, BLOCK, "left_anti")
    off_median = sound.groupBy(*BLOCK).agg(median_outside(F.col("end_slope"), R.BLOCK_MEDIAN_BAND).alias("_off")).where("_off").select(
        *BLOCK, F.lit(-1).alias("phrase_idx"), F.lit("block_median_outside_gate").alias("reason")
    )
    off_reset = with_reset(sound, hot=hot).where(~F.col("reset_ok")).select(
        *at, F.lit("reset_outside_gate").alias("reason")
    )
    # few rows, read for the status and by the caller
    why = cut_lineage(early.join(asking, BLOCK, "left_semi").unionByName(off_median).unionByName(off_reset))
    refused = why.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n_reasons"))
    moved = trial.groupBy(*BLOCK).agg(F.bool_or(F.col("take_id") != F.col("base_take")).alias("_moved"))
    status = (
        moved.join(asking.withColumn("_asked", F.lit(True)), BLOCK, "left")
        .join(refused, BLOCK, "left")
        .select(
            *BLOCK,
            F.when(F.col("_asked").isNull(), "not_requested")
            .when(F.col("n_reasons") > 0, "fallback")
            .when(F.col("_moved"), "applied")
            .otherwise("unchanged")
            .alias("status"),
            F.coalesce("n_reasons", F.lit(0)).alias("n_reasons"),
        )
    )
    final = trial.join(status.where("status = 'applied'").select(*BLOCK, F.lit(True).alias("_go")), BLOCK, "left").select(
        *at, F.when(F.col("_go"), F.col("take_id")).otherwise(F.col("base_take")).alias("take_id")
    )
    return final, status, why


def outcome(baseline: DataFrame, final: DataFrame) -> DataFrame:
    """Per block: did any pick change; if not, the existing selector stands."""
    at = [*BLOCK, "phrase_idx"]
    both = baseline.select(*at, F.col("take_id").alias("before")).join(
        final.select(*at, F.col("take_id").alias("after")), at, "full"
    )
    return both.groupBy(*BLOCK).agg(
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_changed")
    ).select(
        *BLOCK, "n_changed", (F.col("n_changed") > 0).alias("changed"),
        (F.col("n_changed") == 0).alias("fallback_to_existing"),
    )


def pause_seconds(sentence_final: Column, forced: Column, seed: Column | None = None) -> Column:
    """Pause after a phrase: middle of its class band, or spread over it by a seed."""
    low = F.when(sentence_final, R.PAUSE_FINAL[0]).when(forced, R.PAUSE_FORCED[0]).otherwise(R.PAUSE_CONTINUE[0])
    high = F.when(sentence_final, R.PAUSE_FINAL[1]).when(forced, R.PAUSE_FORCED[1]).otherwise(R.PAUSE_CONTINUE[1])
    part = F.lit(0.5) if seed is None else F.pmod(F.xxhash64(seed), F.lit(1 << 20)) / float(1 << 20)
    return low + (high - low) * part


def timeline(picks: DataFrame, order: str = "phrase_idx", hot: Hot = None) -> DataFrame:
    """Start of each phrase inside its block: all earlier durations and pauses."""
    step = F.col("dur") + pause_seconds(F.col("sentence_final"), F.col("forced"))
    out = running_before(picks, BLOCK, [F.col(order)], index_chunk(order), {"_start": ("sum", step)}, hot)
    return out.withColumn("start", F.round("_start", 3)).withColumn("end_exact", F.col("_start") + F.col("dur"))


def global_timeline(timed: DataFrame, gap: float = R.BLOCK_GAP_SECONDS, order: str = "phrase_idx") -> DataFrame:
    """Block timelines laid end to end per project, with a GAP row between blocks."""
    # read for the block lengths and again for the rows: written once
    timed = cut_lineage(timed)
    lengths = timed.groupBy(*BLOCK).agg(F.max("end_exact").alias("length"))
    placed = running_in_order(lengths, ["project_id", "block_id"], {"offset": F.col("length") + gap}, ["project_id"])
    spoken = join_null_safe(timed, placed, BLOCK).select(
        *BLOCK,
        F.col(order).cast("bigint").alias("phrase_idx"),
        F.lit("PHRASE").alias("kind"),
        F.round(F.col("offset") + F.col("_start"), 1).alias("start"),
        F.round(F.col("offset") + F.col("end_exact"), 1).alias("end"),
    )
    # a null block comes first
    last = placed.groupBy("project_id").agg(F.max("block_id").alias("_last"))
    gaps = join_null_safe(placed, last, ["project_id"]).where("block_id < _last OR (block_id IS NULL AND _last IS NOT NULL)").select(
        *BLOCK,
        F.lit(-1).cast("bigint").alias("phrase_idx"),
        F.lit("GAP").alias("kind"),
        F.round(F.col("offset") + F.col("length"), 1).alias("start"),
        F.round(F.col("offset") + F.col("length") + gap, 1).alias("end"),
    )
    return spoken.unionByName(gaps)


def early_stop(scored: DataFrame, hot: Hot = None) -> DataFrame:
    """First take count at which generation would have stopped, per phrase."""
    good = F.col("ok") & F.col("dur").isNotNull()
    run = running_before(
        scored, PHRASE, [F.col("take_id")], [F.floor(F.col("take_id") / 4096)],
        {
            "_n": ("sum", F.lit(1)),
            "_pass": ("sum", good.cast("int")),
            "_best": ("max", F.when(good, ranking_score())),
        },
        hot,
    )
    n = F.col("_n") + 1
    passing = F.col("_pass") + good.cast("int")
    best = F.greatest(F.col("_best"), F.when(good, ranking_score()))
    stops = (
        (n >= R.EARLY_STOP_MIN_TAKES) & (passing >= R.EARLY_STOP_MIN_PASSING) & (best >= R.EARLY_STOP_QUALITY)
    )
    return run.groupBy(*PHRASE).agg(
        F.count(F.lit(1)).alias("n_takes"), F.min(F.when(stops, n)).cast("bigint").alias("stop_after")
    )


def escalation(scored: DataFrame) -> DataFrame:
    """How often the pool would have grown: at each pool end with nothing passing."""
    base = (
        F.when(F.col("question"), R.POOL_QUESTION).when(F.col("forced"), R.POOL_FORCED).otherwise(R.POOL_STATEMENT)
    )
    per_phrase = scored.groupBy(*PHRASE, "question", "forced").agg(
        F.count(F.lit(1)).alias("n_takes"), F.min(F.when(F.col("ok"), F.col("take_id"))).alias("first_pass")
    )
    rounds = F.lit(0)
    for step in range(R.ESCALATION_ROUNDS):
        edge = base + step * R.ESCALATION_TAKES
        nothing = F.col("first_pass").isNull() | (F.col("first_pass") >= edge)
        rounds = rounds + ((F.col("n_takes") >= edge) & nothing).cast("int")
    return per_phrase.select(
        *PHRASE, "n_takes", rounds.alias("rounds"), (base + rounds * R.ESCALATION_TAKES).alias("pool")
    )


def eligible(takes: DataFrame, required: list[str], minimum_coverage: float, features: list[str]) -> DataFrame:
    """Hard gate true, every required validator passed, enough finite features.

    ``takes`` carries ``hard_gate_pass``, ``passed`` (array of validator names)
    and the feature columns.
    """
    known = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("passed"))
    return takes.withColumn("coverage", known / F.lit(float(len(features)))).withColumn(
        "eligible",
        F.coalesce(F.col("hard_gate_pass"), F.lit(False))
        & (F.size(missing) == 0)
        & (F.col("coverage") >= minimum_coverage),
    )


def propose(ranked: DataFrame, pinned: DataFrame, minimum_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Proposals per phrase, and approval per block.

    ``ranked``: PHRASE, take_id, utility of the eligible takes, plus every phrase
    present in ``phrase_status``'s input through ``pinned`` (PHRASE, is_pinned for
    all phrases). A block is approved when it has an unpinned phrase and all of
    those got a proposal.
    """
    ranked = cut_lineage(ranked.select(*PHRASE, "take_id", "utility"))
    first = F.struct((-F.round("utility", 9)).alias("s"), F.col("take_id"))
    top = ranked.groupBy(*PHRASE).agg(
        F.count(F.lit(1)).alias("n_eligible"), F.min(first).alias("_top")
    )
    runner_up = (
        ranked.join(top.select(*PHRASE, F.col("_top.take_id").alias("_t")), PHRASE)
        .where("take_id <> _t")
        .groupBy(*PHRASE)
        .agg(F.max("utility").alias("_second"))
    )
    gap = -F.col("_top.s") - F.coalesce(F.col("_second"), -F.col("_top.s"))
    confidence = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-gap)) - 0.5) * 2.0
    detail = (
        pinned.join(top, PHRASE, "left")
        .join(runner_up, PHRASE, "left")
        .withColumn("top_confidence", F.when(F.col("n_eligible") > 1, confidence))
        .withColumn(
            "status",
            F.when(F.col("is_pinned"), "pin_preserved")
            .when(F.coalesce("n_eligible", F.lit(0)) < 2, "fewer_than_two_eligible_survivors")
            .when(F.col("top_confidence") < minimum_confidence, "confidence_or_coverage_below_threshold")
            .otherwise("approved_proposal"),
        )
        .select(
            *PHRASE, "status", "top_confidence",
            F.when(F.col("status") == "approved_proposal", F.col("_top.take_id")).alias("take_id"),
        )
    )
    blocks = detail.groupBy(*BLOCK).agg(
        F.count_if(F.col("status") != "pin_preserved").alias("n_unpinned"),
        F.count_if(F.col("status") == "approved_proposal").alias("n_proposals"),
    ).withColumn(
        "decision",
        F.when(F.col("n_unpinned") == 0, "all_phrases_pinned")
        .when(F.col("n_proposals") != F.col("n_unpinned"), "not_all_unpinned_phrases_met_select_policy")
        .otherwise("approved"),
    )
    return detail, blocks


def number_phrases(picks: DataFrame, order: str = "phrase_id", hot: Hot = None) -> DataFrame:
    """0-based position of each phrase in its block."""
    out = number_rows(picks, BLOCK, [F.col(order)], index_chunk(order), "_rn", hot)
    return out.withColumn("phrase_idx", (F.col("_rn") - 1).cast("int")).drop("_rn")
