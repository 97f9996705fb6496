"""Gate, score, beam, repair and guard on small literal cases and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.operators import gates, selection as S

COLUMNS = (
    "project_id string, block_id string, phrase_id long, take_id int, n_syl int, dur double, median_hz double, range_st double, "
    "end_slope double, tail_delta double, final_glide double, final_rebound double, first_hz double, last_hz double, "
    "numeric_heavy boolean, question boolean, forced boolean, sentence_final boolean"
)


def take(block, phrase, k, slope=-12.0, dur=2.0, syl=13, med=235.0, first=240.0, last=200.0, rng=8.0, tail=None, glide=None, rebound=None, q=False, f=False, fin=False, num=False):
    return ("p", block, phrase, k, syl, dur, med, rng, slope, tail, glide, rebound, first, last, num, q, f, fin)


def frame(spark, rows):
    return gates.gate_and_score(spark.createDataFrame(rows, COLUMNS))


def why(spark, **kw):
    return frame(spark, [take("b", 0, 0, **kw)]).first()["why"]


def test_gate_classes(spark):
    assert why(spark) == []
    assert why(spark, dur=2.5) == ["rate"]
    assert why(spark, dur=2.5, num=True) == []
    assert why(spark, slope=-1.0, fin=True) == ["end_slope"]
    assert why(spark, fin=True, tail=-1.0) == ["tail", "rel_fall"]
    assert why(spark, fin=True, tail=-3.0, glide=3.0, rebound=1.0) == ["glide", "rebound"]
    assert why(spark, q=True, fin=True, slope=0.0, tail=-2.4) == []
    assert why(spark, q=True, fin=True, slope=0.0, tail=-4.8) == ["q_tail", "q_rel"]
    assert why(spark, q=True, slope=-11.43) == ["end_slope"]
    assert why(spark, f=True, slope=-9.0) == ["end_slope"]
    assert why(spark, med=290.0, rng=16.0) == ["range", "level"]
    assert why(spark, dur=0.0) == ["rate"]
    assert why(spark, med=None) == ["unmeasurable"]


def test_quality_terms(spark):
    row = frame(spark, [take("b", 0, 0, slope=-14.0, fin=True, glide=2.0, rebound=1.5)]).first()
    want = -8 * abs(6.5 - R.RATE_TARGET) - 0.5 * 2 + 5 - (1.0 * 4 + 2.0 * 0.3)
    assert row["quality"] == pytest.approx(want)


def brute_beam(phrases):
    """Reference-free restatement: keep the best three paths after each phrase, earlier ones winning ties."""
    paths = [((), 0.0, None)]
    for cands in phrases:
        grown = []
        for picks, score, last in paths:
            for k, q, first, own in cands:
                s = score + q
                if last:
                    reset = 12 * math.log2(first / last)
                    s -= (30.0 if reset < -4 or reset > 13 else 0.0) + abs(reset - 4.65) * 1.2
                grown.append((picks + (k,), s, own))
        paths = sorted(grown, key=lambda p: -round(p[1], 9))[:3]
    return paths[0]


def random_rows(seed, blocks=4, phrases=9, takes=6):
    rng = random.Random(seed)
    return [
        take(
            f"b{b}", p, k, slope=float(rng.randrange(-36, 9)), dur=rng.choice([1.8, 2.0, 2.2, 2.6]), med=rng.choice([225.0, 235.0, 250.0]),
            first=rng.choice([180.0, 240.0, 300.0]), last=rng.choice([150.0, 200.0, 260.0]), q=p % 4 == 3, f=p % 5 == 4, fin=p % 3 == 2,
        )
        for b in range(blocks) for p in range(phrases) for k in range(takes)
    ]


def test_beam_matches_brute_force_over_small_batches(spark):
    scored = frame(spark, random_rows(1)).cache()
    cands = S.candidates(scored)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r["block_id"], r["phrase_id"]): r for r in S.beam_assemble(cands).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    grouped = {}
    for r in sorted(cands.collect(), key=lambda r: (r["block_id"], r["phrase_id"], r["candidate"])):
        grouped.setdefault(r["block_id"], {}).setdefault(r["phrase_id"], []).append((r["take_id"], r["quality"], r["first_hz"], r["last_hz"]))
    for block, phrases in grouped.items():
        picks, score, _ = brute_beam([phrases[p] for p in sorted(phrases)])
        assert tuple(got[(block, p)]["take_id"] for p in sorted(phrases)) == picks
        assert got[(block, max(phrases))]["beam_score"] == pytest.approx(score)


def brute_repair(picks, alts):
    med = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    slopes = [p[1] for p in picks]
    current, moved = med(slopes), {}
    if -20 <= current <= -5:
        return moved
    for i, (phrase, _, locked) in enumerate(picks):
        if not locked:
            for slope, k in sorted(alts.get(phrase, [])):
                trial = slopes[:i] + [slope] + slopes[i + 1 :]
                if abs(med(trial) + 12.5) < abs(current + 12.5):
                    slopes, current = trial, med(trial)
                    moved[phrase] = k
                    break
        if -20 <= current <= -5:
            break
    return moved


def test_repair_matches_brute_force(spark):
    rows = []
    for i, base in enumerate((-30.0, 2.0, -28.0, -12.0)):
        rng = random.Random(i)
        for p in range(8):
            rows.append(take(f"b{i}", p, 0, slope=base + p, f=p % 5 == 4))
            rows += [take(f"b{i}", p, k, slope=float(rng.randrange(-34, 7))) for k in (1, 2, 3)]
    scored = frame(spark, rows).cache()
    picks = scored.where("take_id = 0")
    got = {(r["block_id"], r["phrase_id"]): r["new_take_id"] for r in S.median_repair(picks, scored).collect()}
    data = scored.collect()
    want = {}
    for b in {r["block_id"] for r in data}:
        mine = sorted((r for r in data if r["block_id"] == b and r["take_id"] == 0), key=lambda r: r["phrase_id"])
        alts = {}
        for r in data:
            if r["block_id"] == b and r["ok"]:
                alts.setdefault(r["phrase_id"], []).append((r["end_slope"], r["take_id"]))
        moved = brute_repair([(r["phrase_id"], r["end_slope"], r["question"] or r["forced"]) for r in mine], alts)
        want.update({(b, p): k for p, k in moved.items()})
    assert got == want and got


def test_pin_wins_and_fallback_to_measured(spark):
    scored = frame(spark, [take("b", 0, 0), take("b", 0, 1, dur=9.0), take("b", 1, 0, dur=9.0), take("b", 1, 1, dur=8.0)])
    pins = spark.createDataFrame([("p", "b", 0, 1)], "project_id string, block_id string, phrase_id long, take_id int")
    got = {(r["phrase_id"], r["take_id"]): r["tier"] for r in S.candidates(scored, pins).collect()}
    assert got == {(0, 1): 0, (1, 1): 2, (1, 0): 2}


def test_guard_statuses(spark):
    at = "project_id string, block_id string, phrase_idx int, take_id int"
    rows = [("p", b, i, k) for b in "abcd" for i in range(2) for k in range(2)]
    takes = spark.createDataFrame(
        [(*r, not (r[1] == "b" and r[3] == 1), -12.0 if not (r[1] == "c" and r[3] == 1) else 3.0, 240.0, 200.0) for r in rows],
        at + ", ok boolean, end_slope double, first_hz double, last_hz double",
    )
    base = spark.createDataFrame([("p", b, i, 0) for b in "abcd" for i in range(2)], at)
    wanted = spark.createDataFrame([("p", b, i, 1) for b in "abc" for i in range(2)] + [("p", "d", 0, 1)], at)
    pins = spark.createDataFrame([("p", "d", 0, 0)], at)
    final, status, why = S.guard(base, wanted, takes, pins)
    assert {r["block_id"]: r["status"] for r in status.collect()} == {"a": "applied", "b": "fallback", "c": "fallback", "d": "unchanged"}
    assert {(r["block_id"], r["phrase_idx"]): r["take_id"] for r in final.collect()}[("a", 1)] == 1
    assert {r["reason"] for r in why.where("block_id = 'c'").collect()} == {"block_median_outside_gate"}
    none = S.guard(base, wanted.where("false"), takes, pins)[1]
    assert {r["status"] for r in none.collect()} == {"not_requested"}


def test_topk_limits_before_the_shuffle(spark):
    plan = S.candidates(frame(spark, [take("b", 0, 0)]))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_assemble_end_to_end(spark):
    scored = frame(spark, random_rows(3)).cache()
    got = S.assemble(scored)
    assert got.count() == 36
    timed = S.timeline(S.number_phrases(got.select("project_id", "block_id", "phrase_id", "take_id", "dur", "sentence_final", "forced")))
    starts = [r["start"] for r in timed.where("block_id = 'b0'").orderBy("phrase_idx").collect()]
    assert starts[0] == 0.0 and starts == sorted(starts)
    laid = S.global_timeline(timed)
    assert laid.where("kind = 'GAP'").count() == 3


def test_sorted_counts_follow_a_list():
    import random
    import statistics
    import time

    rng = random.Random(2)
    values = [rng.randint(-40, 40) / 4 for _ in range(60)]
    held = [rng.choice(values) for _ in range(41)]
    counts = S.SortedCounts((v, held.count(v)) for v in set(values))
    for _ in range(300):
        assert counts.median() == statistics.median(held)
        gone, new = rng.choice(held), rng.choice(values)
        held[held.index(gone)] = new
        counts.add(gone, -1)
        counts.add(new, 1)
    # a hundred thousand distinct slopes and as many tried moves
    start = time.perf_counter()
    many = S.SortedCounts((float(v), 1) for v in range(100_000))
    for v in range(100_000):
        many.add(float(v), -1)
        many.add(float(99_999 - v), 1)
        many.median()
    assert time.perf_counter() - start < 20
