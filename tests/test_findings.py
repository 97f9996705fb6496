"""Small inputs on which a query once departed from its SQL."""

import collections
import datetime
import hashlib
import itertools
import math
import random
import time

import duckdb
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import Row, functions as F

from cuewright.functions import korean as K, text as X
from cuewright.functions.numeric import c_exp2, c_log2, semitones
from cuewright.operators import bank, pairs as P, selection
from cuewright.plans.registry import catalog
from cuewright.sources import readers
from cuewright.streaming import processors


def check(spark, folder, name, **tables):
    """Writes the given tables and runs one query against its SQL."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    run, sql = catalog()[name]
    error, n = compare(spark, con, str(folder), run, sql)
    assert error is None, error
    return n


def test_report_picks_are_products_of_floats(spark, tmp_path):
    values = [i / 20 for i in range(-20, 21)] + [0.35, 0.7, 0.15, 0.6203442]
    assert check(spark, tmp_path, "scan_reports", embeddings=("vec_id long, embedding array<float>, label int", [(1, values, 0)])) == len(values)


@pytest.mark.parametrize("word", ["thing.\nerl", 'a"b', "a\\b", "\t", "e", "plain", ""])
def test_any_first_word_makes_a_rule(spark, tmp_path, word):
    docs = [(1, f"x{word}y the {word} end"), (2, "no such word"), (3, "")]
    items = [(3, "older rule"), (6, f"{word} rest of it"), (7, "later but broken")]
    assert check(spark, tmp_path, "text_overlay", documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", items)) == 3


def test_dataset_hash_lists_all_rows_in_order(spark):
    fields = ["project_id", "block_id", "phrase_id", "take_id", "decision", "hard_gate_pass", "text_hash", "f"]
    rows = [("p", f"b{i % 7}", i, i % 3, "unknown", i % 2 == 0, "t", i / 7) for i in range(300)] * 2 + [("q", "b", 1, 1, "selected", True, "t", None)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cell = lambda v: "null" if v is None else f"{v:.6f}"
    text = lambda r: "|".join([r[0], r[1], str(r[2]), str(r[3]), r[4], str(r[5]).lower(), r[6], cell(r[7])])

    def fold(entries, size):
        """Entries are (prefix, text); those of one prefix of the given size become one."""
        groups = {}
        for prefix, entry in sorted(entries):
            groups.setdefault(prefix[:size], []).append(entry)
        return [(b, f"{b}:" + sha(",".join(e))) for b, e in groups.items()]

    want = {}
    for key in "pq":
        counted = collections.Counter(sha(text(r)) for r in rows if r[0] == key)
        level = [(h, f"{h}:{n}") for h, n in counted.items()]
        for size in (5, 2, 0):
            level = fold(level, size)
        want[key] = (level[0][1][1:], sum(counted.values()))
    df = spark.createDataFrame(rows, "project_id string, block_id string, phrase_id int, take_id int, decision string, hard_gate_pass boolean, text_hash string, f double")
    assert df.columns == fields
    got = P.dataset_hash(df.repartition(5), ["f"], ["project_id"])
    assert {r["project_id"]: (r["digest"], r["n_rows"]) for r in got.collect()} == want
    assert P.dataset_hash(df.where("false"), ["f"]).first()["n_rows"] == 0


def test_sentence_ends_are_found_in_linear_time(spark):
    lines = ["a b\nc. d", "\n\nx.y!?z", "..", "tail without end", "。한 글! 끝？\n", "", "a.\nb", " . \n ?"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    old, new = (F.regexp_extract_all("t", F.lit(p), 0) for p in (X.SENTENCE, X.SENTENCE_START))
    assert df.where(old != new).count() == 0
    # a line of 400,000 characters without an end took 80 billion steps
    long = "word " * 80_000 + "\nend."
    start = time.time()
    assert spark.createDataFrame([(long,)], "t string").select(F.size(X.sentences_multi(F.col("t"))).alias("n")).first()["n"] == 1
    assert time.time() - start < 20


def test_pairs_aligned_together_are_aligned_as_alone():
    r = random.Random(5)
    some = lambda most, kinds: [str(r.randrange(kinds)) for _ in range(r.randrange(most))]
    pairs = [(some(30, 5), some(30, 5)) for _ in range(400)] + [([], []), ([], ["a"]), (["a"], []), (some(400, 40), ["1"])]
    assert K.align_many(pairs) == [K.align_tokens(*p) for p in pairs]
    assert K.align_many([]) == []
    # one pair at a time these took 40 s and more
    turns = [(some(150, 50), some(150, 50)) for _ in range(4000)]
    start = time.time()
    K.align_many(turns)
    assert time.time() - start < 15


def test_phrases_leave_a_worker_in_small_batches():
    text = "가나다라 마바사아 자차카타 파하거너. " * 200
    n = len(K.phrase_rows(text))
    scripts = pa.RecordBatch.from_pydict({"k": pa.array(range(1500)), "t": pa.array([text, None, ""] * 500)})
    out = list(K.phrase_batches([scripts], 1, ["k", "phrase_idx", "text", "sentence_final", "forced"]))
    assert sum(b.num_rows for b in out) == 500 * n and max(b.num_rows for b in out) <= n * (K.PHRASE_CHUNK // len(text) + 1)
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["text"] for r in rows[:n]] == [p[0] for p in K.phrase_rows(text)]
    assert [(r["k"], r["phrase_idx"]) for r in rows[n : n + 2]] == [(3, 0), (3, 1)]


def test_take_documents_are_parsed_once(spark):
    raw = spark.range(10).selectExpr("concat('/b/P', id, '_t1.json') AS path", "to_json(named_struct('take', id, 'n_syl', id * 1.5)) AS content")
    good, bad = readers.parse_takes(raw.unionByName(spark.createDataFrame([("/b/P1_t2.json", "{oops"), ("/b/P1_t3.json", None), ("/b/P1_t4.json", "[1]")], raw.schema)))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    # one branch a source: the document itself and, for what begins as a list, the look whether it is one
    assert plan.count("from_json") <= 2 * plan.count("explode")
    assert good.count() == 10 and {r["path"][-6]: r["error"] for r in bad.collect()} == {
        "2": "take_json_error:JSONDecodeError", "3": "take_json_error:JSONDecodeError", "4": "take_json_error:ValueError"
    }


def test_pitch_scores_have_the_bits_of_the_c_library(spark):
    taxes = [i / 100 for i in range(9)]
    steps = [(t - 4e-2) * 625e-1 / 12e0 for t in taxes]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i int, s double").coalesce(1)
    hz = rows.withColumn("hz", 235.0 * c_exp2(F.col("s")))
    made = hz.select("i", "hz", semitones(F.col("hz"), 235.0, c_log2).alias("level")).orderBy("i").collect()
    assert [r["hz"] for r in made] == [235.0 * 2.0**s for s in steps]
    assert [r["level"] for r in made] == [12.0 * math.log2(235.0 * 2.0**s / 235.0) for s in steps]
    odd = spark.createDataFrame([(0, 0.0), (1, -1.0), (2, None)], "i int, v double").orderBy("i")
    assert [r[0] for r in odd.select(c_log2(F.col("v"))).collect()] == [None, None, None]


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
)


def phrase_tables(phrases=8, takes=5):
    """Orders and lines as phrases and takes; the last phrase has no project, lines share numbers."""
    day = datetime.date(2024, 1, 2)
    orders = [(k, k % 3, "OFP"[k % 3], None if k == phrases - 1 else f"{k % 2}-P") for k in range(phrases)]
    lines = [
        (k, 7 * k + 3 * t, 5 * k + t, 1 + t // 2, 5.0 + 3 * t, 10.0 * t + k, 0.01 * t, 0.01 * (t % 9), "ANR"[t % 3], "FO"[k % 2], day)
        for k in range(phrases) for t in range(takes)
    ]
    return {"orders": (ORDERS, orders), "lineitem": (LINES, lines)}


def test_history_keeps_takes_without_a_project(spark, tmp_path):
    assert check(spark, tmp_path, "take_history", **phrase_tables()) == 40


def optimized(spark, folder, name):
    """The optimized plan's lines as (depth, text)."""
    for table, (schema, rows) in phrase_tables().items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    plan = catalog()[name][0](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    return [(len(line) - len(line.lstrip(" :+-")), line) for line in plan.splitlines()]


@pytest.mark.parametrize("name", ["take_history", "selected_with_features"])
def test_pins_meet_phrases_before_takes(spark, tmp_path, name):
    lines = optimized(spark, tmp_path, name)
    for at, (depth, line) in enumerate(lines):
        if "Join LeftOuter" in line:
            below = itertools.takewhile(lambda entry: entry[0] > depth, lines[at + 1 :])
            assert not [text for _, text in below if "l_orderkey" in text]


def test_newest_rows_carry_no_reasons(spark, tmp_path):
    folds = [line for _, line in optimized(spark, tmp_path, "ranking_training_rows") if "max_by(" in line]
    assert folds and not [line for line in folds if "why" in line]


def test_a_processor_takes_rows_and_gives_no_empty_frames():
    class State:
        def __init__(self):
            self.kept = []

        def appendList(self, rows):
            self.kept += rows

    rule, woken = processors.SentenceBuffer(), []
    rule.waiting, rule._wake = State(), woken.append
    arrived = Row("session_id", "ts", "at", "seq", "sentence_final", "seconds")
    rows = [arrived(7, None, 30 - i, i, i == 2, 0.5) for i in range(3)]
    assert list(rule.handleInputRows((7,), iter(rows), None)) == []
    assert rule.waiting.kept == [(30, 0, False, 0.5), (29, 1, False, 0.5), (28, 2, True, 0.5)] and woken == [28]


def test_a_bank_knows_revisions_without_a_name(spark, tmp_path):
    shape = "project_id string, path string, sha256 string, seq long, block_id string, phrase_id long, take_id int, ok boolean, why array<string>, n_syl double, dur double, tail_delta double, range_st double, pinned_take int, error string"
    row = lambda project, sha, seq: (project, "B/P00_t0.json", sha, seq, "B", 0, 0, True, [], 10.0, 2.0, -2.0, 8.0, 0, None)
    files = spark.createDataFrame([row(None, "a", 2), row(None, "a", 1), row("p", None, 3)], shape)
    store = bank.Bank(spark, str(tmp_path / "bank"))
    counts = lambda stats: {r["project_id"]: (r["inserted"], r["unchanged"], r["errors"]) for r in stats.collect()}
    assert counts(store.ingest(files, None, "r1", ("phrase_id",))) == {None: (1, 1, 0), "p": (1, 0, 0)}
    assert counts(store.ingest(files, None, "r2", ("phrase_id",))) == {None: (0, 2, 0), "p": (0, 1, 0)}
    more = files.unionByName(spark.createDataFrame([row("p", "b", 9)], shape))
    assert counts(store.ingest(more, None, "r3")) == {None: (0, 2, 0), "p": (1, 1, 0)}
    assert sorted((r["project_id"] or "", r["seq"], r["decision"], len(r["revision_id"])) for r in store.table("takes").collect()) == [
        ("", 1, "selected", 64), ("p", 3, "selected", 64), ("p", 9, "selected", 64)]
    # every take is stored once, with the names of its revision
    assert store.table("revisions").count() == 3 and not store.exists("revisions")


def test_a_replay_shuffles_no_take_again(spark):
    files = spark.range(100).selectExpr("id % 10 AS phrase_id", "'p' AS project_id", "concat('f', id) AS path", "'h' AS sha256", "id AS seq", "uuid() AS body").repartition("phrase_id")
    fresh = bank.revisions_not_stored(files, files.where("seq < 60"), ("phrase_id",))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and fresh.count() == 40


def test_blocks_without_a_project_are_guarded(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert check(spark, tmp_path / "a", "guard_proposals", **phrase_tables(23, 6)) == 7
    assert check(spark, tmp_path / "b", "selection_outcome", **phrase_tables(23, 6)) == 6


def test_medians_beyond_a_band(spark):
    rng, nan = random.Random(3), float("nan")
    groups = [[rng.choice([-25.0, -20.0, -19.5, -12.0, -5.0, -4.5, 0.0, nan, None]) for _ in range(n % 7)] for n in range(600)]
    groups += [[-40.0, 0.0], [-20.0, -20.0], [-30.0, -10.0], [-20.1, -20.0], [-10.0, 0.0], [-10.0, 0.1], [nan], [None]]
    rows = spark.createDataFrame([(k, v) for k, values in enumerate(groups) for v in values], "k long, v double")
    median = selection.outside(F.median("v"), (-20.0, -5.0))
    got = rows.groupBy("k").agg(selection.median_outside(F.col("v"), (-20.0, -5.0)).alias("a"), median.alias("b"))
    assert got.where("NOT a <=> b").count() == 0 and got.where("a").count() > 50 and got.where("NOT a").count() > 50


def test_groups_go_through_rounds_as_sentences(spark, monkeypatch):
    seen, whole = [], P.components
    monkeypatch.setattr(P, "components", lambda edges, a, b: seen.append({v for r in edges.collect() for v in r}) or whole(edges, a, b))
    rng = random.Random(8)
    rows = [("p", f"b{rng.randrange(60)}", i, f"s{rng.randrange(70)}") for i in range(75)] + [("p", f"c{i:02d}", 100 + 2 * i + j, f"t{i + j:02d}") for i in range(30) for j in (0, 1)]
    rows += [("a", "lone", 900, "own")]
    got = P.split_groups(spark.createDataFrame(rows, "project_id string, block_id string, phrase_id long, sentence_key string")).collect()
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for project, block, _, sentence in rows:
        a, b = sorted((find(f"block:{project}:{block}"), find(f"sentence:{sentence}")))
        up[b] = a
    assert {r["phrase_id"]: r["split_group"] for r in got} == {k: find(f"block:{p}:{b}") for p, b, k, _ in rows}
    assert all(v.startswith("sentence:") for nodes in seen for v in nodes)


def test_takes_without_a_project_are_judged(spark, tmp_path):
    assert check(spark, tmp_path, "select_eligible", **phrase_tables()) == 40


def test_results_in_a_row_judge_as_rows_do(spark):
    from cuewright.operators import shadow

    text = lambda v: F.lit(v).cast("string")
    takes = spark.createDataFrame([("p", "b", 1, t, s, h) for t, (s, h) in enumerate(itertools.product(("pass", "fail", "unknown", None), (True, False, None)))],
        "project_id string, block_id string, phrase_id long, take_id int, s string, h boolean")
    one = lambda name, status, hard: F.struct(F.lit(name).alias("validator_name"), status.alias("status"), hard.alias("hard_gate"), F.lit(0.5).alias("score"),
        F.array(F.lit("x")).alias("reasons"), F.lit(None).cast("map<string,double>").alias("metrics"))
    row = {"audio_sanity": one("audio_sanity", F.col("s"), F.col("h")), "mos": F.when(F.col("take_id") % 2 == 0, one("mos", text("pass"), F.lit(False)))}
    alive, passed = shadow.survival_in_row(row)
    got = takes.select("take_id", alive.alias("survives"), passed.alias("passed"))
    rows = takes.select(*shadow.TAKE, F.inline(F.array_compact(F.array(*row.values()))))
    want = shadow.survival(takes, rows, with_passed=True).select("take_id", "survives", "passed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_disagreements_are_found_where_takes_lie(spark, tmp_path):
    for table, (schema, rows) in phrase_tables().items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog()["disagreement_reasons"][0](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # lines, phrases and pins are dealt out once; no table is written on the way
    assert plan.count("Exchange ") == 3 and plan.count("FileScan") == 3 and "ExistingRDD" not in plan


@pytest.mark.parametrize("hot", [[], [(k,) for k in (*range(20), None, 99)], None], ids=["none", "some", "all"])
def test_disagreements_of_any_phrase(spark, tmp_path, monkeypatch, hot):
    from cuewright.plans import bindings

    monkeypatch.setattr(bindings, "hot_orders", lambda spark, folder: hot)
    rng, day = random.Random(5), datetime.date(2024, 1, 2)
    orders = [(k, rng.choice([k % 9, None]), rng.choice("OFP"), rng.choice(["1-P", "2-P", None])) for k in range(60)]
    # lines of no order, and of an order that is not there, too
    lines = [
        (k, rng.randrange(20000), rng.randrange(1000), rng.randrange(1, 5), float(rng.randrange(1, 51)), rng.randrange(9000) / 4,
         rng.randrange(11) / 100, rng.randrange(9) / 100, rng.choice("ANR"), rng.choice("FO"), day)
        for k in [*range(60), None, 77] for _ in range(30)
    ]
    assert check(spark, tmp_path, "disagreement_reasons", orders=(ORDERS, orders), lineitem=(LINES, lines)) > 100
