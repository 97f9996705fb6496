"""Pairs, splits, components, the ranker and its artifact."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from cuewright import rules as R
from cuewright.operators import metrics, pairs as P, ranker
from cuewright.operators.ranker import LinearRanker

FEATURES = [f"f_{n}" for n in R.FEATURE_NAMES]


def candidates(spark, projects=2, blocks=5, phrases=5, takes=4, gate=True):
    """The pinned take has the best rate and range; the stored baseline prefers the others."""
    rows = []
    for p in range(projects):
        for b in range(blocks):
            for q in range(phrases):
                for k in range(takes):
                    best = k == q % takes
                    rows.append(
                        (f"P{p}", f"B{p}{b}", f"{q}", k, f"text {p} {b} {q}", "question" if q == 0 else "plain", "selected" if best else "not_selected",
                         gate, -5.0 if best else 5.0, {"rate": 6.5 if best else 5.0 + 0.1 * k, "range_st": 9.0 if best else 5.0 + k, "mos": 3.0 + 0.1 * k})
                    )
    df = spark.createDataFrame(
        rows, "project_id string, block_id string, phrase_id string, take_id int, text string, sentence_class string, decision string, "
        "hard_gate_pass boolean, baseline_score double, features map<string,double>")
    return P.extract_features(P.normalise(df))


def test_sufficiency_and_fail_closed(spark):
    c = candidates(spark).cache()
    row = P.sufficiency(c, P.build(c, FEATURES), FEATURES).first()
    assert (row["status"], row["pinned_phrase_count"], row["pair_count"], row["block_count"]) == ("sufficient", 50, 150, 10)
    assert row["class_counts"] == {"plain": 40, "question": 10} and row["feature_missing_rate"] == pytest.approx(11 / 14)
    shut = candidates(spark, gate=False)
    row = P.sufficiency(shut, P.build(shut, FEATURES), FEATURES).first()
    assert row["status"] == "insufficient_data" and row["pair_count"] == 0 and row["feature_missing_rate"] is None
    assert row["warnings"] == ["project_holdout_unavailable", "feature_missing_rate_not_measurable"]


def test_no_pairs_from_two_picks_or_unknown(spark):
    c = candidates(spark, 1, 1, 2, 4)
    two = c.withColumn("decision", F.when((F.col("phrase_id") == "0") & (F.col("take_id") < 2), "selected").otherwise(F.col("decision")))
    assert {r["phrase_id"] for r in P.build(two, FEATURES).collect()} == {"1"}
    assert P.build(c.withColumn("decision", F.lit("unknown")), FEATURES).count() == 0
    rejected = c.withColumn("decision", F.when(F.col("decision") == "not_selected", "rejected").otherwise(F.col("decision")))
    assert P.build(rejected, FEATURES).count() == 0


def test_training_on_the_fixture(spark):
    c = candidates(spark).cache()
    out = ranker.train(c)
    assert out["status"] == "trained"
    report = {r["scope"]: r for r in out["evaluation"]["grouped_holdout"].collect()}
    overall = report["all"]
    assert (overall["pairwise_accuracy"], overall["pin_top1_accuracy"], overall["mrr"], overall["ndcg"]) == (1.0, 1.0, 1.0, 1.0)
    assert overall["pair_count"] == 30 and overall["brier_score"] < 0.01
    assert out["evaluation"]["baseline"].first()["baseline_accuracy"] == 0.0
    assert {r["scope"] for r in out["evaluation"]["project_holdout"].collect()} == {"all", "plain", "question"}
    again = ranker.train(c)["model"]
    assert again.weights == pytest.approx(out["model"].weights, abs=1e-6)


def test_split_never_leaks(spark):
    pairs = P.build(candidates(spark), FEATURES)
    shared = pairs.withColumn("sentence_key", F.when(F.col("phrase_id") == "1", F.lit("same")).otherwise(F.col("sentence_key")))
    one = P.cut_lineage(P.split_groups(shared))
    assert one.select("split_group").distinct().count() == 1 and P.test_groups(one).count() == 0
    grouped = P.cut_lineage(P.split_groups(pairs))
    train, test = P.grouped_split(grouped)
    assert train.count() + test.count() == 150 and test.count() == 30
    assert P.leakage(train, test).count() == 0 and P.leakage(train, train).count() > 0


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(f"b{rng.randrange(90)}", f"s{rng.randrange(110)}") for _ in range(95)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    edges += [("hub", f"leaf{i}") for i in range(300)]
    got = P.components(spark.createDataFrame(edges, "l string, r string"), "l", "r").collect()
    assert {r["node"]: r["root"] for r in got} == union_find(edges)


def descend(rows, l2, rounds=4000, rate=0.5):
    """Plain gradient descent on the same loss."""
    w = [0.0] * len(rows[0])
    for _ in range(rounds):
        g = [l2 * x for x in w]
        for d in rows:
            e = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, d)))) - 1
            g = [a + e * b / len(rows) for a, b in zip(g, d)]
        w = [a - rate * b for a, b in zip(w, g)]
    return w


def test_fit_agrees_with_gradient_descent(spark):
    rng = random.Random(9)
    rows = [(f"p{i}", "b", "q", 0, 1, *(rng.gauss(0.4, 1) for _ in range(2)), *(rng.gauss(0, 1) for _ in range(2))) for i in range(80)]
    df = spark.createDataFrame(rows, "project_id string, block_id string, phrase_id string, w_take int, l_take int, w_f_a double, w_f_mos_score double, l_f_a double, l_f_mos_score double")
    model = ranker.fit(df, ("a", "mos_score"), l2=0.02, mos_multiplier=1.0)
    scaled = [[(r[5] - r[7]) / model.scales[0], (r[6] - r[8]) / model.scales[1]] for r in rows]
    assert model.weights == pytest.approx(descend(scaled, 0.02), abs=5e-3)
    strict = ranker.fit(df, ("a", "mos_score"), l2=0.02, mos_multiplier=8.0)
    assert abs(strict.weights[1]) < abs(model.weights[1])


def test_rank_excludes_and_reports_confidence(spark):
    m = LinearRanker(("a",), (0.0,), (1.0,), (1.0,))
    rows = [("p", "b", "1", 0, True, 3.0), ("p", "b", "1", 1, True, 1.0), ("p", "b", "1", 2, False, 9.0), ("p", "b", "2", 5, True, None)]
    df = spark.createDataFrame(rows, "project_id string, block_id string, phrase_id string, take_id int, hard_gate_pass boolean, f_a double")
    got = {(r["phrase_id"], r["take_id"]): r for r in ranker.rank(df, m).collect()}
    assert got[("1", 0)]["rank"] == 1 and got[("1", 0)]["confidence"] == pytest.approx((1 / (1 + math.exp(-2)) - 0.5) * 2)
    assert got[("1", 2)]["status"] == "excluded" and got[("1", 2)]["reason"] == "hard_gate_not_pass"
    assert got[("2", 5)]["confidence"] == 0.0 and got[("2", 5)]["reduction_allowed"] is False


def test_artifact_refusals(spark, tmp_path):
    n = len(R.FEATURE_NAMES)
    model = LinearRanker(R.FEATURE_NAMES, (0.0,) * n, (1.0,) * n, (0.1,) * n)
    good = ranker.artifact(model, "d")

    def attempt(payload):
        path = str(tmp_path / uuid.uuid4().hex)
        ranker.save(spark, payload, path)
        return ranker.load(spark, path)

    loaded, status = attempt(good)
    assert status == "active" and loaded == model
    broken = lambda **kw: {**good, "model": {**good["model"], **kw}}
    assert ranker.load(spark, str(tmp_path / "none"))[1].startswith("artifact_unreadable")
    assert attempt({**good, "artifact_schema_version": "x"})[1] == "artifact_schema_mismatch"
    assert attempt(ranker.artifact(None))[1] == "insufficient_data"
    assert attempt({**good, "feature_schema_hash": "x"})[1] == "feature_schema_mismatch"
    assert attempt(broken(scales=[0.0] * n))[1] == "invalid_model:ValueError"
    assert attempt(broken(names=list(reversed(R.FEATURE_NAMES))))[1] == "model_feature_schema_mismatch"
    assert attempt(broken(model_version="other"))[1] == "model_version_mismatch"
    with pytest.raises(Exception):
        path = str(tmp_path / "twice")
        ranker.save(spark, good, path)
        ranker.save(spark, good, path)
    assert ranker.schema_hash() == ranker.schema_hash(R.FEATURE_NAMES) != ranker.schema_hash(("a",))
    assert json.dumps(good)


def test_hot_phrase_ranks(spark):
    rows = [("p", "b", "c", i, 0, float(i % 7), 3.0) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "project_id string, block_id string, phrase_id string, l_take int, w_take int, u_l double, u_w double").withColumn("sentence_class", F.lit("x"))
    assert metrics.winner_ranks(df).first()["winner_rank"] == 1 + sum(i % 7 > 3 for i in range(1, 500))
