import random
import tracemalloc

import numpy as np
import pytest

from cuewright.llm import quality_classifier as Q
from cuewright.llm.queries import graded_labels, table


def test_fit_finds_the_weights_of_its_own_model():
    r = np.random.default_rng(3)
    n, weights, cuts = 6000, np.array([2.0, -3.0, 0.0]), np.array([-1.0, 1.5])
    rows, columns = np.nonzero(r.random((n, 3)) < 0.5)
    latent = np.bincount(rows, weights=weights[columns], minlength=n) + r.logistic(size=n)
    grades = (latent[:, None] > cuts[None, :]).sum(axis=1)
    w, b = Q.fit_ordinal(rows, columns, grades, 3)
    assert np.abs(w - weights).max() < 0.3 and np.abs(b - cuts).max() < 0.3 and b[0] < b[1]


def test_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"), graded_labels(spark, "/root/testdata/sf0.1")
    model = Q.fit(docs, labels.where("doc_id % 5 <> 0"))
    found = Q.grade_documents(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").groupBy("grade").agg(Q.F.avg(Q.F.col("kept").cast("double")).alias("kept"))
    shares = {r["grade"]: r["kept"] for r in found.collect()}
    assert shares[2] > 0.98 and shares[1] < 0.1 and shares[0] < 0.1


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 2)], [(1, 2), (2, 2)]])
def test_too_few_labels_keep_all(spark, labels):
    df = spark.createDataFrame([(1, "a b", 0.5), (2, None, None), (None, "", 0.1)], "doc_id long, text string, tail double")
    model = Q.fit(df, spark.createDataFrame(labels, "doc_id long, grade int"))
    got = Q.grade_documents(df, model).collect()
    assert [r["kept"] for r in got] == [True] * 3 and (labels[1:] == [(2, 2)] or [r["tail"] for r in got] == [None] * 3)
    assert Q.grade_documents(df.limit(0), model).count() == 0


def test_odd_texts_and_ties(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("the of and is to".split()) for _ in range(20)) + (" awful" if i % 2 else ""), i % 2) for i in range(200)]
    df = spark.createDataFrame([x[:2] for x in rows] + [(500, None), (501, ""), (502, "awful " * 50_000), (502, "awful " * 50_000)], "doc_id long, text string")
    model = Q.fit(df, spark.createDataFrame([(i, 2 * (1 - g)) for i, _, g in rows], "doc_id long, grade int"))
    got = Q.grade_documents(df, model).collect()
    assert len(got) == 204 and all(x["kept"] == (x["doc_id"] % 2 == 0) for x in got if x["doc_id"] < 200)
    assert len({x["tail"] for x in got if x["doc_id"] == 502}) == 1


def test_features_that_take_no_part_stay_off_the_driver(spark):
    n, each = 3000, 300
    noise = Q.F.array_join(Q.F.transform(Q.F.sequence(Q.F.lit(1), Q.F.lit(each)), lambda i: Q.F.concat(Q.F.lit("w"), Q.F.hex(Q.F.xxhash64("doc_id", i)))), " ")
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", Q.F.when(Q.F.col("doc_id") % 2 == 0, Q.F.concat(noise, Q.F.lit(" awful"))).otherwise(noise))
    labels = docs.select("doc_id", (2 * (docs.doc_id % 2)).alias("grade"))
    tracemalloc.start()
    try:
        model = Q.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # one array of all pairs has 8 bytes for each
    assert most < 8 * n * each
    got = Q.grade_documents(docs, model).where("kept <> (doc_id % 2 = 1)")
    assert len(model.chosen) < 100 and got.count() == 0
