"""Two-level scans against plain windows, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", rng.randrange(400), i, rng.randrange(-50, 50) / 4) for i in range(1500)]
    return spark.createDataFrame(data, "k string, t long, id long, v double").cache()


def same(a, b, cols):
    left, right = (sorted(map(tuple, df.select(*cols).collect()), key=str) for df in (a, b))
    assert left == right


def test_number_rows(rows):
    got = O.number_rows(rows, ["k"], [F.col("t"), F.col("id")], [F.floor(F.col("t") / 10)], "n")
    want = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("t", "id")))
    same(got, want, ["k", "id", "n"])


def test_number_rows_without_keys(rows):
    got = O.number_rows(rows, [], [F.col("t"), F.col("id")], [F.floor(F.col("t") / 10)], "n")
    want = rows.withColumn("n", F.row_number().over(W.orderBy("t", "id")))
    same(got, want, ["id", "n"])


def test_previous_row(rows):
    got = O.previous_row(rows, ["k"], ["t", "id"], [F.floor(F.col("t") / 7)], {"pv": "v", "pid": "id"})
    w = W.partitionBy("k").orderBy("t", "id")
    want = rows.withColumn("pv", F.lag("v").over(w)).withColumn("pid", F.lag("id").over(w))
    same(got, want, ["k", "id", "pv", "pid"])


def test_running_before(rows):
    totals = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "z": ("min", F.when(F.col("v") > 0, F.col("v")))}
    got = O.running_before(rows, ["k"], [F.col("t"), F.col("id")], [F.floor(F.col("t") / 25)], totals)
    w = W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    want = rows.withColumns(
        {"s": F.coalesce(F.sum("v").over(w), F.lit(0)), "m": F.max("v").over(w), "z": F.min(F.when(F.col("v") > 0, F.col("v"))).over(w)}
    )
    same(got, want, ["k", "id", "s", "m", "z"])


def test_exact_quantiles(rows):
    got = O.exact_quantiles(rows, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}, 2.0)
    want = rows.groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("a", 0.1), ("b", 0.5), ("c", 0.93))])
    for g, w in zip(sorted(got.select("k", "a", "b", "c").collect()), sorted(want.collect())):
        assert g[0] == w[0] and all(abs(x - y) < 1e-9 for x, y in zip(g[1:], w[1:]))


def test_fold_keeps_state_across_arrow_batches(spark, rows):
    def fold():
        state = {"key": None, "sum": 0.0}

        def handle(key, part):
            if key != state["key"]:
                state.update(key=key, sum=0.0)
            out = []
            for _, i, v in part:
                state["sum"] += v
                out.append((*key, i, state["sum"]))
            return out

        return handle

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = O.ordered_fold(rows, ["k"], ["t", "id"], fold, "k string, id long, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.withColumn("s", F.sum("v").over(W.partitionBy("k").orderBy("t", "id"))).select("k", "id", "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_hot_keys_take_the_chunked_plan_and_agree(rows):
    found = O.hot_keys(rows, ["k"], min_rows=300)
    assert found == [("hot",)] and O.hot_keys(rows, ["k"]) == []
    assert O.hot_keys(rows, ["k"], min_rows=1, most=3) is None
    w = W.partitionBy("k").orderBy("t", "id")
    order, chunk = [F.col("t"), F.col("id")], [F.floor(F.col("t") / 10)]
    for hot in (None, [], found):
        same(O.number_rows(rows, ["k"], order, chunk, "n", hot), rows.withColumn("n", F.row_number().over(w)), ["k", "id", "n"])
        same(O.previous_row(rows, ["k"], ["t", "id"], chunk, {"p": "v"}, hot), rows.withColumn("p", F.lag("v").over(w)), ["k", "id", "p"])
        both = rows.withColumns({"n": F.row_number().over(w), "x": F.lead("v").over(w)})
        same(O.number_with_next(rows, ["k"], order, chunk, "n", {"x": "v"}, hot), both, ["k", "id", "n", "x"])
        got = O.running_before(rows, ["k"], order, chunk, {"s": ("sum", F.col("v"))}, hot)
        want = rows.withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        same(got, want, ["k", "id", "s"])


def test_hot_pairs_of_columns(rows):
    two = rows.withColumn("g", F.col("id") % 2)
    found = O.hot_keys(two, ["k", "g"], min_rows=300)
    assert sorted(found) == [("hot", 0), ("hot", 1)]
    got = O.number_rows(two, ["k", "g"], [F.col("t"), F.col("id")], [F.floor(F.col("t") / 10)], "n", found)
    same(got, two.withColumn("n", F.row_number().over(W.partitionBy("k", "g").orderBy("t", "id"))), ["k", "id", "n"])


def test_null_keys_and_null_order(spark):
    data = [(None if i % 5 == 0 else f"k{i % 3}", i % 2, None if i % 7 == 0 else i % 90, i, float(i)) for i in range(400)]
    rows = spark.createDataFrame(data, "k string, g long, t long, id long, v double")
    for keys, hot in ((["k"], [(None,), ("k1",)]), (["k", "g"], [(None, 1), ("k2", 0)])):
        w = W.partitionBy(*keys).orderBy("t", "id")
        order, chunk = [F.col("t"), F.col("id")], [F.floor(F.col("t") / 10)]
        want = rows.withColumns({"n": F.row_number().over(w), "p": F.lag("v").over(w), "s": F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
        for plan in (None, [], hot):
            same(O.number_rows(rows, keys, order, chunk, "n", plan), want, ["id", "n"])
            same(O.previous_row(rows, keys, ["t", "id"], chunk, {"p": "v"}, plan), want, ["id", "p"])
            following = O.number_with_next(rows, keys, order, chunk, "n", {"x": "v"}, plan)
            same(following, want.withColumn("x", F.lead("v").over(w)), ["id", "n", "x"])
            same(O.running_before(rows, keys, order, chunk, {"s": ("sum", F.col("v"))}, plan), want, ["id", "s"])
            near = O.quantile_neighbours(rows, keys, "v", {"m": 0.5}, 10.0, plan).agg(F.sum("_count")).first()[0]
            assert near == 400


def test_running_in_order_over_sampled_ranges(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "bb", "hot", "hot", "hot"]), rng.choice([None, *range(40)]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(7)
    first = lambda x: (x is not None, x if x is not None else 0)
    ordered = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), first(r[1]), r[2]))
    got = {r["i"]: r["n"] for r in O.number_in_order(df, ["k", "o", "i"], "n").collect()}
    assert got == {r[2]: n for n, r in enumerate(ordered, 1)}
    sums, want = {}, {}
    for k, _, i, v in ordered:
        want[i] = sums.get(k, 0)
        sums[k] = want[i] + v
    per_key = O.running_in_order(df, ["k", "o", "i"], {"s": F.col("v")}, ["k"])
    assert {r["i"]: r["s"] for r in per_key.collect()} == want and per_key.columns == ["k", "o", "i", "v", "s"]
    assert O.number_in_order(df.limit(0), ["k", "o", "i"], "n").count() == 0


def test_digest_of_multisets(spark):
    from pyspark.sql import functions as F

    from cuewright.operators.digest import table_digest

    digest = lambda values: tuple(table_digest(spark.createDataFrame([(v,) for v in values], "v string").repartition(3), F.coalesce("v", F.lit("null"))).first())
    same = digest(["x", "y", "y", None])
    assert same == digest(["y", None, "x", "y"]) and same[1] == 4
    assert len({same, digest(["x", "y", None]), digest(["x", "x", "y", None]), digest([]), digest(["x", "y", "y", "null", "z"])}) == 5
    assert table_digest(spark.createDataFrame([(None, "a")], "k string, v string"), F.col("v"), ["k"]).columns == ["k", "digest", "n_rows"]
