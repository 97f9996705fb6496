import re

from cuewright.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(Q.WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(Q.WORD, x)]
    echoes = sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), echoes


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h i", "a b c d e f g h a b c d e f g h", "w " * 400, "x y\nx y\n\nx y \n", "é漢 #*$ <|> %&",
    "the cat sat on the mat and then it ran away from all of us here today " * 2, "LOUD WORDS " * 30, "\u2003wide blank\u00a0stays", "v" * 5000,
    " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i % 9}" for i in range(100)), "one two\x0bthree\x0cfour\r\nfive",
]


def test_statistics_agree_with_a_plain_count(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: tuple(r[c] for c in Q.STATS) for r in Q.base_statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS * 2)}


def test_order_changes_no_verdict(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    stats = Q.base_statistics(df).withColumn("base_failed", Q.base_failed())
    ways = [stats.withColumn("by", Q.cascade(order, Q.F.col("base_failed"))).select("doc_id", "by") for order in (list(Q.RULES), list(Q.RULES)[::-1])]
    one, two = ({r["doc_id"]: r["by"] for r in w.collect()} for w in ways)
    assert {k for k, v in one.items() if v is None} == {k for k, v in two.items() if v is None}
    judged = {r["doc_id"]: r["kept"] for r in Q.judge(df).collect()}
    assert {k for k, v in judged.items() if v} == {k for k, v in one.items() if v is None} and judged[13]


def test_order_is_rejection_per_cost():
    figures = [{"rule": r.name, "cost": 1.0, "rejects": 0.1 * i} for i, r in enumerate(Q.RULES)]
    assert [r.name for r in Q.ordered(Q.RULES, figures)] == [r.name for r in Q.RULES][::-1]


def test_empty(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
