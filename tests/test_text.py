"""Literal examples for text, numbers, phrases, alignment and content gates."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import korean as K, text as X
from cuewright.operators import content


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("2024년, 10kg", "이천이십사 년 십 킬로그램"),
        ("3.5% 증가", "삼 점 오 퍼센트 증가"),
        ("GPU기반 설계", "지 피 유 기반 설계"),
        ("GPU 성능", "지 피 유 성능"),
        ("-7 x2 100", "마이너스 칠 x2 백"),
        ("１２만", "12만"),
        ("", ""),
    ],
)
def test_normal_form(text, spoken):
    assert K.normalise_text(text) == spoken


@pytest.mark.parametrize(
    "digits, reading", [("0", "영"), ("10", "십"), ("11", "십일"), ("1858", "천팔백오십팔"), ("10000", "일만"), ("120003", "십이만 삼"), ("100000000", "일억")]
)
def test_numbers(digits, reading):
    assert K.read_integer(digits) == reading


def test_long_digit_runs_are_read_digit_by_digit():
    assert K.read_integer("1" * 17) == " ".join(["일"] * 17)
    assert len(K.normalise_text("7" * 5000).split()) == 5000


def test_white_space_is_no_text(spark):
    rows = spark.createDataFrame([("\n\t ", None), ("x", "q"), ("x", None)], "text string, seed string").selectExpr("*", "'o.wav' output_wav", "'fast' mode", "'r' request_id", "'B' block_id")
    from cuewright.operators import gates

    assert [r["error"] for r in gates.validate_requests(rows).collect()] == ["text_missing", "seed_no_integer", None]


def slow_align(expected, actual):
    grid = {(0, j): (0, 0, j, 0) for j in range(len(actual) + 1)}
    grid.update({(i, 0): (i, i, 0, 0) for i in range(1, len(expected) + 1)})
    for i, e in enumerate(expected, 1):
        for j, a in enumerate(actual, 1):
            d, n, s = grid[i - 1, j], grid[i, j - 1], grid[i - 1, j - 1]
            x = int(e != a)
            options = [(d[0] + 1, d[1] + 1, d[2], d[3]), (n[0] + 1, n[1], n[2] + 1, n[3]), (s[0] + x, s[1], s[2], s[3] + x)]
            grid[i, j] = min(options, key=lambda o: o[0])
    return grid[len(expected), len(actual)]


def test_alignment_against_plain_table():
    rng = random.Random(5)
    for _ in range(400):
        e, a = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        assert K.align_tokens(e, a) == slow_align(e, a)


def test_phrases_of_a_script():
    text = "위성은 외딴 곳과 비상 연결을 돕지만 대륙 사이 대규모 데이터는 주로 해저 광섬유가 맡죠. 해외로 가는 데이터, 위성으로 갈까요."
    assert K.phrase_rows(text) == [
        ("위성은 외딴 곳과 비상 연결을 돕지만", False, False),
        ("대륙 사이 대규모 데이터는 주로 해저 광섬유가 맡죠.", True, False),
        ("해외로 가는 데이터", False, False),
        ("위성으로 갈까요.", True, False),
    ]


def test_long_phrase_is_forced_at_a_good_ending():
    rows = K.phrase_rows("가나다라마바사아자 차카타파하가나다라어 마바사아자차카타파하.")
    assert [(r[0][-1], r[2]) for r in rows] == [("어", True), (".", False)] and rows[-1][1]
    assert "".join(r[0] for r in rows).replace(" ", "") == "가나다라마바사아자차카타파하가나다라어마바사아자차카타파하."


def test_phrases_are_lossless():
    rng = random.Random(2)
    for _ in range(60):
        words = ["".join(rng.choice("가나고서며면데만다에서한된어과일이삼") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", ", ", ". "]) for w in words) + "끝."
        rows = K.phrase_rows(text)
        kept = "".join(r[0] for r in rows)
        assert [c for c in kept if "가" <= c <= "힣"] == [c for c in text if "가" <= c <= "힣"]
        assert all(K.count_syllables(r[0]) <= 22 or " " not in r[0] or r[2] for r in rows)


def test_sentence_columns(spark):
    assert one(spark, "1. 하나. 둘. abc", X.sentences) == ["1. 하나.", "둘.", "abc"]
    assert one(spark, " One. Two!? 셋。넷 ", X.sentences_multi) == ["One.", "Two!?", "셋。", "넷"]
    assert one(spark, "title\nBody.", X.sentences_multi) == ["title\nBody."]
    assert one(spark, "a b.  c!d\n\n e f ", X.batch_lines) == ["a b.", "c!d", "e f"]
    long = "가" * 50 + ", " + "나" * 40 + ", " + "다" * 20
    assert one(spark, long, X.clauses) == ["가" * 50 + ",", "나" * 40 + ", " + "다" * 20]
    assert one(spark, "no boundary", X.clauses) == ["no boundary"]


def test_small_columns(spark):
    assert one(spark, "천팔백 오십팔 년", X.numeral_heavy) is True
    assert one(spark, "갈까요. .", X.is_question) is True and one(spark, "갈까요?", X.is_question) is False
    assert one(spark, "갈까요?", X.is_question_shadow) is True and one(spark, "간다? ", X.is_question_shadow) is True
    assert one(spark, "끊어진 굳힌다는?", X.respell) == "끄너진 구친다는."
    assert one(spark, "_a b-1!", X.audible) == 3
    assert one(spark, "a b", X.safe_id).startswith("a_b-") and one(spark, "ok-1", X.safe_id) == "ok-1"
    assert one(spark, "", X.safe_id).startswith("block-")


CASES = [
    ("하늘은 오늘 출발합니다.", "하늘은 오늘 출발합니다", [], "pass", []),
    ("하늘은 오늘 서울에서 출발합니다", "하늘은 오늘 출발합니다", ["서울"], "pass", ["content_mismatch", "critical_term_missing"]),
    ("하늘은 출발합니다", "하늘은 출발합니다 지금", [], "pass", ["content_mismatch", "unexpected_continuation"]),
    ("하늘은 출발합니다", "하늘은 출발합니다 출발합니다", [], "pass", ["content_mismatch", "unexpected_repetition", "unexpected_continuation"]),
    ("3.5% 증가", "삼 점 오 퍼센트 증가", ["3.5%"], "pass", []),
    ("하늘", "", [], "unknown", ["asr_exception:RuntimeError"]),
]


def test_content_gate(spark):
    rows = [(i, e, a, c, s, "asr_exception:RuntimeError" if s != "pass" else None) for i, (e, a, c, s, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, expected string, actual string, critical_terms array<string>, asr_status string, asr_reason string")
    got = content.content_gate(content.missing_terms(content.compare(df))).orderBy("i").collect()
    assert [r["reasons"] for r in got] == [c[4] for c in CASES]
    assert [r["status"] for r in got] == ["pass", "fail", "fail", "fail", "pass", "unknown"]
    assert got[1]["deletions"] == 1 and got[2]["insertions"] == 1


def test_rules_keep_the_last_good_document(spark):
    good = '{"schema_version":"fast-speaker-rules/1","rules_version":" v2 ","text_replacements":{"b":"c","a":"b"}}'
    docs = [(1, good), (2, good.replace('"b":"c"', '"":"c"')), (3, good.replace("}}", '},"seed":1}')), (4, "nope")]
    rules = content.active_rules(spark.createDataFrame(docs, "loaded_at int, document string"))
    out = content.overlay(spark.createDataFrame([("ab",)], "text string"), rules).first()
    assert (out["rules_version"], out["text"]) == ("v2", "bc")
    none = content.active_rules(spark.createDataFrame([(1, "{}")], "loaded_at int, document string")).first()
    assert none["rules_version"] == "built-in-noop"
