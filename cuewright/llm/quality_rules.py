"""Quality rules as a short-circuit cascade of native expressions.

Every rule is one boolean column over the base statistics or the text. On a
sample, each rule is run alone: its time per row is its cost, the share of rows
it rejects its selectivity. The cascade asks the rules in the order of
rejection per cost, and a row that is rejected is not looked at further: the
rules form one CASE, whose branches are evaluated lazily. The order never
changes a verdict, only the work.

Null text has no words. A row of fewer than ``min_words`` words fails. Repeated
rows are judged alike, an empty table gives an empty result. Columns of the
input whose names clash with an output are replaced, others pass through.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a word, as a symbol, and the window of a repeat.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL expression over the table that base_statistics returns."""

    name: str
    rejects: str


#: Production rules, in the order in which they are listed when all cost the same.
RULES = (
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * size(split(text, '\\n', -1))"),
    Rule("shouting", "100 * regexp_count(text, '\\\\p{Lu}') > 50 * word_chars"),
    Rule("stutter", "100 * n_echoes > 15 * n_words"),
)


def widened(column: str, width: int) -> Column:
    """Hashes of windows twice as wide; the last ``width`` entries have no partner and are no windows."""
    source = F.col(column)
    return F.transform(
        F.slice(source, F.lit(1), F.greatest(F.size(source) - width, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(source, i + width)),
    )


def base_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five statistics to every row; each step is one projection, so nothing is computed twice.

    Hashes of windows grow by doubling (2, 4, 8 words). Only where a hash occurs
    twice are the windows of a row sorted to find their places.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    out = df.drop(*STATS).withColumn("_words", F.regexp_extract_all(value, F.lit(WORD), F.lit(0)))
    out = out.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        out = out.withColumn(f"_h{2 * width}", widened(f"_h{width}", width))
    repeated = F.size(F.array_distinct("_h8")) < F.size("_h8")
    out = out.withColumn(
        "_sorted",
        F.when(repeated, F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    here = F.col("_sorted")
    out = out.withColumn(
        "_places",
        F.sort_array(
            F.transform(
                F.filter(
                    here,
                    lambda w, i: w["h"].eqNullSafe(F.get(here, i - 1)["h"]) | w["h"].eqNullSafe(F.get(here, i + 1)["h"]),
                ),
                lambda w: w["i"],
            )
        ),
    )
    places = F.col("_places")
    out = out.withColumn("_low", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(value, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_echoes": F.size(
                F.filter("_low", lambda w, i: (i > 0) & w.eqNullSafe(F.get(F.col("_low"), i - 1)))
            ).cast("long"),
            "n_repeat_words": F.coalesce(
                F.aggregate(
                    F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
                F.lit(0).cast("long"),
            ),
        }
    ).drop("_words", "_h1", "_h2", "_h4", "_h8", "_sorted", "_places", "_lines", "_low")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def measure(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7) -> list[dict]:
    """Cost and selectivity of every rule on a sample of about ``sample_rows`` rows.

    The sample decides the order of the rules and nothing else.
    """
    total = df.count()
    if not total:
        return [{"rule": r.name, "cost": 1.0, "rejects": 0.0} for r in rules]
    rows = base_statistics(df.sample(min(1.0, sample_rows / total), seed=seed)).persist()
    try:
        n = max(1, rows.count())

        def timed(condition: str) -> tuple[float, int]:
            start = time.perf_counter()
            hits = rows.agg(F.count_if(F.expr(condition))).first()[0]
            return time.perf_counter() - start, hits

        timed("true")  # compiled once, so that the first rule does not pay for it
        floor = timed("true")[0]
        found = []
        for rule in rules:
            seconds, hits = min(timed(rule.rejects) for _ in range(2))
            found.append({"rule": rule.name, "cost": max(seconds - floor, 1e-4) / n, "rejects": hits / n})
        return found
    finally:
        rows.unpersist()


def ordered(rules: tuple[Rule, ...], figures: list[dict]) -> list[Rule]:
    """Rules by rejection per cost, best first; ties keep their listed order."""
    worth = {f["rule"]: f["rejects"] / f["cost"] for f in figures}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(rules: list[Rule], fails_first: Column | None = None) -> Column:
    """Name of the first rule that rejects, or null. A null answer of a rule does not reject."""
    first = F.when(fails_first, F.lit("base")) if fails_first is not None else F.when(F.lit(False), F.lit(""))
    for rule in rules:
        first = first.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(rule.name))
    return first


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """All rows with their statistics, ``base_failed``, ``rejected_by`` and ``kept``."""
    named = df if text == "text" else df.withColumn("text", F.col(text))
    stats = base_statistics(named)
    order = ordered(rules, measure(named, rules, sample_rows))
    judged = stats.drop("base_failed", "rejected_by", "kept").withColumn("base_failed", base_failed())
    return judged.withColumn("rejected_by", cascade(order, F.col("base_failed"))).withColumn("kept", F.col("rejected_by").isNull())
