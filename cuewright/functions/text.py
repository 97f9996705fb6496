"""Text rules as column expressions, on whole texts.

Patterns use only syntax that Java regular expressions and RE2 share, so that
SQL twins can use them too; SENTENCE_START is for Java alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R

# What counts as white space, a line end, a sentence end, a clause boundary.
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
ENDERS = ".!?。！？"
CLAUSE_BOUNDARY = r"[,;:，；：]" + WS + r"*|(?:지만|는데|으며|하고|해서|라서|하면|다면)" + WS + "+"
SENTENCE = rf"[^{ENDERS}\n]+(?:[{ENDERS}]+|\z)"
# The same matches in linear time: a run of text without an end is tried once, not from each of its characters.
SENTENCE_START = rf"(?<![^{ENDERS}\n])[^{ENDERS}\n]++(?:[{ENDERS}]+|\z)"
FIRST_SENTENCE = r"(?s)[^가-힣]*[가-힣][^.]*\.|.+\z"
SOFT_LIMIT = 80
MARK = "\x01"

# Limits of one generation job.
MAX_TEXT_TOKENS = 2048
FRAMING_TOKENS = 2
MAX_ESTIMATED_SECONDS = 32.0
MIN_SECONDS = 0.25
CHARS_PER_SECOND = 4.0


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def audible(c: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def syllables(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[가-힣]"))


def numeral_heavy(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, R.NUMERAL_CHARS, "")) >= 3


def is_question(c: Column) -> Column:
    """Production rule: ends in a question ending once dots and blanks are dropped."""
    return c.rlike("(?:" + "|".join(R.QUESTION_ENDINGS) + r")[. ]*\z")


def is_question_shadow(c: Column) -> Column:
    """Evaluation rule: a final question mark, or the ending under any closing marks."""
    return c.rlike(rf"\?{WS}*\z") | c.rlike("(?:" + "|".join(R.QUESTION_ENDINGS) + rf")[.?!…]*{WS}*\z")


def respell(c: Column) -> Column:
    for old, new in R.RESPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.replace(c, F.lit("?"), F.lit("."))


def _kept(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Cut after a full stop once the piece holds a Hangul syllable; the tail is kept."""
    return _kept(F.regexp_extract_all(c, F.lit(FIRST_SENTENCE), 0))


def sentences_multi(c: Column) -> Column:
    """Cut at sentence ends of several scripts; the whole text where cutting would lose any of it."""

    def cut(text: Column) -> Column:
        def checked(found: Column) -> Column:
            whole = compact(F.array_join(found, "")) == compact(text)
            return F.when((F.size(found) > 0) & whole, found).otherwise(F.array(text))

        return bind(_kept(F.regexp_extract_all(text, F.lit(SENTENCE_START), 0)), checked)

    return bind(strip(c), cut)


def clauses(c: Column, limit: int = SOFT_LIMIT) -> Column:
    """Cut after clause boundaries, then regroup neighbours up to the audible limit."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size")
    )

    def step(acc: Column, piece: Column) -> Column:
        # letters and digits of a joined text are the sum of those of its parts
        more = audible(piece)
        full = (acc["open"] != "") & (acc["size"] + more > limit)
        joined = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(" "), piece))
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full, piece).otherwise(joined).alias("open"),
            F.when(full, more).otherwise(acc["size"] + more).alias("size"),
        )

    def regroup(pieces: Column) -> Column:
        grouped = F.aggregate(pieces, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))
        return F.when(F.size(pieces) < 2, F.array(strip(c))).otherwise(grouped)

    marked = F.regexp_replace(c, f"({CLAUSE_BOUNDARY})", "$1" + MARK)
    return bind(_kept(F.split(marked, MARK)), regroup)


def batch_lines(c: Column) -> Column:
    """Non-empty lines, each cut after sentence ends followed by white space."""
    lines = _kept(F.split(c, LINE_END))
    cut = F.transform(lines, lambda line: F.split(F.regexp_replace(line, rf"([{ENDERS}]){WS}+", "$1" + MARK), MARK))
    return _kept(F.flatten(cut))


def token_bound(c: Column) -> Column:
    return F.octet_length(c) + FRAMING_TOKENS


def estimated_seconds(c: Column) -> Column:
    return F.bround(F.greatest(F.lit(MIN_SECONDS), audible(c) / CHARS_PER_SECOND), 3)


def safety_reasons(c: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(token_bound(c) > MAX_TEXT_TOKENS, F.lit("conservative_text_token_upper_bound_exceeded")),
            F.when(estimated_seconds(c) > MAX_ESTIMATED_SECONDS, F.lit("experiment_audio_safety_margin_exceeded")),
        )
    )


def safe(c: Column) -> Column:
    return (token_bound(c) <= MAX_TEXT_TOKENS) & (estimated_seconds(c) <= MAX_ESTIMATED_SECONDS)


def safe_id(c: Column) -> Column:
    """File-system safe form; changed or empty names carry a digest of the original."""
    cleaned = F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    base = F.when(cleaned == "", "block").otherwise(F.substring(cleaned, 1, 60))
    tagged = F.concat(base, F.lit("-"), F.substring(F.sha2(c, 256), 1, 12))
    return F.substring(F.when((cleaned != c) | (cleaned == ""), tagged).otherwise(cleaned), 1, 80)


def overlay(c: Column, replacements: Column) -> Column:
    """Literal replacements in order; ``replacements`` is an array of (source, target)."""
    return F.aggregate(replacements, c, lambda t, r: F.replace(t, r["source"], r["target"]))


def contains_term(tokens: Column, term_tokens: Column) -> Column:
    """Whether the term occurs as a run of whole tokens; an empty term never does."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(term_tokens) > 0) & F.contains(pad(tokens), pad(term_tokens))


def repetitions(expected: Column, actual: Column) -> Column:
    """Tokens said twice in a row where the script has something else."""
    last = F.size(actual) - 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    odd = F.filter(
        spots,
        lambda i: (F.get(actual, i) == F.get(actual, i - 1)) & ~F.get(actual, i).eqNullSafe(F.get(expected, i)),
    )
    return F.transform(odd, lambda i: F.get(actual, i))


def continues(expected: Column, actual: Column) -> Column:
    """All expected tokens in front, and then more."""
    n = F.size(expected)
    head = F.when(n > 0, F.slice(actual, 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return (F.size(actual) > n) & (head == expected)
