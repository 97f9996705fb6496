"""Secrets in texts: fixed patterns, and a battery of randomness tests for the rest.

Patterns (``assign``, ``access``, ``hex``) give the base spans. What they leave of
the runs of token characters is split at each ``=`` that is not padding at the end,
and every part of ``LEAST`` characters or more is tested. Its alphabet is inferred
(hexadecimal, base32, letters, letters and digits, base64 with either pair of
signs). Two questions are asked:

* Is it as irregular as a random string? Chi-squared uniformity over the
  alphabet, runs above and below the alphabet's middle, and serial correlation;
  each must pass at ``ALPHA`` / 3.
* Is it far more irregular than text? Under text, symbols follow the corpus's own
  character counts and change their class (upper, lower, digit) at the corpus's
  own rate. The tail probabilities of the chi-squared value and of the number of
  changes are combined by Fisher's method.

The second probability goes into a Benjamini-Hochberg control of false discovery
at level ``FDR``, within strata of length, over all documents. The counts that it
needs are a histogram of bounded size. Longer tokens carry more evidence, so
their strata need less of a token.

Null text is empty text. Repeated rows are tested each. An empty table gives an
empty result. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textkit import row_slices, utf8

# The base patterns, their order and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Runs of token characters, the tested parts of a run (``=`` is padding only at the end), and the levels of the two decisions.
LEAST = 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
ALPHA = 1e-4
FDR = 0.01
#: Resolution and end of the histogram of -log10 p.
BINS, TOP = 20, 60

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in the order in which they are tried.
ALPHABETS = (
    ("hex", DIGIT + "abcdef"), ("hex", DIGIT + "ABCDEF"), ("base32", UPPER + "234567"), ("letters", LOWER), ("letters", UPPER),
    ("lower", DIGIT + LOWER), ("upper", DIGIT + UPPER), ("alphanumeric", DIGIT + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGIT + "+/"), ("base64url", UPPER + LOWER + DIGIT + "-_"), ("token", UPPER + LOWER + DIGIT + "+/-_"),
)
_SETS = [(name, signs, frozenset(signs)) for name, signs in ALPHABETS]
CLASS = np.zeros(256, np.int8)
for _n, _signs in enumerate((UPPER, LOWER, DIGIT), 1):
    CLASS[[ord(c) for c in _signs]] = _n


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; leftmost, not overlapping within a kind."""
    found = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    places = []
    for word in ASSIGN_WORDS:
        at = low.find(word)
        while at >= 0:
            places.append(at)
            at = low.find(word, at + 1)
    done = 0
    for at in sorted(places):
        if at >= done and (m := ASSIGN.match(text, at)):
            done = m.end()
            if len(m[2]) >= LEAST_VALUE:
                found.append((m.start(), 0, m.end()))
    # both other patterns need a long run of token characters
    for run in TOKEN.finditer(text):
        for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text, run.start(), run.end()) if m.end() - m.start() >= least]
    return sorted(found)


def tested_parts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what the battery tests: parts of token runs outside the sorted base spans."""
    out, i = [], 0
    for run in TOKEN.finditer(text):
        at, end = run.span()
        gaps = []
        while at < end:
            while i < len(spans) and spans[i][2] <= at:
                i += 1
            if i == len(spans) or spans[i][0] >= end:
                gaps.append((at, end))
                break
            if spans[i][0] > at:
                gaps.append((at, spans[i][0]))
            at = spans[i][2]
        out += [m.span() for a, b in gaps for m in PART.finditer(text, a, b) if m.end() - m.start() >= LEAST]
    return out


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def chi_above(x: float, df: float) -> float:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    return normal_below(-(((x / df) ** (1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def at_least(k: int, n: int, p: float) -> float:
    """Chernoff bound of a binomial's upper tail."""
    share = k / n
    if share <= p or not n:
        return 1.0
    other = (1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0
    return math.exp(-n * (share * math.log(share / p) + other))


class Battery:
    """``counts`` are the corpus's byte counts, ``change`` its rate of class changes."""

    def __init__(self, counts: np.ndarray, change: float):
        self.change = min(max(change, 1e-4), 0.5)
        self.shape = []
        for _, signs, _ in _SETS:
            q = counts[[ord(c) for c in signs]] + 0.5
            q = q / q.sum()
            self.shape.append(float(((q - 1 / len(signs)) ** 2).sum()))

    def test(self, token: str) -> tuple[bool, float, str]:
        """(passes as random, -log10 p under text, encoding)."""
        body = token.rstrip("=")
        present = set(body)
        which = next((i for i, (_, _, s) in enumerate(_SETS) if present <= s), None)
        if which is None or len(body) < 2 or present <= set(DIGIT):
            return False, 0.0, "none"
        name, signs, _ = _SETS[which]
        n, k = len(body), len(signs)
        codes = np.array([signs.index(c) for c in body])
        counts = np.bincount(codes, minlength=k)
        chi = float(((counts - n / k) ** 2).sum() * k / n)
        uniform = chi_above(chi, k - 1)
        high = codes >= k / 2
        n1 = int(high.sum())
        n2 = n - n1
        runs = 1 + int((high[1:] != high[:-1]).sum())
        if n1 and n2:
            mean = 2 * n1 * n2 / n + 1
            spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
            runs_p = 2 * normal_below(-abs(runs - mean) / math.sqrt(spread))
        else:
            runs_p = 2.0 ** (1 - n)
        centred = codes - codes.mean()
        power = float((centred**2).sum())
        serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
        serial_p = 2 * normal_below(-abs(serial + 1 / n) * math.sqrt(n))
        passes = min(uniform, runs_p, serial_p) >= ALPHA / 3
        extra = n * k * self.shape[which]
        text_p = normal_below((chi - (k - 1) - extra) / math.sqrt(2 * (k - 1) + 4 * extra))
        kinds = CLASS[np.frombuffer(body.encode(), np.uint8)]
        change_p = at_least(int((kinds[1:] != kinds[:-1]).sum()), n - 1, self.change)
        fisher = -2 * (math.log(max(text_p, 1e-300)) + math.log(max(change_p, 1e-300)))
        # two tests: the tail of chi-squared with four degrees of freedom is closed
        log_p = -fisher / 2 + math.log1p(fisher / 2)
        return passes, -log_p / math.log(10), name


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Byte counts and the rate of class changes, over all texts."""

    def run(batches):
        counts, pairs, changes = np.zeros(256, np.int64), 0, 0
        for batch in row_slices(batches, "text"):
            body, _ = utf8(batch.column("text"))
            counts += np.bincount(body, minlength=256)
            kinds = CLASS[body]
            both = (kinds[1:] > 0) & (kinds[:-1] > 0)
            pairs += int(both.sum())
            changes += int((both & (kinds[1:] != kinds[:-1])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(256), 256, 257]), pa.array([*counts.tolist(), pairs, changes])], ["i", "n"])

    # 258 rows, however large the table
    found = dict(rows.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect())
    return np.array([found.get(i, 0) for i in range(256)], float), found.get(257, 0) / max(1, found.get(256, 0))


STRUCT = "array<struct<start:bigint,kind:int,end:bigint>>"
TESTED = "array<struct<start:bigint,end:bigint,stratum:int,score:double,passes:boolean,encoding:string>>"


def examined(rows: DataFrame, battery: Battery) -> DataFrame:
    """(id, base, tested) of every text; no tested part touches a base span."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    tested_type = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("score", pa.float64()), ("passes", pa.bool_()), ("encoding", pa.string())])
    )

    def run(batches):
        for batch in row_slices(batches, "text"):
            base, tested = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                own = []
                for s, e in tested_parts(text, spans):
                    passes, score, name = battery.test(text[s:e])
                    stratum = int(2 * math.log2(e - s))
                    own.append({"start": s, "end": e, "stratum": stratum, "score": min(score, TOP), "passes": passes, "encoding": name})
                tested.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, span), pa.array(tested, tested_type)], ["id", "base", "tested"])

    return rows.mapInArrow(run, f"id long, base {STRUCT}, tested {TESTED}")


def thresholds(found: DataFrame, level: float) -> dict[int, float]:
    """Per stratum the least -log10 p that the step-up procedure accepts."""
    bins = (
        found.select(F.explode("tested").alias("t")).groupBy("t.stratum", F.floor(F.col("t.score") * BINS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n")).collect()
    )
    strata: dict[int, dict[int, int]] = {}
    for row in bins:
        strata.setdefault(row["stratum"], {})[row["bin"]] = row["n"]
    out = {}
    for stratum, counts in strata.items():
        total, above = sum(counts.values()), 0
        for at in sorted(counts, reverse=True):
            above += counts[at]
            if 10.0 ** (-at / BINS) <= level * above / total:
                out[stratum] = at / BINS
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", level: float = FDR) -> DataFrame:
    """(id, base, random, spans) of every row: spans by start, then kind.

    ``random`` has the tokens that the battery adds, with their encoding.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    found = stored(examined(rows, Battery(*corpus_statistics(rows))), "examined")
    least = thresholds(found, level)
    accept = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None
    none = F.filter("tested", lambda t: F.lit(False))
    random = F.filter("tested", lambda t: t["passes"] & (F.floor(t["score"] * BINS) / BINS >= accept[t["stratum"]])) if least else none
    added = F.transform("random", lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return found.withColumn("random", random).withColumn("spans", F.sort_array(F.concat(F.col("base"), added.cast(STRUCT)))).drop("tested")
