"""Text rules and content checks over documents and conversations, on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import korean, text as X
from ..functions.text import ENDERS, LINE_END, SENTENCE, WS
from ..operators import content, gates
from ..rules import BAD_CUT_ENDINGS, CONNECTIVE_ENDINGS, GOOD_CUT_ENDINGS, JOIN_SYLLABLES, LOCATIVE_ENDING, MAX_SYLLABLES, MIN_SYLLABLES, NUMERAL_CHARS, RESPELLINGS
from ..session import spread
from . import bindings as B

# The test texts hold no Hangul. This letter table (fixed, arbitrary) turns their
# Latin letters into syllables, so that the Korean rules have something to work on.
LATIN = "abcdefghijklmnopqrstuvwxyz"
HANGUL = "다고서며면데만져지나일이삼사가라까요한된어과아에백십"


def docs(spark, d):
    return B.table(spark, d, "documents")


def hangul_docs(spark, d):
    return spread(docs(spark, d)).withColumn("text", F.translate(F.lower("text"), LATIN, HANGUL))


HDOC = f"hdocs AS (SELECT * REPLACE (translate(lower(text), '{LATIN}', '{HANGUL}') AS text) FROM documents)"
FIRST = f"regexp_extract_all(text, '{X.FIRST_SENTENCE}')"


def strip_sql(e):
    return "regexp_replace(" + e + ", '^" + WS + "+|" + WS + "+\\z', '', 'g')"


def kept_sql(e):
    return f"list_filter(list_transform({e}, lambda p: {strip_sql('p')}), lambda p: p <> '')"


def syllables(spark, d):
    h = hangul_docs(spark, d)
    return h.select("doc_id", X.syllables(F.col("text")).cast("bigint").alias("n_syl"))


def numeral_heavy(spark, d):
    return hangul_docs(spark, d).select("doc_id", X.numeral_heavy(F.col("text")).alias("numeral_heavy"))


def is_question(spark, d):
    s = hangul_docs(spark, d).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(X.is_question(F.col("s"))).alias("production"),
        F.count_if(X.is_question_shadow(F.col("s"))).alias("shadow"),
    )


def respell(spark, d):
    """The spelling table on texts where the letters of 'th' stand for one of its words."""
    t = F.replace(F.col("text"), F.lit("th"), F.lit("굳힌다는"))
    t = F.replace(t, F.lit("en"), F.lit("끊어진"))
    return docs(spark, d).select("doc_id", F.sha2(X.respell(t), 256).alias("h"))


def split_sentences(spark, d):
    return hangul_docs(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.sha2("s", 256).alias("h")
    )


def split_sentences_multi(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.sentences_multi(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.sha2("s", 256).alias("h")
    )


def semantic_clauses(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(X.clauses(F.col("text"))).alias("pos", "s")).select(
        "doc_id", "pos", F.sha2("s", 256).alias("h")
    )


CLAUSES_SQL = f"""WITH RECURSIVE pieces AS (SELECT doc_id, text, {kept_sql("string_split(regexp_replace(text, '(" + X.CLAUSE_BOUNDARY + ")', '\\1' || chr(1), 'g'), chr(1))")} AS ps FROM documents),
walk AS (SELECT doc_id, ps, 2 AS i, ps[1] AS open, CAST(NULL AS VARCHAR) AS closed, 0 AS pos FROM pieces WHERE len(ps) >= 2
  UNION ALL SELECT doc_id, ps, i+1, CASE WHEN nxt THEN ps[i] ELSE j END, CASE WHEN nxt THEN open END, pos + nxt::INT
  FROM (SELECT *, open || ' ' || ps[i] AS j, length(regexp_replace(open || ' ' || ps[i], '[^\\p{{L}}\\p{{N}}]', '', 'g')) > 80 OR i > len(ps) AS nxt FROM walk WHERE i <= len(ps) + 1) q)
SELECT doc_id, CAST(pos-1 AS INT) AS pos, sha256(closed) AS h FROM walk WHERE closed IS NOT NULL
UNION ALL SELECT doc_id, 0, sha256({strip_sql('text')}) FROM pieces WHERE len(ps) < 2"""


def split_phrases(spark, d):
    return content.phrase_table(hangul_docs(spark, d), ["doc_id"])


def phrase_rows(spark, d):
    return split_phrases(spark, d).select("doc_id", "phrase_idx", F.sha2("text", 256).alias("h"), X.syllables(F.col("text")).alias("n_syl"), "sentence_final", "forced")


def build_phrases(spark, d):
    """Each script against its phrases in a row: syllables in and out, and the hash of all phrases."""
    h = hangul_docs(spark, d)
    # the phrases of one text, so the list is no longer than the text
    out = content.phrase_table(h, ["doc_id"]).groupBy("doc_id").agg(
        F.sum(X.syllables(F.col("text"))).alias("n_out"), F.array_sort(F.collect_list(F.struct("phrase_idx", "text"))).alias("rows")
    )
    # counts and hashes meet, texts do not
    told = out.select("doc_id", "n_out", F.sha2(F.array_join("rows.text", "|"), 256).alias("h"))
    scripts = h.select("doc_id", X.syllables(X.respell(F.col("text"))).cast("bigint").alias("n_in"))
    return scripts.join(told, "doc_id", "left").select(
        "doc_id", "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("h", F.sha2(F.lit(""), 256)).alias("h")
    )


def _syllables_sql(e):
    return f"CAST(length(regexp_replace({e}, '[^가-힣]', '', 'g')) AS BIGINT)"


def respell_sql(e):
    for old, new in (*RESPELLINGS, ("?", ".")):
        e = f"replace({e}, '{old}', '{new}')"
    return e


def _ends(words):
    return "(?:" + "|".join(words) + r")\z"


def force_sql(name, source, keep):
    """Over-long phrases of ``source`` (text, n and the columns ``keep``) cut at their best word edges: pieces with their number from 1."""
    return f"""
{name}_w AS (SELECT {keep}, text, n, string_split(text, ' ') AS ws FROM {source}),
{name}_s AS (SELECT *, list_transform(ws, lambda w: {_syllables_sql('w')}) AS sy, list_transform(ws, lambda w: CASE WHEN regexp_matches(w, '{_ends(GOOD_CUT_ENDINGS)}') THEN 6e0 ELSE 0e0 END
    - CASE WHEN regexp_matches(w, '{_ends(BAD_CUT_ENDINGS)}') THEN 8e0 ELSE 0e0 END) AS bonus FROM {name}_w),
{name}_t AS (SELECT *, list_transform(range(0, len(ws) + 1), lambda i: CAST(coalesce(list_sum(sy[1:i]), 0) AS BIGINT)) AS sums FROM {name}_s),
{name}_c AS (SELECT *, CASE WHEN n <= {MAX_SYLLABLES} THEN [CAST(0 AS BIGINT)] ELSE list_reduce(list_transform(range(0, len(ws) + 1), lambda i: [CAST(0 AS BIGINT)]), lambda acc, x:
    CASE WHEN sums[len(ws) + 1] - sums[acc[len(acc)] + 1] > {MAX_SYLLABLES} AND len(ws) - acc[len(acc)] > 1 THEN list_append(acc, acc[len(acc)] + list_position(
      list_transform(range(acc[len(acc)] + 1, len(ws)), lambda c: bonus[c] - abs(sums[c + 1] - (sums[len(ws) + 1] + sums[acc[len(acc)] + 1]) / 2e0)),
      list_max(list_transform(range(acc[len(acc)] + 1, len(ws)), lambda c: bonus[c] - abs(sums[c + 1] - (sums[len(ws) + 1] + sums[acc[len(acc)] + 1]) / 2e0)))))
    ELSE acc END) END AS cuts FROM {name}_t),
{name} AS (SELECT {keep}, piece, CASE WHEN len(cuts) = 1 THEN text ELSE array_to_string(ws[cuts[piece] + 1 : coalesce(cuts[piece + 1], len(ws))], ' ') END AS text,
    CASE WHEN len(cuts) = 1 THEN n ELSE sums[coalesce(cuts[piece + 1], len(ws)) + 1] - sums[cuts[piece] + 1] END AS n, piece < len(cuts) AS cut FROM (SELECT *, unnest(range(1, len(cuts) + 1)) AS piece FROM {name}_c) q)"""


def merge_sql(name, source, joins):
    """Neighbouring units of a sentence joined while ``joins`` (of the open sum ``o`` and the next ``m``) allows."""
    test = joins.replace("o", "acc[1]").replace("m", "x[1]")
    return f"""
{name}_g AS (SELECT *, list_reduce(list_prepend([CAST(0 AS BIGINT), 0], list_transform(units, lambda u: [u.n])), lambda acc, x:
    CASE WHEN len(acc) > 2 AND {test} THEN [acc[1] + x[1], acc[2] + 1] || acc[3:] ELSE list_append([x[1], acc[2] + 1] || acc[3:], acc[2] + 1) END)[3:] AS gs FROM {source}),
{name} AS (SELECT doc_id, sent, list_transform(range(1, len(gs) + 1), lambda j: struct_pack(text := array_to_string(list_transform(units[gs[j] : coalesce(gs[j + 1] - 1, len(units))], lambda u: u.text), ' '),
    n := CAST(list_sum(list_transform(units[gs[j] : coalesce(gs[j + 1] - 1, len(units))], lambda u: u.n)) AS BIGINT))) AS units FROM {name}_g)"""


# The phrase rules as folds over lists: units, two merges, cuts, tiny phrases, cuts again.
PHRASES_SQL = B.with_sql(HDOC, f"""
sents AS (SELECT doc_id, unnest(range(len(ss))) AS sent, {strip_sql('unnest(ss)')} AS sentence FROM (SELECT doc_id, regexp_extract_all({respell_sql('text')}, '{X.FIRST_SENTENCE}') AS ss FROM hdocs) q),
parts AS (SELECT doc_id, sent, unnest(range(len(ps))) AS part, {strip_sql('unnest(ps)')} AS part_text FROM (SELECT doc_id, sent, string_split(sentence, ',') AS ps FROM sents) q),
words AS (SELECT *, string_split(part_text, ' ') AS ws FROM parts WHERE part_text <> ''),
cuts AS (SELECT *, list_reduce(list_prepend([CAST(0 AS BIGINT), 0], list_transform(ws, lambda w, i: [{_syllables_sql('w')}, (regexp_matches(w, '{_ends(CONNECTIVE_ENDINGS)}') AND NOT regexp_matches(w, '{LOCATIVE_ENDING}\\z'))::INT, (i = len(ws))::INT])),
    lambda acc, x: CASE WHEN x[3] = 1 OR x[2] = 1 AND acc[2] + x[1] >= 4 THEN list_append([acc[1] + 1, 0] || acc[3:], acc[1] + 1) ELSE [acc[1] + 1, acc[2] + x[1]] || acc[3:] END)[3:] AS cs FROM words),
pieces AS (SELECT doc_id, sent, part, j, {strip_sql("array_to_string(ws[coalesce(cs[j - 1], 0) + 1 : cs[j]], ' ')")} AS text, CAST(list_sum(list_transform(ws[coalesce(cs[j - 1], 0) + 1 : cs[j]], lambda w: {_syllables_sql('w')})) AS BIGINT) AS n
  FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS j FROM cuts) q),
united AS (SELECT doc_id, sent, list(struct_pack(text := text, n := n) ORDER BY part, j) AS units FROM pieces WHERE text <> '' GROUP BY doc_id, sent)""",
    merge_sql("joined", "united", f"o + m <= {JOIN_SYLLABLES}"), merge_sql("merged", "joined", f"least(o, m) < {MIN_SYLLABLES} AND o + m <= {MAX_SYLLABLES}"), """
whole AS (SELECT doc_id, sent, pos, units[pos].text AS text, units[pos].n AS n FROM (SELECT *, unnest(range(1, len(units) + 1)) AS pos FROM merged) q)""",
    force_sql("first_cut", "whole", "doc_id, sent, pos"), """
items AS (SELECT doc_id, list(struct_pack(text := text, n := n, final := final, forced := cut) ORDER BY sent, pos, piece) AS items FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos DESC, piece DESC) = 1 AS final FROM first_cut) q GROUP BY doc_id),
closed AS (SELECT doc_id, list_reduce(list_transform(items, lambda x: [x]), lambda acc, x: CASE WHEN x[1].n < 4 AND NOT acc[len(acc)].final
    THEN acc[:len(acc) - 1] || [struct_pack(text := acc[len(acc)].text || ' ' || x[1].text, n := acc[len(acc)].n + x[1].n, final := x[1].final, forced := x[1].forced), struct_pack(text := '', n := CAST(0 AS BIGINT), final := x[1].final, forced := x[1].forced)]
    ELSE acc || x END) AS items FROM items),
left_over AS (SELECT doc_id, pos, x.text AS text, x.n AS n, x.final AS final, x.forced AS forced FROM (SELECT doc_id, unnest(range(1, len(items) + 1)) AS pos, unnest(items) AS x FROM closed) q WHERE x.text <> '')""",
    force_sql("last_cut", "left_over", "doc_id, pos, final, forced"), """
phrases AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, piece) - 1 AS INT) AS phrase_idx, text, final AND NOT cut AS sentence_final, cut OR forced AS forced FROM last_cut)""", tail="")


def audible_chars(spark, d):
    return docs(spark, d).select("doc_id", X.audible(F.col("text")).alias("audible"), F.length(X.compact(F.col("text"))).alias("compact"))


def parse_batch_text(spark, d):
    return content.batch_items(docs(spark, d), ["doc_id"]).select("doc_id", "item_id", F.sha2("text", 256).alias("h"))


def normalize_pronunciation(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.sha2(korean.normalise("text"), 256).alias("h"))


def sino_number(spark, d):
    """Readings of order keys and prices, one distinct value at a time."""
    o = B.table(spark, d, "orders").select(F.format_string("%.2f", "o_totalprice").alias("v")).distinct()
    return o.select("v", korean.normalise("v").alias("reading"))


def _digit_sql(d):
    return f"substr('{korean.DIGITS}', {d} + 1, 1)"


SINO_SQL = f"""WITH o AS (SELECT DISTINCT printf('%.2f', o_totalprice) AS v FROM orders),
g AS (SELECT v, list_transform(range(0, 4), lambda i: substr(lpad(split_part(v, '.', 1), 16, '0'), CAST(4 * i + 1 AS INT), 4)) AS gs FROM o),
r AS (SELECT v, list_transform(gs, lambda g, i: CASE WHEN CAST(g AS INT) = 0 THEN '' ELSE array_to_string(list_transform(range(1, 5), lambda k:
    CASE WHEN CAST(substr(g, CAST(k AS INT), 1) AS INT) = 0 THEN '' WHEN CAST(substr(g, CAST(k AS INT), 1) AS INT) = 1 AND k < 4 THEN {list(reversed(korean.PLACES))}[k]
    ELSE {_digit_sql('CAST(substr(g, CAST(k AS INT), 1) AS INT)')} || {list(reversed(korean.PLACES))}[k] END), '') || {list(reversed(korean.MYRIADS))}[i] END) AS words FROM g)
SELECT v, CASE WHEN len(list_filter(words, lambda w: w <> '')) = 0 THEN '{korean.DIGITS[0]}' ELSE array_to_string(list_filter(words, lambda w: w <> ''), ' ') END
  || ' 점 ' || array_to_string(list_transform(string_split(split_part(v, '.', 2), ''), lambda d: {_digit_sql('CAST(d AS INT)')}), ' ') AS reading FROM r"""


def turns(spark, d):
    """Each turn as expected text, the next turn of its conversation as what was heard."""
    c = spread(B.table(spark, d, "conversations"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("actual"))
    return c.select("conv_id", "turn", "role", F.col("text").alias("expected")).join(nxt, ["conv_id", "turn"])


def simple_tokens(c):
    return F.filter(F.split(F.lower(c), f"{WS}+"), lambda w: w != "")


def turn_tokens(spark, d):
    t = turns(spark, d)
    return t.withColumns({"exp": simple_tokens(F.col("expected")), "act": simple_tokens(F.col("actual"))})


TURNS_SQL = f"""
turns AS (SELECT a.conv_id, a.turn, a.role, a.text AS expected, b.text AS actual FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1),
toks AS (SELECT *, list_filter(regexp_split_to_array(lower(expected), '{WS}+'), lambda w: w <> '') AS e, list_filter(regexp_split_to_array(lower(actual), '{WS}+'), lambda w: w <> '') AS a FROM turns)"""


def align_sql(pairs, columns, tail="aligned"):
    """Token alignment by anti-diagonals: cell i of diagonal s aligns the first i expected with the first s - i actual tokens."""
    return f"""WITH RECURSIVE toks AS ({pairs}),
cells AS (SELECT *, 0 AS s, [struct_pack(d := 0, x := 0, w := 0)] AS newer, [struct_pack(d := 0, x := 0, w := 0)] AS older FROM toks
  UNION ALL SELECT * EXCLUDE (s, newer, older), s + 1, list_transform(generate_series(0, len(e)), lambda i:
    CASE WHEN s + 1 - i < 0 OR s + 1 - i > len(a) THEN NULL
      WHEN i = 0 THEN struct_pack(d := 0, x := 0, w := 0)
      WHEN i = s + 1 THEN struct_pack(d := CAST(i AS INT), x := CAST(i AS INT), w := 0)
      WHEN newer[i].d <= newer[i+1].d AND newer[i].d + 1 <= older[i].d + (e[i] <> a[s+1-i])::INT THEN struct_pack(d := newer[i].d + 1, x := newer[i].x + 1, w := newer[i].w)
      WHEN newer[i+1].d + 1 <= older[i].d + (e[i] <> a[s+1-i])::INT THEN struct_pack(d := newer[i+1].d + 1, x := newer[i+1].x, w := newer[i+1].w)
      ELSE struct_pack(d := older[i].d + (e[i] <> a[s+1-i])::INT, x := older[i].x, w := older[i].w + (e[i] <> a[s+1-i])::INT) END), newer
  FROM cells WHERE s < len(e) + len(a)),
aligned AS (SELECT *, newer[len(e)+1].d AS distance, newer[len(e)+1].x AS deletions, CAST(newer[len(e)+1].x - len(e) + len(a) AS INT) AS insertions, newer[len(e)+1].w AS substitutions FROM cells WHERE s = len(e) + len(a))
SELECT {columns} FROM {tail}"""


TOKENS_SQL = f"""SELECT a.conv_id, a.turn, a.role, list_filter(regexp_split_to_array(lower(a.text), '{WS}+'), lambda w: w <> '') AS e, list_filter(regexp_split_to_array(lower(b.text), '{WS}+'), lambda w: w <> '') AS a
  FROM conversations a JOIN conversations b ON b.conv_id=a.conv_id AND b.turn=a.turn+1"""
ALIGN_SQL = align_sql(TOKENS_SQL, "conv_id, turn, distance, deletions, insertions, substitutions, round(distance / greatest(1, len(e)), 6) AS rate")


def content_align(spark, d):
    r = content.compare(turns(spark, d), simple_tokens)
    return r.select("conv_id", "turn", "distance", "deletions", "insertions", "substitutions", F.round("normalized_edit_distance", 6).alias("rate"))


def critical_terms(spark, d):
    """Terms: the first, second and third token pair of the expected turn."""
    t = turn_tokens(spark, d).where(F.size("exp") >= 3)
    terms = F.array(
        F.col("exp")[0], F.concat_ws(" ", F.col("exp")[0], F.col("exp")[1]), F.col("exp")[2], F.lit(" ")
    )
    r = content.missing_terms(t.withColumn("critical_terms", terms), normal=None)
    return r.select("conv_id", "turn", F.array_join("missing_terms", "|").alias("missing"))


def adjacent_repetition(spark, d):
    t = turn_tokens(spark, d)
    return t.select("conv_id", "turn", F.array_join(X.repetitions(F.col("exp"), F.col("act")), ",").alias("repeated"))


def unexpected_continuation(spark, d):
    """Whether a document goes on where another of the same opening line stops."""
    t = turn_tokens(spark, d)
    longer = F.concat("exp", F.slice("act", 1, 3))
    return t.select(
        "conv_id", "turn", X.continues(F.col("exp"), F.col("act")).alias("next_turn"),
        X.continues(F.col("exp"), longer).alias("appended"), X.continues(longer, F.col("exp")).alias("cut_short"),
    )


def content_gate(spark, d):
    """Turns compared, checked for their first word and gated."""
    t = content.compare(turns(spark, d), simple_tokens).withColumns(
        {
            "critical_terms": F.slice("exp", 1, 1), "asr_status": F.when(F.col("role") == "user", "pass").when(F.size("act") > 20, "unknown").otherwise("not_run"),
            "asr_reason": F.when(F.size("act") > 40, "asr_exception:TooLong"),
        }
    )
    gated = content.content_gate(content.missing_terms(t, normal=None))
    return gated.select("conv_id", "turn", "status", F.array_join("reasons", ",").alias("reasons"))


GATE_SQL = align_sql(
    TOKENS_SQL, """conv_id, turn, CASE WHEN role='user' THEN CASE WHEN why='' THEN 'pass' ELSE 'fail' END WHEN len(a)>20 THEN 'unknown' ELSE 'not_run' END AS status,
  CASE WHEN role='user' THEN why WHEN len(a)>40 THEN 'asr_exception:TooLong' ELSE 'asr_not_available' END AS reasons FROM (SELECT *, rtrim(concat(CASE WHEN distance>0 THEN 'content_mismatch,' ELSE '' END,
  CASE WHEN len(e)>0 AND NOT list_contains(a, e[1]) THEN 'critical_term_missing,' ELSE '' END, CASE WHEN len(list_filter(range(2, len(a)+1), lambda i: a[i]=a[i-1] AND a[i] IS DISTINCT FROM e[i]))>0 THEN 'unexpected_repetition,' ELSE '' END,
  CASE WHEN len(a)>len(e) AND a[1:len(e)]=e THEN 'unexpected_continuation,' ELSE '' END), ',') AS why""", tail="aligned) q")


def asr_segments_input(spark, d):
    pieces = X.sentences_multi(F.col("text"))
    seg = F.transform(
        pieces,
        lambda s, i: F.struct(
            F.when(F.length(s) % 7 == 0, F.lit("  ")).otherwise(s).alias("text"),
            F.when(F.length(s) % 5 == 0, F.lit(float("nan"))).otherwise(i.cast("double")).alias("start"),
            (i + F.length(s) % 4 - 1).cast("double").alias("end"),
        ),
    )
    return docs(spark, d).select("doc_id", "source", seg.alias("segments"))


def asr_segment_filter(spark, d):
    r = content.asr_segments(asr_segments_input(spark, d), ["doc_id"])
    return r.select("doc_id", "segment_idx", F.sha2("text", 256).alias("h"), "start", "end")


MULTI = f"""multi AS (SELECT doc_id, source, lang, CASE WHEN len(ps) > 0 AND regexp_replace(array_to_string(ps, ''), '{WS}+', '', 'g') = regexp_replace(t, '{WS}+', '', 'g') THEN ps ELSE [t] END AS ps
  FROM (SELECT *, {kept_sql(f"regexp_extract_all(t, '{SENTENCE}')")} AS ps FROM (SELECT *, {strip_sql('text')} AS t FROM documents) q) q2)"""


def asr_timing(spark, d):
    """Words with times where recognition passed, whatever the content verdict."""
    t = turn_tokens(spark, d).withColumns(
        {
            "asr_status": F.when(F.col("role") == "user", "pass").otherwise("unknown"),
            "words": F.transform("act", lambda w, i: F.struct(w.alias("word"), i.cast("double").alias("start"))),
        }
    )
    w = content.word_timing(t, ["conv_id", "turn"])
    return w.groupBy("conv_id", "turn").agg(F.count("word").alias("n_words"), F.max("start").alias("last_start"))


def rule_documents(spark, d):
    """Rule documents made from benchmark items; every third is broken in its own way."""
    b = B.table(spark, d, "benchmark")
    word = F.split(F.lower("text"), " ")[0]
    # a word may hold line ends, quotes or nothing; an empty one would break the document and replaces nothing
    key = F.regexp_extract(F.to_json(F.array(word)), r"^\[(.*)\]$", 1)
    first = F.when(word == "", F.lit("")).otherwise(F.concat(key, F.lit(':"<1>",')))
    doc = F.when(F.col("item_id") % 3 == 1, F.lit('{"schema_version":"old","rules_version":"x","text_replacements":{}}')).when(
        F.col("item_id") % 3 == 2, F.lit("{broken")
    ).otherwise(
        F.concat(
            F.lit('{"schema_version":"fast-speaker-rules/1","rules_version":"v'), F.col("item_id"), F.lit('","text_replacements":{'),
            first, F.lit('"e":"E"}}'),
        )
    )
    return b.select(F.col("item_id").alias("loaded_at"), doc.alias("document"))


def text_overlay(spark, d):
    r = content.active_rules(rule_documents(spark, d))
    return content.overlay(docs(spark, d), r).select("doc_id", "rules_version", F.sha2("text", 256).alias("h"))


def safety_check(spark, d):
    t = F.col("text")
    return docs(spark, d).select(
        "doc_id", X.token_bound(t).alias("token_bound"), X.estimated_seconds(t).alias("estimated_seconds"),
        F.array_join(X.safety_reasons(t), ",").alias("reasons"),
    )


def safe_id(spark, d):
    p = B.table(spark, d, "pages")
    return p.select("page_id", X.safe_id(F.col("url")).alias("url_id"), X.safe_id(F.concat(F.lit("B"), "page_id")).alias("plain_id"))


def request_validate(spark, d):
    t = docs(spark, d).join(B.table(spark, d, "labels"), "doc_id", "left")
    r = t.select(
        "doc_id", "text", F.when(F.col("lang") == "de", " ").otherwise(F.concat("source", F.lit(".wav"))).alias("output_wav"),
        F.when(F.col("quality") == 0, "slow").otherwise("FAST ").alias("mode"), F.when(F.col("toxic") == 1, "x1").otherwise(F.col("n_chars").cast("string")).alias("seed"),
        F.concat("source", F.lit("-"), "doc_id").alias("request_id"), F.when(F.col("n_chars") < 200, "B 1").otherwise("B01").alias("block_id"),
    )
    return gates.validate_requests(r).select("doc_id", "error")


def identity_validate(spark, d):
    p = B.table(spark, d, "pages")
    path = F.regexp_replace("url", "^http://[^/]*", "")
    made = F.when(F.col("url").contains("www"), path).when(F.col("url").contains("?"), F.concat(F.lit(".."), path)).otherwise(
        F.concat(F.lit("a\\."), path, F.lit("//"))
    )
    r = gates.validate_paths(p.select("page_id", made.alias("path")))
    return r.select("page_id", "error", "normal_path")


def feature_flags_validate(spark, d):
    names = F.array(*[F.lit(n) for n in gates.FLAG_DOMAINS])
    c = B.table(spark, d, "customer")
    seg = F.when(F.col("c_mktsegment") == "BUILDING", " Shadow ").when(F.col("c_mktsegment") == "MACHINERY", "on").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "experiment"
    )
    r = gates.validate_flags(c.select("c_custkey", F.explode(names).alias("flag"), seg.alias("value")))
    return r.groupBy("flag", "effective").agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("rows"))


def source_text_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(X.squeeze(F.col("text")), 256).alias("text_hash"))


FLAG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS flag, [{', '.join(repr(x) for x in v)}] AS dom" for k, v in gates.FLAG_DOMAINS.items())
AUD = "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))"
QUIET = "(?:까요|나요|가요)"
QUERIES = {
    "syllables": (syllables, B.with_sql(HDOC, tail="SELECT doc_id, CAST(length(regexp_replace(text, '[^가-힣]', '', 'g')) AS BIGINT) AS n_syl FROM hdocs")),
    "numeral_heavy": (numeral_heavy, B.with_sql(HDOC, tail=f"SELECT doc_id, length(regexp_replace(text, '[^{NUMERAL_CHARS}]', '', 'g')) >= 3 AS numeral_heavy FROM hdocs")),
    "is_question": (is_question, B.with_sql(HDOC, f"s AS (SELECT doc_id, unnest({kept_sql(FIRST)}) AS s FROM hdocs)",
        tail=f"""SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(s, '{QUIET}[. ]*\\z')) AS production,
        count(*) FILTER (regexp_matches(s, '\\?{WS}*\\z') OR regexp_matches(s, '{QUIET}[.?!…]*{WS}*\\z')) AS shadow FROM s GROUP BY doc_id""")),
    "respell": (respell, "SELECT doc_id, sha256(replace(replace(replace(text, 'th', '구친다는'), 'en', '끄너진'), '?', '.')) AS h FROM documents"),
    "split_sentences": (split_sentences, B.with_sql(HDOC, f"s AS (SELECT doc_id, {kept_sql(FIRST)} AS ps FROM hdocs)",
        tail="SELECT doc_id, unnest(range(len(ps)))::INT AS pos, sha256(unnest(ps)) AS h FROM s")),
    "split_sentences_multi": (split_sentences_multi, B.with_sql(MULTI, tail="SELECT doc_id, unnest(range(len(ps)))::INT AS pos, sha256(unnest(ps)) AS h FROM multi")),
    "semantic_clauses": (semantic_clauses, CLAUSES_SQL),
    "split_phrases": (phrase_rows, PHRASES_SQL + f"SELECT doc_id, phrase_idx, sha256(text) AS h, CAST({_syllables_sql('text')} AS INT) AS n_syl, sentence_final, forced FROM phrases"),
    "build_phrases": (build_phrases, PHRASES_SQL + f"""SELECT h.doc_id, {_syllables_sql(respell_sql('h.text'))} AS n_in, coalesce(n_out, 0) AS n_out, sha256(coalesce(texts, '')) AS h FROM hdocs h
        LEFT JOIN (SELECT doc_id, CAST(sum({_syllables_sql('text')}) AS BIGINT) AS n_out, string_agg(text, '|' ORDER BY phrase_idx) AS texts FROM phrases GROUP BY doc_id) p ON p.doc_id = h.doc_id"""),
    "audible_chars": (audible_chars, f"SELECT doc_id, {AUD} AS audible, length(regexp_replace(text, '{WS}+', '', 'g')) AS compact FROM documents"),
    "parse_batch_text": (parse_batch_text, f"""WITH l AS (SELECT doc_id, {kept_sql(f"regexp_split_to_array(text, '{LINE_END}')")} AS ls FROM documents),
        i AS (SELECT doc_id, {kept_sql(f"flatten(list_transform(ls, lambda x: string_split(regexp_replace(x, '([{ENDERS}]){WS}+', '\\1' || chr(1), 'g'), chr(1))))")} AS ps FROM l)
        SELECT doc_id, format('S{{:04d}}', unnest(range(1, len(ps)+1))) AS item_id, sha256(unnest(ps)) AS h FROM i"""),
    "normalize_pronunciation": (normalize_pronunciation, None),
    "sino_number": (sino_number, SINO_SQL),
    "content_align": (content_align, ALIGN_SQL),
    "critical_terms": (critical_terms, B.with_sql(TURNS_SQL, tail="""SELECT conv_id, turn, concat_ws('|', CASE WHEN NOT contains(p, ' '||e[1]||' ') THEN e[1] END, CASE WHEN NOT contains(p, ' '||e[1]||' '||e[2]||' ') THEN e[1]||' '||e[2] END,
        CASE WHEN NOT contains(p, ' '||e[3]||' ') THEN e[3] END, ' ') AS missing FROM (SELECT *, ' ' || array_to_string(a, ' ') || ' ' AS p FROM toks WHERE len(e) >= 3) q""")),
    "adjacent_repetition": (adjacent_repetition, B.with_sql(TURNS_SQL, tail="""SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(2, len(a)+1), lambda i: a[i]=a[i-1] AND a[i] IS DISTINCT FROM e[i]), lambda i: a[i]), ',') AS repeated FROM toks""")),
    "unexpected_continuation": (unexpected_continuation, B.with_sql(TURNS_SQL, tail="""SELECT conv_id, turn, len(a) > len(e) AND a[1:len(e)] = e AS next_turn, len(a) > 0 AS appended, false AS cut_short FROM toks""")),
    "content_gate": (content_gate, GATE_SQL),
    "asr_segment_filter": (asr_segment_filter, B.with_sql(MULTI, """segs AS (SELECT doc_id, list_filter(list_transform(ps, lambda s, i: {'t': CASE WHEN length(s)%7=0 THEN '' ELSE s END, 's': CASE WHEN length(s)%5=0 THEN NULL ELSE CAST(i-1 AS DOUBLE) END,
        'e': CAST(i-1+length(s)%4-1 AS DOUBLE)}), lambda x: x.t <> '' AND x.s IS NOT NULL AND x.e >= x.s) AS k FROM multi)""", tail="""SELECT doc_id, pos AS segment_idx, sha256(x.t) AS h, x.s AS start, x.e AS "end" FROM
        (SELECT doc_id, unnest(range(len(k)))::INT AS pos, unnest(k) AS x FROM segs) q""")),
    "asr_timing": (asr_timing, B.with_sql(TURNS_SQL, tail="SELECT conv_id, turn, CASE WHEN role='user' THEN len(a) ELSE 0 END AS n_words, CASE WHEN role='user' AND len(a)>0 THEN CAST(len(a)-1 AS DOUBLE) END AS last_start FROM toks")),
    "text_overlay": (text_overlay, """WITH act AS (SELECT 'v' || max(item_id) AS v, max_by(string_split(lower(text), ' ')[1], item_id) AS w FROM benchmark WHERE item_id % 3 = 0)
        SELECT doc_id, v AS rules_version, sha256(replace(replace(text, w, '<1>'), 'e', 'E')) AS h FROM documents, act"""),
    "safety_check": (safety_check, f"""SELECT doc_id, CAST(strlen(text)+2 AS INT) AS token_bound, es AS estimated_seconds, rtrim(concat(CASE WHEN strlen(text)+2>2048 THEN 'conservative_text_token_upper_bound_exceeded,' ELSE '' END,
        CASE WHEN es > 32e0 THEN 'experiment_audio_safety_margin_exceeded,' ELSE '' END), ',') AS reasons FROM (SELECT *, round(greatest(25e-2, {AUD}/4e0),3) AS es FROM documents) q"""),
    "safe_id": (safe_id, """SELECT page_id, substr(CASE WHEN c <> url OR c = '' THEN CASE WHEN c='' THEN 'block' ELSE substr(c,1,60) END || '-' || substr(sha256(url),1,12) ELSE c END, 1, 80) AS url_id, 'B' || page_id AS plain_id
        FROM (SELECT *, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS c FROM pages) q"""),
    "request_validate": (request_validate, f"""SELECT d.doc_id, CASE WHEN {strip_sql('text')}='' THEN 'text_missing' WHEN length({strip_sql('text')})>2000 THEN 'text_too_long' WHEN lang='de' THEN 'output_missing'
        WHEN quality=0 THEN 'mode_unknown' WHEN toxic=1 THEN 'seed_no_integer' WHEN n_chars<200 THEN 'block_id_characters' END AS error
        FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id"""),
    "identity_validate": (identity_validate, """WITH p AS (SELECT page_id, url, regexp_replace(url, '^http://[^/]*', '') AS path FROM pages),
        m AS (SELECT page_id, CASE WHEN contains(url,'www') THEN path WHEN contains(url,'?') THEN '..' || path ELSE 'a/.' || path || '//' END AS s FROM p),
        n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '^(\\./)+', ''), '(/\\.)?/?$', '') AS f FROM m)
        SELECT page_id, CASE WHEN s='' OR starts_with(s,'/') OR regexp_matches(s,'^[A-Za-z]:') THEN 'path must be non-empty and repository-relative' WHEN f IN ('','.','..') OR starts_with(f,'../') THEN 'path must stay within the repository' END AS error,
        CASE WHEN NOT (s='' OR starts_with(s,'/') OR regexp_matches(s,'^[A-Za-z]:') OR f IN ('','.','..') OR starts_with(f,'../')) THEN f END AS normal_path FROM n"""),
    "feature_flags_validate": (feature_flags_validate, f"""WITH f AS ({FLAG_SQL}), c AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'shadow' WHEN 'MACHINERY' THEN 'on' WHEN 'HOUSEHOLD' THEN 'experiment' ELSE 'off' END AS effective FROM customer)
        SELECT flag, effective, count(*) FILTER (list_contains(dom, effective)) AS valid, count(*) AS rows FROM f, c GROUP BY ALL"""),
    "text_hash": (source_text_hash, f"SELECT doc_id, sha256({strip_sql(f'''regexp_replace(text, '{WS}+', ' ', 'g')''')}) AS text_hash FROM documents"),
}
