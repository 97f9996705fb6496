"""One query per operator, over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, filter_audit, line_dedup, near_dup, periodic_runs, quality_classifier, quality_rules, repeat_paths, secret_scan, sentence_pieces, suffix_dedup, token_files, url_filter


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.STATS, "base_failed", "kept").drop("n_echoes")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w))),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS cover FROM f WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(cover) AS BIGINT) AS n_repeat_words FROM p GROUP BY doc_id),
s AS (SELECT w.doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '\p{Lu}')) AS upper,
    len(list_filter(generate_series(2, len(words)), lambda k: lower(words[k]) = lower(words[k-1]))) AS echoes
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 50 * len(string_split(text, chr(10))) OR 100 * upper > 50 * word_chars
    OR 100 * echoes > 15 * n_words) AS kept FROM b
"""


# The listed rules.
URL_RULES = [
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
]


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))


def graded_labels(spark, sf_dir):
    """Toxic documents are graded 0, others of low quality 1, good ones 2."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, graded_labels(spark, sf_dir))
    graded = quality_classifier.grade_documents(docs, model)
    return graded.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), "kept")


def op4_sentence_pieces(spark, sf_dir):
    model = tokenizer_file("piece_bpe_32k.model")
    ids = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return sentence_pieces.decode(ids, model).select(
        F.col("id").alias("doc_id"), "n_chars", "n_chunks", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT) AS n_{n}") for k, n in enumerate(secret_scan.KINDS[:3])]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def op6_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


OP7_SQL = rf"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, i - 1 AS line, trim(parts[i], ' ') AS value, parts[i] AS raw FROM (
  SELECT doc_id, source, parts, unnest(generate_series(1, len(parts))) AS i
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
c AS (SELECT *, regexp_matches(value, '^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{line_dedup.MIN_WORDS - 1}}}[^\x20\x09-\x0D]+') AS counts FROM l),
b AS (SELECT value, min(struct_pack(doc_id := doc_id, line := line)) AS first FROM c WHERE counts
  GROUP BY value HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
m AS (SELECT c.*, counts AND b.value IS NOT NULL AND (c.doc_id, c.line) <> (b.first.doc_id, b.first.line) AS gone
  FROM c LEFT JOIN b ON b.value = c.value),
g AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (gone) AS n_removed,
    string_agg(raw, chr(10) ORDER BY line) FILTER (NOT coalesce(gone, false)) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE lines END AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d JOIN g ON g.doc_id = d.doc_id
"""


def op8_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH t AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
k AS (SELECT DISTINCT id AS item, words[i:i+9] AS win FROM (SELECT id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i
  FROM w WHERE kind = 'b' AND len(words) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM k),
h AS (SELECT id, i, size, item FROM (SELECT id, i, size, words[i:i+size-1] AS win FROM (
    SELECT id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM w, sizes WHERE kind = 'd')) x JOIN k ON k.win = x.win),
c AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + size - 1)) AS pos FROM h) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM documents d JOIN w ON w.kind = 'd' AND w.id = CAST(d.doc_id AS VARCHAR) LEFT JOIN c ON c.id = w.id LEFT JOIN m ON m.id = w.id
"""


def op9_minhash_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, width=2, percent=80).withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
  SELECT doc_id, words[i] || ' ' || words[i+1] AS sh FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 1)) AS i FROM w)
  UNION ALL SELECT doc_id, words[1] FROM w WHERE len(words) = 1)),
n AS MATERIALIZED (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS node FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.node)
SELECT n.doc_id, CAST(max(n.n) AS BIGINT) AS n_shingles, min(node) AS component_id, n.doc_id = min(node) AS kept
FROM n JOIN reach ON reach.doc_id = n.doc_id GROUP BY n.doc_id
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.token_files(docs, tokenizer_file("byte_bpe_50k.json"), scratch_path(spark, "token-files"))
    return token_files.digests(files).withColumnRenamed("doc", "doc_id")


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
o AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 2 * length(w.text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > o.first THEN 16 ELSE 0 END AS mask
  FROM w JOIN o ON o.text = w.text LEFT JOIN k ON k.doc_id = w.doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
walk AS (SELECT '' AS prefix, 0 AS before, 0 AS applied, 0 AS step, 0 AS bit
  UNION ALL SELECT prefix || letter, applied, applied | l.bit, step + 1, l.bit FROM walk JOIN l ON applied & l.bit = 0),
s AS (SELECT part, prefix, step, sum(CASE WHEN mask & applied = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM walk, c WHERE step > 0 GROUP BY part, prefix, step),
f AS (SELECT s.*, x.prefix AS filter_order FROM s JOIN walk x ON x.step = 5 AND left(x.prefix, s.step) = s.prefix)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, right(prefix, 1)) AS BIGINT) AS shapley FROM f
"""


def op12_substring_dedup(spark, sf_dir):
    found = repeat_paths.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS win FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
g AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT k.doc_id, unnest(generate_series(i, i + 12)) AS pos FROM k JOIN f ON f.win = k.win AND f.first < k.doc_id) GROUP BY doc_id),
c AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM w) w
  LEFT JOIN g ON g.doc_id = w.doc_id WHERE NOT coalesce(list_contains(g.gone, i), false) GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(c.n, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""


def planted_periods(text="text", doc_id="doc_id"):
    """The text, its tail made periodic in a tenth of the documents, as a hash of the id says."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    rows = F.struct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"))

    def tail(r):
        w, g, n = r["w"], r["g"], F.size(r["w"])
        at = F.struct(w.alias("w"), g.alias("g"), (g % n).cast("int").alias("a"))

        def planted(x):
            period = (F.lit(1) + F.floor((F.size(x["w"]) - x["a"]) / (F.lit(3) + x["g"] % 8))).cast("int")
            named = F.struct(x["w"].alias("w"), x["a"].alias("a"), period.alias("p"))
            return F.transform(F.array(named), lambda y: F.array_join(
                F.transform(y["w"], lambda word, i: F.when(i < y["a"], word).otherwise(F.get(y["w"], y["a"] + (i - y["a"]) % y["p"]))), " "))[0]

        return F.when(n > 0, F.transform(F.array(at), planted)[0]).otherwise(F.lit(""))

    # one-element arrays name a value, so that words are split once
    return F.when(h % 10 == 0, F.transform(F.array(rows), tail)[0]).otherwise(F.col(text))


def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_periods().alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("lines", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])))

    # greatest exact length / period, ties to the first: the list is sorted by start, then period
    def better(best, r):
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    first = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    return found.withColumn("first", first).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "first.start", "first.length", "first.period",
        F.floor(1000 * F.col("first.length") / F.col("first.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# Pairs of equal 8-grams at one distance make islands; the smallest distance of an island's ends is its period.
OP13_SQL = r"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h FROM documents),
a AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(generate_series(0, n - 1), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM p),
g AS MATERIALIZED (SELECT doc_id, i, hash(words[i+1:i+8]) AS gram FROM (SELECT doc_id, words, unnest(generate_series(0, n - 8)) AS i FROM t)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
k AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 8 AS t FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS MATERIALIZED (SELECT doc_id, s AS start, t - s AS length, min(q) AS period FROM k GROUP BY doc_id, s, t HAVING t - s >= greatest(24, 3 * min(q))),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
f AS (SELECT DISTINCT ON (doc_id) * FROM r ORDER BY doc_id, CAST(length AS DOUBLE) / period DESC, start, period),
d AS (SELECT doc_id, list(DISTINCT w) AS gone FROM (SELECT doc_id, unnest(generate_series(start + period, start + length - 1)) AS w FROM r) GROUP BY doc_id),
c AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(0, n - 1)) AS i FROM t) t
  LEFT JOIN d ON d.doc_id = t.doc_id WHERE NOT coalesce(list_contains(d.gone, i), false) GROUP BY t.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, f.start, f.length, f.period, 1000 * f.length // f.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN f ON f.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_url_filter": (op2_url_filter, None),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_sentence_pieces": (op4_sentence_pieces, None),
    "op5_secret_scan": (op5_secret_scan, None),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_line_dedup": (op7_line_dedup, OP7_SQL),
    "op8_benchmark_decontamination": (op8_benchmark_decontamination, OP8_SQL),
    "op9_minhash_near_dedup": (op9_minhash_near_dedup, OP9_SQL),
    "op10_token_files": (op10_token_files, None),
    "op11_filter_audit": (op11_filter_audit, OP11_SQL),
    "op12_substring_dedup": (op12_substring_dedup, OP12_SQL),
    "op13_periodic_runs": (op13_periodic_runs, OP13_SQL),
}
