"""Preference pairs, splits, the ranker and its metrics over the take binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import bank, gates, metrics, pairs as P, ranker, shadow
from ..operators.digest import sorted_digest_sql
from ..operators.ranker import LinearRanker
from ..rules import FEATURE_NAMES, FEATURE_VERSION
from ..session import cut_lineage, scratch_path
from . import bindings as B
from .take_queries import KEY, SCORED

FEATURES = [f"f_{n}" for n in FEATURE_NAMES]
IDENT = [*KEY, "take_id"]


def candidates(spark, d):
    """Takes with an explicit decision, gate verdict, sentence class and feature columns."""
    s = bank.pin_decision(gates.gate(B.takes(spark, d, phrases=bank.with_pin(B.bare_phrases(spark, d), B.pins(spark, d)))))
    c = F.when(F.col("question"), "question").when(F.col("forced"), "forced").when(F.col("sentence_final"), "final").otherwise("plain")
    return shadow.ranking_features(s.withColumn("hard_gate_pass", F.col("ok")).withColumn("sentence_class", c))


def pairs(spark, d):
    return P.build(candidates(spark, d), FEATURES)


def fixed_model() -> LinearRanker:
    """A model with round numbers, so that SQL can score with the same ones."""
    known = {
        "syllables_per_second": (6.0, 0.5, 0.7), "pitch_median_hz": (235.0, 15.0, -0.2), "pitch_range_st": (9.0, 3.0, 0.4),
        "tail_delta_st": (-2.0, 1.0, -0.3), "final_glide_st_per_s": (4.0, 5.0, 0.25), "final_rebound_st": (3.0, 2.0, 0.15),
    }
    rows = [known.get(n, (0.0, 1.0, 0.0)) for n in FEATURE_NAMES]
    return LinearRanker(FEATURE_NAMES, *(tuple(r[i] for r in rows) for i in range(3)))


UTILITY = """(7e-1*(n_syl/dur-6e0)/5e-1 - 2e-1*(median_hz-235e0)/15e0 + 4e-1*(range_st-9e0)/3e0 - coalesce(3e-1*(tail_delta+2e0)/1e0, 0e0)
  + coalesce(25e-2*(final_glide-4e0)/5e0, 0e0) + coalesce(15e-2*(final_rebound-3e0)/2e0, 0e0))"""
CAND_SQL = f"""
cand AS (SELECT s.*, n.take_id AS pin, CASE WHEN n.take_id=s.take_id THEN 'selected' WHEN n.take_id IS NOT NULL THEN 'not_selected' WHEN NOT ok THEN 'rejected' ELSE 'unknown' END AS decision,
  CASE WHEN question THEN 'question' WHEN forced THEN 'forced' WHEN sentence_final THEN 'final' ELSE 'plain' END AS sentence_class, {UTILITY} AS u
  FROM scored s LEFT JOIN pins n ON n.phrase_id=s.phrase_id),
winner AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY phrase_id) AS c FROM cand WHERE decision='selected' AND ok) q WHERE c = 1),
pairs AS (SELECT w.project_id, w.block_id, w.phrase_id, w.sentence_class, w.text_hash AS sentence_key, w.take_id AS w_take, l.take_id AS l_take, w.u AS u_w, l.u AS u_l,
  1e0/(1e0+exp(-(w.u-l.u))) AS p, w.baseline_score AS w_baseline, l.baseline_score AS l_baseline, w AS w, l AS l
  FROM winner w JOIN cand l ON l.phrase_id=w.phrase_id AND l.decision='not_selected' AND l.ok AND l.take_id<>w.take_id)"""
PAIRED = (*SCORED, B.PINS_SQL, CAND_SQL)


def pairs_self_join(spark, d):
    return pairs(spark, d).select(*KEY, "sentence_class", "sentence_key", "w_take", "l_take")


def normalise_candidate(spark, d):
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(
        F.col("source").alias("project_id"), F.col("lang").alias("block_id"), F.col("doc_id").alias("phrase_id"),
        F.col("quality").alias("take_id"), "text", F.when(F.col("toxic") == 1, "Selected").alias("decision"),
        (F.col("quality") == 1).alias("hard_gate_pass"), F.when(F.col("toxic") == 0, "PASS").alias("hard_gate_status"),
        F.when(F.col("n_chars") > 500, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double")).alias("baseline_score"),
    )
    return P.normalise(rows).select(
        "phrase_id", "take_id", "text_hash", "decision", "hard_gate_pass", "sentence_class", "baseline_score"
    )


def extract_features(spark, d):
    """Features from the row and four maps; what is no finite number there is looked for in the next one."""
    t = B.takes(spark, d)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    pairs_of = lambda **values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    share = lambda n: (F.col("supp") % n) / F.lit(float(n))
    rows = t.select(
        *IDENT, F.when(F.col("numeric_heavy"), F.col("n_syl") / F.col("dur")).alias("rate"), F.col("forced").alias("mos"),
        pairs_of(syllables_per_second=F.lit(1.0), median_hz=F.when(F.col("forced"), nan).otherwise(F.col("median_hz")), speaker_primary_score=share(7)).alias("features"),
        pairs_of(pitch_median_hz=F.lit(200.0), tail_delta=F.col("tail_delta"), final_glide=F.col("final_glide"), content_similarity=share(3)).alias("metrics"),
        pairs_of(relative_tail=F.when(F.col("question"), F.lit(0.5)), final_rebound=F.col("final_rebound"), level_deviation=F.when(F.col("question"), inf).otherwise(share(11)), cer=share(5)).alias("ranking_features"),
        pairs_of(range_st=F.col("range_st"), relative_tail=F.col("range_st") / 10, level_deviation_db=F.lit(3.0), phrase_reset=share(9), mos=F.when(F.col("forced"), F.lit(4.0)), rate=F.lit(9.0)).alias("existing_prosody_metrics"),
    )
    r = P.extract_features(rows)
    return r.select(*IDENT, *[F.round(f"f_{n}", 6).alias(n) for n in FEATURE_NAMES])


FOUND = {
    "syllables_per_second": "CASE WHEN numeric_heavy THEN n_syl/dur ELSE 1e0 END", "pitch_median_hz": "CASE WHEN forced THEN 200e0 ELSE median_hz END", "pitch_range_st": "range_st",
    "tail_delta_st": "tail_delta", "relative_tail": "CASE WHEN question THEN 5e-1 ELSE range_st/1e1 END", "final_glide_st_per_s": "final_glide", "final_rebound_st": "final_rebound",
    "level_deviation_db": "CASE WHEN question THEN 3e0 ELSE (supp % 11)/11e0 END", "phrase_reset_st": "(supp % 9)/9e0", "speaker_similarity_chatterbox": "(supp % 7)/7e0",
    "speaker_similarity_speechbrain": "CAST(NULL AS DOUBLE)", "content_score": "(supp % 3)/3e0", "content_error_rate": "(supp % 5)/5e0", "mos_score": "CASE WHEN forced THEN 4e0 END",
}


def data_sufficiency(spark, d):
    c = candidates(spark, d)
    s = P.sufficiency(c, P.build(c, FEATURES), FEATURES)
    return s.select(
        "status", "pinned_phrase_count", "pair_count", "block_count", "project_count",
        F.round("feature_missing_rate", 6).alias("feature_missing_rate"), F.round("project_concentration", 6).alias("project_concentration"),
        F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"),
        F.array_join(F.transform(F.array_sort(F.map_entries("class_counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("classes"),
    )


def split_groups(spark, d):
    # groups need no features; winners and losers read the judged takes once
    judged = candidates(spark, d).where("hard_gate_pass AND decision IN ('selected', 'not_selected')")
    judged = cut_lineage(judged.select(*IDENT, "decision", "hard_gate_pass", "text_hash", "sentence_class", "baseline_score"))
    g = P.split_groups(P.build(judged, []))
    return g.select(*KEY, "w_take", "l_take", "split_group")


COMPONENT_SQL = """
edges AS (SELECT DISTINCT 'block:' || project_id || ':' || block_id AS u, 'sentence:' || sentence_key AS v FROM pairs),
both_ AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT DISTINCT u AS a, u AS b FROM both_ UNION SELECT r.a, e.v FROM reach r JOIN both_ e ON e.u = r.b),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
grouped AS (SELECT p.*, r.root AS split_group FROM pairs p JOIN roots r ON r.node = 'block:' || p.project_id || ':' || p.block_id)"""
GROUPED_SQL = "WITH RECURSIVE " + ",\n".join([*PAIRED, COMPONENT_SQL])
HELD_SQL = """,
gs AS (SELECT DISTINCT split_group FROM grouped),
held AS (SELECT split_group FROM (SELECT split_group, row_number() OVER (ORDER BY sha256('407:' || split_group), split_group) AS r, count(*) OVER () AS n FROM gs) q
  WHERE r <= greatest(1, least(n-1, CAST(round_even(n*25e-2, 0) AS BIGINT))) AND n >= 2)"""


def grouped(spark, d):
    return cut_lineage(P.split_groups(pairs(spark, d)))


def hash_split(spark, d):
    train, test = P.grouped_split(grouped(spark, d))
    part = lambda df, name: df.select(*KEY, "w_take", "l_take", F.lit(name).alias("part"))
    return part(train, "train").unionByName(part(test, "test"))


def project_holdout(spark, d):
    train, test = P.project_holdout(pairs(spark, d))
    part = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias("pairs")).withColumn("part", F.lit(name))
    return part(train, "train").unionByName(part(test, "test"))


def leakage_check(spark, d):
    """Splitting by phrase alone leaks blocks and sentences; this lists what leaks."""
    p = pairs(spark, d).withColumn("split_group", F.col("phrase_id").cast("string"))
    return P.leakage(p.where("sentence_class IN ('plain', 'final')"), p.where("sentence_class IN ('forced', 'question')"))


def train_test_disjoint(spark, d):
    g = grouped(spark, d)
    train, test = P.grouped_split(g)
    return P.leakage(train, test).groupBy("kind").agg(F.count(F.lit(1)).alias("violations"))


def dataset_hash(spark, d):
    return P.dataset_hash(candidates(spark, d), FEATURES, ["project_id"])


def feature_stats(spark, d):
    r = ranker.feature_stats(pairs(spark, d))
    return r.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "n")


STAT_COLUMNS = {
    "syllables_per_second": "x.n_syl/x.dur", "pitch_median_hz": "x.median_hz", "pitch_range_st": "x.range_st", "tail_delta_st": "x.tail_delta",
    "relative_tail": "x.tail_delta/x.range_st", "final_glide_st_per_s": "x.final_glide", "final_rebound_st": "x.final_rebound",
    "level_deviation_db": "12e0*log2(x.median_hz/235e0)",
}

def cell_sql(name):
    value = STAT_COLUMNS.get(name)
    return f"coalesce(CAST(CAST(round({value},6) AS DECIMAL(30,6)) AS VARCHAR), 'null')" if value else "'null'"


HASH_SQL = B.with_sql(*PAIRED, f"""
rows_ AS (SELECT project_id, sha256(concat_ws('|', project_id, block_id, CAST(phrase_id AS VARCHAR), CAST(take_id AS VARCHAR), decision, CAST(ok AS VARCHAR), text_hash,
  {", ".join(cell_sql(n) for n in FEATURE_NAMES)})) AS r FROM cand x)""", tail=sorted_digest_sql("rows_", "project_id", "r"))
STATS_SQL = B.with_sql(*PAIRED, "sides AS (SELECT w AS x FROM pairs UNION ALL SELECT l FROM pairs)", tail="\nUNION ALL ".join(
    f"""SELECT '{n}' AS feature, round(coalesce(avg({e}),0),6) AS mean, round(CASE WHEN count({e})>=2 AND stddev_pop({e})>1e-12 THEN stddev_pop({e}) ELSE 1 END,6) AS scale, count({e}) AS n FROM sides"""
    for n, e in ((n, STAT_COLUMNS.get(n, "CAST(NULL AS DOUBLE)")) for n in FEATURE_NAMES)))


def score_candidates(spark, d):
    return candidates(spark, d).select(*IDENT, F.round(fixed_model().utility(), 6).alias("utility"))


def artifact_round_trip(spark, d):
    """Scores by a model that was saved and loaded again."""
    path = scratch_path(spark, "artifact")
    ranker.save(spark, ranker.artifact(fixed_model(), "d"), path)
    model, status = ranker.load(spark, path)
    return candidates(spark, d).select(*IDENT, F.lit(status).alias("status"), F.round(model.utility(), 6).alias("utility"))


def preference_probability(spark, d):
    p = pairs(spark, d)
    return p.select(*KEY, "w_take", "l_take", F.round(fixed_model().probability(), 6).alias("p"))


def rank_within_phrase(spark, d):
    r = ranker.rank(candidates(spark, d), fixed_model(), hot=B.hot_phrases(spark, d))
    return r.select(*IDENT, "status", "reason", "rank", F.round("utility", 6).alias("utility"))


def top_confidence(spark, d):
    r = ranker.rank(candidates(spark, d), fixed_model(), hot=B.hot_phrases(spark, d)).where("rank = 1")
    return r.select(*IDENT, F.round("confidence", 6).alias("confidence"), "reduction_allowed")


def scored_pairs(spark, d):
    return fixed_model().score_pairs(pairs(spark, d))


def pair_metrics(spark, d):
    m = metrics.pair_metrics(scored_pairs(spark, d))
    return m.select("pair_count", *[F.round(c, 6).alias(c) for c in ("pairwise_accuracy", "brier_score", "low_confidence_fraction")])


def ece(spark, d):
    m = metrics.pair_metrics(scored_pairs(spark, d))
    return m.select(F.round("expected_calibration_error", 6).alias("ece"))


def rank_metrics(spark, d):
    m = metrics.rank_metrics(metrics.winner_ranks(scored_pairs(spark, d)))
    return m.select("group_count", *[F.round(c, 6).alias(c) for c in ("pin_top1_accuracy", "pin_top3_recall", "mrr", "ndcg")])


def by_class(spark, d):
    # both metrics read the pairs: they are built once
    m = metrics.evaluate(cut_lineage(scored_pairs(spark, d)))
    return m.select("scope", "pair_count", "group_count", *[F.round(c, 6).alias(c) for c in (
        "pairwise_accuracy", "brier_score", "low_confidence_fraction", "expected_calibration_error", "pin_top1_accuracy", "pin_top3_recall", "mrr", "ndcg")])


RANK_SQL = """
once AS (SELECT DISTINCT phrase_id, sentence_class, w_take, l_take, u_w, u_l FROM pairs),
ranks AS (SELECT phrase_id, sentence_class, 1 + count(*) FILTER (round(u_l,9) > round(u_w,9) OR (round(u_l,9) = round(u_w,9) AND l_take < w_take)) AS r FROM once GROUP BY ALL)"""
PAIR_AGG = """count(*) AS pair_count, round(avg((p>5e-1)::INT),6) AS pairwise_accuracy, round(avg((p-1e0)*(p-1e0)),6) AS brier_score, round(avg((abs(p-5e-1)*2e0 < 2e-1)::INT),6) AS low_confidence_fraction"""
RANK_AGG = """count(*) AS group_count, round(avg((r=1)::INT),6) AS pin_top1_accuracy, round(avg((r<=3)::INT),6) AS pin_top3_recall, round(avg(1e0/r),6) AS mrr, round(avg(1e0/log2(r+1e0)),6) AS ndcg"""
ECE_SQL = "SELECT {k} round(sum(abs(n-s))/sum(n),6) AS {name} FROM (SELECT {k} least(floor(p*5),4) AS b, count(*) AS n, sum(p) AS s FROM {src} GROUP BY ALL) q {g}"


def ablation(spark, d):
    m = fixed_model()
    r = metrics.ablation(m.score_pairs(pairs(spark, d)), m.contributions())
    return r.select("feature", F.round("accuracy_delta", 6).alias("accuracy_delta"))


ABLATE = {
    "syllables_per_second": "7e-1*(w.n_syl/w.dur-l.n_syl/l.dur)/5e-1", "pitch_median_hz": "-2e-1*(w.median_hz-l.median_hz)/15e0", "pitch_range_st": "4e-1*(w.range_st-l.range_st)/3e0",
    "tail_delta_st": "-3e-1*(coalesce(w.tail_delta,-2e0)-coalesce(l.tail_delta,-2e0))", "final_glide_st_per_s": "25e-2*(coalesce(w.final_glide,4e0)-coalesce(l.final_glide,4e0))/5e0",
    "final_rebound_st": "15e-2*(coalesce(w.final_rebound,3e0)-coalesce(l.final_rebound,3e0))/2e0",
}
ABLATION_SQL = B.with_sql(*PAIRED, tail="\nUNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg((u_w-u_l-({ABLATE.get(n, '0e0')})>1e-12)::INT)-avg((u_w>u_l)::INT),6) AS accuracy_delta FROM pairs" for n in FEATURE_NAMES))


def baseline_compare(spark, d):
    p = pairs(spark, d)
    r = metrics.baseline_compare(fixed_model().score_pairs(p), p)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def fit_pairwise(spark, d):
    m = ranker.fit(cut_lineage(pairs(spark, d)))
    rows = [(n, round(w, 3)) for n, w in zip(m.names, m.weights)]
    return spark.createDataFrame(rows, "feature string, weight double")


def train_pipeline(spark, d):
    out = ranker.train(cut_lineage(candidates(spark, d)))
    if out["evaluation"] is None:
        return out["sufficiency"].select(F.lit("all").alias("scope"), "status")
    return out["evaluation"]["grouped_holdout"].select(
        "scope", F.lit(out["status"]).alias("status"), "pair_count", F.round("pairwise_accuracy", 6).alias("pairwise_accuracy")
    )


def source_hash_collect(spark, d):
    c = B.takes(spark, d).select(
        F.col("text_hash").alias("source_sha256"), F.when(F.col("forced"), F.upper("text_hash")).otherwise("none").alias("selection_source_sha256"),
        F.sha2(F.concat(F.lit("a"), F.col("n_syl")), 256).alias("audio_sha256"),
    )
    return ranker.source_hashes(c, ("source_sha256", "selection_source_sha256", "audio_sha256"))


def schema_hash(spark, d):
    """Feature schema of each block: the tag of the features that any of its takes has."""
    c = candidates(spark, d)
    seen = c.groupBy("project_id", "block_id").agg(*[F.max(F.col(f).isNotNull()).alias(f) for f in FEATURES])
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(n)) for f, n in zip(FEATURES, FEATURE_NAMES)]))
    return seen.select("project_id", "block_id", F.size(names).alias("n_features"), ranker.schema_hash_of(names).alias("schema_hash"))


SCHEMA_SQL = B.with_sql(*PAIRED, "named AS (SELECT project_id, block_id, [" + ", ".join(
    f"CASE WHEN bool_or({STAT_COLUMNS[n]} IS NOT NULL) THEN '{n}' END" for n in FEATURE_NAMES if n in STAT_COLUMNS) + "] AS names FROM cand x GROUP BY ALL),\nkept AS (SELECT project_id, block_id, list_filter(names, lambda n: n IS NOT NULL) AS names FROM named)",
    tail=f"""SELECT project_id, block_id, len(names) AS n_features, sha256('{{"feature_names":[' || array_to_string(list_transform(names, lambda n: '"' || n || '"'), ',') || '],"feature_version":"{FEATURE_VERSION}"}}') AS schema_hash FROM kept""")
K = "project_id, block_id, phrase_id"
QUERIES = {
    "schema_hash": (schema_hash, SCHEMA_SQL),
    "pairs_self_join": (pairs_self_join, B.with_sql(*PAIRED, tail=f"SELECT {K}, sentence_class, sentence_key, w_take, l_take FROM pairs")),
    "normalise_candidate": (normalise_candidate, f"""SELECT d.doc_id AS phrase_id, coalesce(quality,-1) AS take_id,
        sha256(CASE WHEN t <> '' THEN t ELSE source || '/' || lang || '/' || d.doc_id END) AS text_hash, CASE WHEN toxic=1 THEN 'selected' ELSE 'unknown' END AS decision,
        coalesce(quality=1,false) OR coalesce(toxic=0,false) AS hard_gate_pass, 'unknown' AS sentence_class, CASE WHEN n_chars <= 500 THEN CAST(n_chars AS DOUBLE) END AS baseline_score
        FROM (SELECT *, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+\\z', '', 'g') AS t FROM documents) d LEFT JOIN labels l ON l.doc_id=d.doc_id"""),
    "extract_features": (extract_features, B.with_sql(B.TAKES_SQL, tail=f"SELECT {K}, take_id, " + ", ".join(f"round({e},6) AS {n}" for n, e in FOUND.items()) + " FROM takes")),
    "data_sufficiency": (data_sufficiency, B.with_sql(*PAIRED, tail="""SELECT CASE WHEN ph>=50 AND pc>=150 AND bc>=5 THEN 'sufficient' ELSE 'insufficient_data' END AS status, ph AS pinned_phrase_count, pc AS pair_count, bc AS block_count, prc AS project_count,
        round(miss/(el*14e0),6) AS feature_missing_rate, round(top/CAST(ph AS DOUBLE),6) AS project_concentration,
        rtrim(concat(CASE WHEN ph<50 THEN 'pinned_phrases_below_minimum,' ELSE '' END, CASE WHEN pc<150 THEN 'pairs_below_minimum,' ELSE '' END, CASE WHEN bc<5 THEN 'blocks_below_minimum,' ELSE '' END),',') AS reasons,
        CASE WHEN prc<2 THEN 'project_holdout_unavailable' ELSE '' END AS warnings, classes FROM
        (SELECT count(DISTINCT phrase_id) AS ph, count(*) AS pc, count(DISTINCT project_id||':'||block_id) AS bc, count(DISTINCT project_id) AS prc FROM pairs) a,
        (SELECT sum(6 + CASE WHEN tail_delta IS NULL THEN 4 ELSE 0 END) AS miss, count(*) AS el FROM cand WHERE ok AND decision IN ('selected','not_selected')) b,
        (SELECT max(n) AS top FROM (SELECT project_id, count(DISTINCT phrase_id) AS n FROM pairs GROUP BY ALL) q) c,
        (SELECT string_agg(sentence_class||':'||n, ',' ORDER BY sentence_class) AS classes FROM (SELECT sentence_class, count(DISTINCT phrase_id) AS n FROM pairs GROUP BY ALL) q) e""")),
    "split_groups": (split_groups, GROUPED_SQL + f" SELECT {K}, w_take, l_take, split_group FROM grouped"),
    "hash_split": (hash_split, GROUPED_SQL + HELD_SQL + f" SELECT {K}, w_take, l_take, CASE WHEN split_group IN (SELECT split_group FROM held) THEN 'test' ELSE 'train' END AS part FROM grouped"),
    "pairs_exclude": (lambda spark, d: P.grouped_split(grouped(spark, d))[0].select(*KEY, "w_take", "l_take"),
        GROUPED_SQL + HELD_SQL + f" SELECT {K}, w_take, l_take FROM grouped WHERE split_group NOT IN (SELECT split_group FROM held)"),
    "project_holdout": (project_holdout, B.with_sql(*PAIRED, tail="""SELECT project_id, count(*) AS pairs, CASE WHEN project_id = (SELECT min_by(project_id, sha256('407:'||project_id)) FROM pairs) THEN 'test' ELSE 'train' END AS part FROM pairs GROUP BY project_id""")),
    "leakage_check": (leakage_check, B.with_sql(*PAIRED, """
        tok AS (SELECT sentence_class IN ('plain','final') AS tr, unnest([{'kind':'split_group','value':CAST(phrase_id AS VARCHAR)},{'kind':'block','value':project_id||'/'||block_id},{'kind':'sentence','value':sentence_key}]) AS t FROM pairs)""",
        tail="SELECT t.kind AS kind, t.value AS value FROM tok GROUP BY ALL HAVING bool_or(tr) AND bool_or(NOT tr)")),
    "train_test_disjoint": (train_test_disjoint, GROUPED_SQL + HELD_SQL + """ SELECT 'block' AS kind, count(*) AS violations FROM grouped a JOIN grouped b ON a.project_id=b.project_id AND a.block_id=b.block_id
        WHERE a.split_group IN (SELECT split_group FROM held) AND b.split_group NOT IN (SELECT split_group FROM held) HAVING count(*) > 0"""),
    "dataset_hash": (dataset_hash, HASH_SQL),
    "feature_stats": (feature_stats, STATS_SQL),
    "score_candidates": (score_candidates, B.with_sql(*PAIRED, tail=f"SELECT {K}, take_id, round(u,6) AS utility FROM cand")),
    "artifact_round_trip": (artifact_round_trip, B.with_sql(*PAIRED, tail=f"SELECT {K}, take_id, 'active' AS status, round(u,6) AS utility FROM cand")),
    "preference_probability": (preference_probability, B.with_sql(*PAIRED, tail=f"SELECT {K}, w_take, l_take, round(p,6) AS p FROM pairs")),
    "rank_within_phrase": (rank_within_phrase, B.with_sql(*PAIRED, tail=f"""SELECT {K}, take_id, CASE WHEN ok THEN 'ranked' ELSE 'excluded' END AS status, CASE WHEN NOT ok THEN 'hard_gate_not_pass' END AS reason,
        CASE WHEN ok THEN row_number() OVER (PARTITION BY phrase_id, ok ORDER BY round(u,9) DESC, take_id) END AS rank, CASE WHEN ok THEN round(u,6) END AS utility FROM cand""")),
    "top_confidence": (top_confidence, B.with_sql(*PAIRED, tail=f"""SELECT {K}, take_id, round(c,6) AS confidence, c >= 2e-1 AS reduction_allowed FROM (SELECT *, coalesce(abs(1e0/(1e0+exp(-(u-lead(u) OVER w)))-5e-1)*2e0, 0e0) AS c,
        row_number() OVER w AS r FROM cand WHERE ok WINDOW w AS (PARTITION BY phrase_id ORDER BY round(u,9) DESC, take_id)) q WHERE r=1""")),
    "pair_metrics": (pair_metrics, B.with_sql(*PAIRED, tail=f"SELECT {PAIR_AGG} FROM pairs")),
    "ece": (ece, B.with_sql(*PAIRED, tail=ECE_SQL.format(k="", name="ece", src="pairs", g=""))),
    "rank_metrics": (rank_metrics, B.with_sql(*PAIRED, RANK_SQL, tail=f"SELECT {RANK_AGG} FROM ranks")),
    "by_class": (by_class, B.with_sql(*PAIRED, RANK_SQL, """
        px AS (SELECT 'all' AS scope, * FROM pairs UNION ALL SELECT sentence_class, * FROM pairs), rx AS (SELECT 'all' AS scope, r FROM ranks UNION ALL SELECT sentence_class, r FROM ranks),
        pm AS (SELECT scope, """ + PAIR_AGG + " FROM px GROUP BY scope), rm AS (SELECT scope, " + RANK_AGG + " FROM rx GROUP BY scope), em AS (" +
        ECE_SQL.format(k="scope,", name="expected_calibration_error", src="px", g="GROUP BY scope") + ")", tail="SELECT * FROM pm JOIN rm USING (scope) JOIN em USING (scope)")),
    "ablation": (ablation, ABLATION_SQL),
    "baseline_compare": (baseline_compare, B.with_sql(*PAIRED, tail="""SELECT round(m,6) AS model_accuracy, round(b,6) AS baseline_accuracy, round(br,6) AS baseline_brier, round(m-b,6) AS accuracy_delta FROM (SELECT avg((p>5e-1)::INT) AS m,
        avg((w_baseline>l_baseline)::INT) AS b, avg(power(1e0/(1e0+exp(-greatest(-40e0,least(40e0,w_baseline-l_baseline))))-1e0, 2)) AS br FROM pairs) q""")),
    "fit_pairwise": (fit_pairwise, None),
    "train_pipeline": (train_pipeline, None),
    "source_hash_collect": (source_hash_collect, B.with_sql(B.TAKES_SQL, tail="SELECT text_hash AS sha256 FROM takes UNION SELECT sha256('a'||n_syl) FROM takes")),
}
