"""Preference pairs from explicit choices, and splits that do not leak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.numeric import finite
from ..functions.text import squeeze, strip
from ..session import cut_lineage
from .digest import sorted_digest
from .ordered import number_rows

PHRASE = ["project_id", "block_id", "phrase_id"]


def text_hash(text: Column, *identity: Column) -> Column:
    """sha256 of the whitespace-collapsed text, else of the identity path."""
    squeezed = squeeze(F.coalesce(text, F.lit("")))
    path = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    return F.sha2(F.when(squeezed != "", squeezed).otherwise(path), 256)


# Where a feature may stand, in this order; None is the row itself.
FEATURE_SOURCES = (None, "features", "metrics", "ranking_features", "existing_prosody_metrics")


def extract_features(df: DataFrame, sources: tuple[str | None, ...] = FEATURE_SOURCES) -> DataFrame:
    """Feature columns ``f_*``: the first finite number over sources, then aliases.

    ``None`` names the row itself; other sources are map columns. Boolean
    columns are not numbers.
    """
    types = dict(df.dtypes)

    def lookup(name: str) -> Column:
        found = []
        for source in sources:
            for alias in R.FEATURE_ALIASES[name]:
                if source is None:
                    if alias in types and types[alias] != "boolean":
                        found.append(finite(F.col(alias).try_cast("double")))
                elif source in types:
                    found.append(finite(F.col(source)[alias].try_cast("double")))
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    return df.withColumns({f"f_{n}": lookup(n) for n in R.FEATURE_NAMES})


def normalise(df: DataFrame) -> DataFrame:
    """Candidate rows with defaults applied; missing columns count as missing values."""
    have = set(df.columns)

    def get(name: str, kind: str = "string") -> Column:
        return F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind)

    empty = lambda c: F.coalesce(c, F.lit(""))
    text = strip(empty(get("text")))
    passed = F.coalesce(get("hard_gate_pass", "boolean"), F.lit(False)) | (F.lower(empty(get("hard_gate_status"))) == "pass")
    # a row without a score of its own takes the older one; a score that is no number counts as missing
    baseline = F.when(get("baseline_score").isNotNull(), get("baseline_score", "double")).otherwise(get("existing_quality_score", "double"))
    out = df.withColumns(
        {
            "text": text,
            "text_hash": F.when(empty(get("text_hash")) != "", get("text_hash")).otherwise(
                text_hash(text, *[get(c) for c in PHRASE])
            ),
            "decision": F.lower(F.coalesce(get("decision"), F.lit("unknown"))),
            "hard_gate_pass": passed,
            "sentence_class": F.when(empty(get("sentence_class")) != "", get("sentence_class")).otherwise("unknown"),
            "take_id": F.coalesce(get("take_id", "int"), F.lit(-1)),
            "baseline_score": finite(baseline),
        }
    )
    return out


def build(candidates: DataFrame, features: list[str]) -> DataFrame:
    """One row per (winner, loser): the phrase's only verified pick against each
    verified alternative that the pick left behind.

    The winner comes from a map-side combined aggregate, so the join that
    follows has one small row per phrase on one side; a phrase with very many
    losers only makes the other side of that join long, which AQE splits.
    """
    named = F.col("project_id").isNotNull() & (F.col("project_id") != "") & F.col("block_id").isNotNull() & (
        F.col("block_id") != ""
    ) & F.col("phrase_id").isNotNull() & (F.col("phrase_id").cast("string") != "")
    usable = candidates.where(named & F.col("hard_gate_pass"))
    body = F.struct("take_id", "text_hash", "sentence_class", "baseline_score", *features)
    winners = (
        usable.where("decision = 'selected'")
        .groupBy(*PHRASE)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(body).alias("w"))
        .where("_n = 1")
        .drop("_n")
    )
    losers = usable.where("decision = 'not_selected'").select(*PHRASE, body.alias("l"))
    pair = losers.join(winners, PHRASE).where("l.take_id <> w.take_id")
    return pair.select(
        *PHRASE,
        F.col("w.sentence_class").alias("sentence_class"),
        F.when(F.coalesce(F.col("w.text_hash"), F.lit("")) != "", F.col("w.text_hash"))
        .otherwise(F.col("l.text_hash"))
        .alias("sentence_key"),
        F.col("w.take_id").alias("w_take"),
        F.col("l.take_id").alias("l_take"),
        F.col("w.baseline_score").alias("w_baseline"),
        F.col("l.baseline_score").alias("l_baseline"),
        *[F.col(f"w.{f}").alias(f"w_{f}") for f in features],
        *[F.col(f"l.{f}").alias(f"l_{f}") for f in features],
    )


def sufficiency(candidates: DataFrame, pairs: DataFrame, features: list[str]) -> DataFrame:
    """One row of counts, shares and the reasons why data is or is not enough."""
    winners = pairs.groupBy(*PHRASE).agg(F.min("sentence_class").alias("sentence_class"), F.count(F.lit(1)).alias("n"))
    # one row per block and class: all counts below read this, so pairs are built once
    per = cut_lineage(winners.groupBy("project_id", "block_id", "sentence_class").agg(F.count(F.lit(1)).alias("phrases"), F.sum("n").alias("pairs")))
    per_project = per.groupBy("project_id").agg(F.sum("phrases").alias("n"))
    judged = F.col("hard_gate_pass") & F.col("decision").isin("selected", "not_selected")
    empty_cells = sum((F.col(f).isNull().cast("long") for f in features), F.lit(0).cast("long"))
    cells = candidates.where(judged).agg(
        F.coalesce(F.sum(empty_cells), F.lit(0)).alias("missing"), F.count(F.lit(1)).alias("eligible")
    )
    blocks = per.select("project_id", "block_id").distinct().agg(F.count(F.lit(1)).alias("block_count"))
    whole = per.agg(
        F.coalesce(F.sum("phrases"), F.lit(0)).alias("pinned_phrase_count"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pair_count")
    )
    top = per_project.agg(F.count(F.lit(1)).alias("project_count"), F.max("n").alias("_top"))
    # a handful of class names, never more than the classes themselves
    classes = per.groupBy("sentence_class").agg(F.sum("phrases").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("sentence_class", "n"))).alias("classes")
    )
    one = whole.crossJoin(blocks).crossJoin(top).crossJoin(cells).crossJoin(classes)
    short = F.array_compact(
        F.array(
            F.when(F.col("pinned_phrase_count") < R.MIN_PINNED, F.lit("pinned_phrases_below_minimum")),
            F.when(F.col("pair_count") < R.MIN_PAIRS, F.lit("pairs_below_minimum")),
            F.when(F.col("block_count") < R.MIN_BLOCKS, F.lit("blocks_below_minimum")),
        )
    )
    warn = F.array_compact(
        F.array(
            F.when(F.col("project_count") < R.RECOMMENDED_PROJECTS, F.lit("project_holdout_unavailable")),
            F.when(F.col("eligible") == 0, F.lit("feature_missing_rate_not_measurable")),
        )
    )
    rate = F.try_divide(F.col("missing").cast("double"), F.col("eligible") * F.lit(float(len(features))))
    return one.select(
        F.when(F.size(short) == 0, "sufficient").otherwise("insufficient_data").alias("status"),
        "pinned_phrase_count", "pair_count", "block_count", "project_count",
        rate.alias("feature_missing_rate"),
        F.try_divide(F.col("_top").cast("double"), F.col("pinned_phrase_count")).alias("project_concentration"),
        short.alias("reasons"), warn.alias("warnings"), F.map_from_entries("classes").alias("class_counts"),
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest node name reachable from each node of an undirected graph.

    Alternates "large star" and "small star" steps, which shrink every component
    to a star in a number of rounds that grows with the logarithm of its size,
    also for long chains. A step is a map-side combined minimum and one join; a
    hub's edges never meet in one group. Each round is checkpointed.
    """
    current = cut_lineage(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct()
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        root = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(root, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(root.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = cut_lineage(small)
        now = _state(current)
        if now == before:
            break
        before = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.unionByName(roots)


def split_groups(pairs: DataFrame) -> DataFrame:
    """Adds ``split_group``: blocks and sentences that touch, directly or not, share one.

    Two sentences of a block are one whatever else holds, so each block first
    links its sentences to its smallest one; only those links, between sentences
    alone, go through the rounds. The name of a group is its smallest token.
    """
    # read for the edges and again for the rows: built once
    tokens = cut_lineage(pairs).withColumn("_block", F.concat_ws(":", F.lit("block"), "project_id", "block_id")).withColumn(
        "_sentence", F.concat_ws(":", F.lit("sentence"), "sentence_key")
    )
    edges = tokens.select("_block", "_sentence").distinct()
    heads = edges.groupBy("_block").agg(F.min("_sentence").alias("_head"))
    links = edges.join(heads, "_block").select("_sentence", "_head").where("_sentence <> _head").distinct()
    found = components(links, "_sentence", "_head").select(F.col("node").alias("_head"), "root")
    # a sentence without links stands alone
    placed = heads.join(found, "_head", "left").select("_block", F.coalesce("root", "_head").alias("_root"))
    names = placed.groupBy("_root").agg(F.min("_block").alias("_first"))
    roots = placed.join(names, "_root").select("_block", F.least("_first", "_root").alias("split_group"))
    return tokens.join(roots, "_block").drop("_block", "_sentence")


def test_groups(pairs: DataFrame, fraction: float = R.TEST_FRACTION, seed: int = R.SPLIT_SEED) -> DataFrame:
    """The groups held out: first ones by hash, at least one, never all."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("test_fraction must be between zero and one")
    groups = pairs.select("split_group").distinct().withColumn(
        "_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("split_group")), 256)
    )
    total = groups.agg(F.count(F.lit(1)).alias("_n"))
    placed = number_rows(groups, [], [F.col("_h"), F.col("split_group")], [F.substring("_h", 1, 4)], "_rank")
    wanted = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * F.lit(float(fraction))).cast("long")))
    return (
        placed.crossJoin(F.broadcast(total))
        .where((F.col("_rank") <= wanted) & (F.col("_n") >= 2))
        .select("split_group")
    )


def grouped_split(
    pairs: DataFrame, fraction: float = R.TEST_FRACTION, seed: int = R.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    held = test_groups(pairs, fraction, seed)
    return pairs.join(held, "split_group", "left_anti"), pairs.join(held, "split_group", "left_semi")


def project_holdout(
    pairs: DataFrame, project: str | None = None, seed: int = R.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Train on all other projects; the held-out one is named, or first by hash."""
    found = pairs.agg(
        F.min_by("project_id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("project_id")), 256)).alias("first"),
        F.count_distinct("project_id").alias("n"),
        F.bool_or(F.col("project_id") == F.lit(project)).alias("known"),
    ).first()
    if found["n"] < 2:
        raise ValueError("project holdout requires at least two projects")
    if project is not None and not found["known"]:
        raise ValueError("holdout project is absent from the dataset")
    held = project if project is not None else found["first"]
    return pairs.where(F.col("project_id") != held), pairs.where(F.col("project_id") == held)


def leakage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Every group, block or sentence on both sides; empty when the split is clean."""

    def tokens(df: DataFrame) -> DataFrame:
        packed = F.array(
            F.struct(F.lit("split_group").alias("kind"), F.col("split_group").alias("value")),
            F.struct(F.lit("block").alias("kind"), F.concat_ws("/", "project_id", "block_id").alias("value")),
            F.struct(F.lit("sentence").alias("kind"), F.col("sentence_key").alias("value")),
        )
        return df.select(F.inline(packed)).distinct()

    return tokens(train).intersect(tokens(test))


def dataset_hash(candidates: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Hash over identity, decision, gate, text and features of all candidates in order."""
    cells = [F.coalesce(F.round(F.col(f), 6).cast("decimal(30,6)").cast("string"), F.lit("null")) for f in features]
    row = F.concat_ws(
        "|", "project_id", "block_id", F.col("phrase_id").cast("string"), F.col("take_id").cast("string"), "decision",
        F.col("hard_gate_pass").cast("string"), "text_hash", *cells,
    )
    return sorted_digest(candidates, row, keys)
