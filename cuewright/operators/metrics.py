"""Ranking metrics over preference pairs, as aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid

PHRASE = ["project_id", "block_id", "phrase_id"]
BINS = 5


def scored_pairs(pairs: DataFrame, winner: Column, loser: Column, limit: float = 700.0) -> DataFrame:
    """Adds utilities ``u_w, u_l`` and the winner's probability ``p``."""
    return pairs.withColumns({"u_w": winner, "u_l": loser}).withColumn("p", sigmoid(F.col("u_w") - F.col("u_l"), limit))


def pair_metrics(scored: DataFrame, by: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Accuracy, Brier, low-confidence share and calibration error.

    One pass: sums per probability bin (combined map-side), then a fold of at
    most ``bins`` rows per key.
    """
    by = by or []
    p = F.col("p")
    cells = scored.groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p > 0.5).alias("hits"),
        F.sum((p - 1.0) * (p - 1.0)).alias("brier"),
        F.sum(p).alias("mass"),
        F.count_if(F.abs(p - 0.5) * 2.0 < 0.20).alias("unsure"),
    )
    n = F.sum("n").cast("double")
    return cells.groupBy(*by).agg(
        F.sum("n").alias("pair_count"),
        (F.sum("hits") / n).alias("pairwise_accuracy"),
        (F.sum("brier") / n).alias("brier_score"),
        (F.sum("unsure") / n).alias("low_confidence_fraction"),
        (F.sum(F.abs(F.col("n") - F.col("mass"))) / n).alias("expected_calibration_error"),
    )


def winner_ranks(scored: DataFrame) -> DataFrame:
    """Rank of each phrase's winner among its distinct candidates, by counting who beats it."""
    once = scored.groupBy(*PHRASE, "sentence_class", "l_take").agg(
        F.max("u_l").alias("u_l"), F.max("u_w").alias("u_w"), F.max("w_take").alias("w_take")
    )
    ours, theirs = F.round("u_w", 9), F.round("u_l", 9)
    ahead = (theirs > ours) | ((theirs == ours) & (F.col("l_take") < F.col("w_take")))
    return once.groupBy(*PHRASE, "sentence_class").agg((F.count_if(ahead) + 1).alias("winner_rank"))


def rank_metrics(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    r = F.col("winner_rank")
    return ranks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.avg((r == 1).cast("double")).alias("pin_top1_accuracy"),
        F.avg((r <= 3).cast("double")).alias("pin_top3_recall"),
        F.avg(F.lit(1.0) / r).alias("mrr"),
        F.avg(F.lit(1.0) / F.log2(r + 1.0)).alias("ndcg"),
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """All metrics for the whole set (class 'all') and per sentence class, in two passes."""
    rows = F.explode(F.array(F.lit("all"), F.col("sentence_class"))).alias("scope")
    pair_part = pair_metrics(scored.select("p", rows), ["scope"])
    ranks = winner_ranks(scored)
    rank_part = rank_metrics(ranks.select("winner_rank", rows), ["scope"])
    return pair_part.join(rank_part, "scope")


def baseline(pairs: DataFrame) -> DataFrame:
    """Pairs scored by the stored baseline: missing counts as 0, differences clamp at 40."""
    zero = F.lit(0.0)
    return scored_pairs(pairs, F.coalesce("w_baseline", zero), F.coalesce("l_baseline", zero), 40.0)


def baseline_compare(model_scored: DataFrame, pairs: DataFrame) -> DataFrame:
    model = pair_metrics(model_scored).select(F.col("pairwise_accuracy").alias("model_accuracy"))
    base = pair_metrics(baseline(pairs)).select(
        F.col("pairwise_accuracy").alias("baseline_accuracy"), F.col("brier_score").alias("baseline_brier")
    )
    return model.crossJoin(base).withColumn("accuracy_delta", F.col("model_accuracy") - F.col("baseline_accuracy"))


def ablation(scored: DataFrame, contributions: dict[str, Column]) -> DataFrame:
    """Accuracy change when one feature's weight is zeroed, all features in one aggregate."""
    gap = F.col("u_w") - F.col("u_l")
    names = list(contributions)
    sums = [F.avg((gap > 0).cast("double")).alias("_full")] + [
        F.avg((gap - contributions[n] > 1e-12).cast("double")).alias(f"_a{i}") for i, n in enumerate(names)
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(f"_a{i}") - F.col("_full")).alias("accuracy_delta")) for i, n in enumerate(names)])
    return scored.agg(*sums).select(F.inline(listed))
