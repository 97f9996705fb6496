"""A linear preference ranker: fitted by Spark ML, applied as one column expression."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.numeric import sigmoid
from . import metrics, pairs as P
from .ordered import Hot, number_with_next

PHRASE = P.PHRASE


def schema_hash(names: tuple[str, ...] = R.FEATURE_NAMES) -> str:
    text = json.dumps({"feature_version": R.FEATURE_VERSION, "feature_names": list(names)}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def schema_hash_of(names: Column) -> Column:
    """The same tag for an array of names in their order."""
    return F.sha2(F.to_json(F.struct(names.alias("feature_names"), F.lit(R.FEATURE_VERSION).alias("feature_version"))), 256)


@dataclass(frozen=True)
class LinearRanker:
    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float = 0.0
    seed: int = R.SPLIT_SEED
    model_version: str = R.MODEL_VERSION
    extras: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        sizes = {len(v) for v in (self.names, self.means, self.scales, self.weights)}
        if len(sizes) > 1:
            raise ValueError(f"names, means, scales and weights differ in length: {sorted(sizes)}")
        if not all(math.isfinite(s) and s > 0 for s in self.scales):
            raise ValueError("a scale is zero, negative or not finite")

    def term(self, i: int, prefix: str) -> Column:
        """Contribution of one feature; a missing value sits at the mean and adds 0."""
        x = F.col(f"{prefix}{self.names[i]}")
        return F.coalesce((x - F.lit(self.means[i])) / F.lit(self.scales[i]), F.lit(0.0)) * F.lit(self.weights[i])

    def utility(self, prefix: str = "f_") -> Column:
        return sum((self.term(i, prefix) for i in range(len(self.names))), F.lit(0.0))

    def probability(self, winner: str = "w_f_", loser: str = "l_f_") -> Column:
        return sigmoid(F.lit(self.intercept) + self.utility(winner) - self.utility(loser))

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        return metrics.scored_pairs(pairs, self.utility("w_f_"), self.utility("l_f_"))

    def contributions(self) -> dict[str, Column]:
        return {n: self.term(i, "w_f_") - self.term(i, "l_f_") for i, n in enumerate(self.names)}


def feature_stats(pairs: DataFrame, names: tuple[str, ...] = R.FEATURE_NAMES) -> DataFrame:
    """Mean and population deviation of each feature over all winner and loser occurrences.

    One aggregate over the pairs with both sides unpacked in place.
    """
    sides = F.array(*[F.struct(*[F.col(f"{s}_f_{n}").alias(n) for n in names]) for s in ("w", "l")])
    one = pairs.select(F.inline(sides)).agg(
        *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)],
        *[F.count(n).alias(f"c{i}") for i, n in enumerate(names)],
    )

    def entry(i: int, n: str) -> Column:
        usable = (F.col(f"c{i}") >= 2) & (F.col(f"s{i}") > 1e-12)
        return F.struct(
            F.lit(n).alias("feature"), F.coalesce(f"m{i}", F.lit(0.0)).alias("mean"),
            F.when(usable, F.col(f"s{i}")).otherwise(1.0).alias("scale"), F.col(f"c{i}").alias("n"),
        )

    return one.select(F.inline(F.array(*[entry(i, n) for i, n in enumerate(names)])))


def fit(
    pairs: DataFrame, names: tuple[str, ...] = R.FEATURE_NAMES, l2: float = R.L2,
    mos_multiplier: float = R.MOS_L2_MULTIPLIER, seed: int = R.SPLIT_SEED, max_iter: int = 100,
) -> LinearRanker:
    """Regularised logistic fit on standardised differences.

    A difference d labelled 1 and -d labelled 0 carry the same loss, so half of
    the pairs (by hash) enter mirrored instead of all of them twice, and the
    intercept is 0. The stronger penalty on ``mos_score`` is a column scale.
    """
    stats = {r["feature"]: r for r in feature_stats(pairs, names).collect()}  # one row per feature name
    if not stats or all(r["n"] == 0 for r in stats.values()):
        raise ValueError("at least one training pair is required")
    means = tuple(float(stats[n]["mean"]) for n in names)
    scales = tuple(float(stats[n]["scale"]) for n in names)
    shrink = tuple(mos_multiplier**-0.5 if n == "mos_score" else 1.0 for n in names)
    mirrored = (F.pmod(F.xxhash64(*PHRASE, "w_take", "l_take"), F.lit(2)) == 0)
    sign = F.when(mirrored, -1.0).otherwise(1.0)

    def gap(i: int, n: str) -> Column:
        fill = F.lit(means[i])
        return sign * (F.coalesce(f"w_f_{n}", fill) - F.coalesce(f"l_f_{n}", fill)) / F.lit(scales[i]) * F.lit(shrink[i])

    rows = pairs.select(
        *[gap(i, n).alias(n) for i, n in enumerate(names)], F.when(mirrored, 0.0).otherwise(1.0).alias("label")
    )
    data = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows).select("features", "label")
    model = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=l2, elasticNetParam=0.0, maxIter=max_iter, tol=1e-8
    ).fit(data)
    weights = tuple(float(w) * s for w, s in zip(model.coefficients.toArray(), shrink))
    return LinearRanker(tuple(names), means, scales, weights, 0.0, seed)


def rank(
    candidates: DataFrame, model: LinearRanker, threshold: float = R.CONFIDENCE_THRESHOLD, hot: Hot = None
) -> DataFrame:
    """Ranks of hard-gate passes per phrase; the rest are listed as excluded.

    Adds ``rank``, ``status``, ``reason``, and on rank 1 ``confidence`` and
    whether it is enough to drop the others. Gathers no phrase.
    """
    scored = candidates.withColumn("utility", model.utility())
    best = F.round("utility", 9)
    ranked = number_with_next(
        scored.where("hard_gate_pass"), PHRASE, [best.desc(), F.col("take_id")], [F.coalesce(F.floor(-best * 64), F.lit(1 << 50))], "rank",
        {"_second": "utility"}, hot,
    )
    margin = F.abs(sigmoid(F.col("utility") - F.col("_second")) - 0.5) * 2.0
    confidence = F.when(F.col("rank") == 1, F.coalesce(margin, F.lit(0.0)))
    ranked = ranked.withColumn("confidence", confidence).drop("_second")
    out = scored.where("NOT coalesce(hard_gate_pass, false)").withColumns(
        {"rank": F.lit(None).cast("bigint"), "confidence": F.lit(None).cast("double")}
    ).withColumn("utility", F.lit(None).cast("double"))
    return ranked.unionByName(out).withColumns(
        {
            "status": F.when(F.col("rank").isNull(), "excluded").otherwise("ranked"),
            "reason": F.when(F.col("rank").isNull(), "hard_gate_not_pass"),
            "reduction_allowed": F.col("confidence") >= threshold,
        }
    )


def source_hashes(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct 64-digit hex hashes over several columns, one per row."""
    values = F.explode(F.array(*[F.lower(F.col(c)) for c in columns])).alias("sha256")
    return df.select(values).where(F.col("sha256").rlike("^[0-9a-f]{64}$")).distinct()


def train(candidates: DataFrame, seed: int = R.SPLIT_SEED, fraction: float = R.TEST_FRACTION) -> dict:
    """Sufficiency, pairs, grouped split, leakage check, evaluation, project holdout, final fit.

    Returns the status, one-row and few-row report DataFrames, and the model.
    The pair table is written once and read by every later step.
    """
    features = [f"f_{n}" for n in R.FEATURE_NAMES]
    pairs = P.cut_lineage(P.build(candidates, features))
    enough = P.sufficiency(candidates, pairs, features)
    verdict = enough.select("status", "project_count").first()
    if verdict["status"] != "sufficient":
        return {"status": "insufficient_data", "model": None, "sufficiency": enough, "evaluation": None}
    grouped = P.cut_lineage(P.split_groups(pairs))
    train_rows, test_rows = P.grouped_split(grouped, fraction, seed)
    if not P.leakage(train_rows, test_rows).isEmpty():
        raise ValueError("block or sentence leakage detected")
    held = fit(train_rows, seed=seed)
    scored = held.score_pairs(test_rows)
    report = {
        "grouped_holdout": metrics.evaluate(scored),
        "baseline": metrics.baseline_compare(scored, test_rows),
        "ablation": metrics.ablation(scored, held.contributions()),
    }
    if verdict["project_count"] >= 2:
        project_train, project_test = P.project_holdout(grouped, seed=seed)
        report["project_holdout"] = metrics.evaluate(fit(project_train, seed=seed).score_pairs(project_test))
    return {"status": "trained", "model": fit(grouped, seed=seed), "sufficiency": enough, "evaluation": report}


def artifact(model: LinearRanker | None, dataset_digest: str | None = None) -> dict:
    """The stored form; without a model it records that data was insufficient."""
    head = {
        "artifact_schema_version": R.ARTIFACT_SCHEMA_VERSION,
        "feature_version": R.FEATURE_VERSION,
        "feature_schema_hash": schema_hash(),
    }
    if model is None:
        return {**head, "status": "insufficient_data", "model": None}
    body = {k: v for k, v in asdict(model).items() if k != "extras"}
    return {**head, "training_dataset_hash": dataset_digest, "model": {**body, "feature_schema_hash": schema_hash(model.names)}}


def save(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON document; an existing artifact is never overwritten."""
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


#: An artifact as Spark reads it; what does not fit reads as null.
ARTIFACT = (
    "artifact_schema_version string, status string, feature_schema_hash string, model struct<names: array<string>, means: array<double>, "
    "scales: array<double>, weights: array<double>, intercept: double, seed: bigint, model_version: string>"
)
# The reasons for refusing an artifact, in the order in which they are asked.
REFUSALS = (
    ("artifact_schema_mismatch", "NOT artifact_schema_version <=> '{schema}'"),
    ("insufficient_data", "status <=> 'insufficient_data' OR model IS NULL"),
    ("feature_schema_mismatch", "NOT feature_schema_hash <=> '{features}'"),
    ("invalid_model:KeyError", "model.names IS NULL OR model.means IS NULL OR model.scales IS NULL OR model.weights IS NULL OR model.intercept IS NULL OR model.seed IS NULL OR model.model_version IS NULL"),
    ("invalid_model:ValueError", "size(array_distinct(array(size(model.names), size(model.means), size(model.scales), size(model.weights)))) > 1 OR NOT forall(model.scales, s -> coalesce(s > 0 AND s < double('infinity'), false))"),
    ("model_feature_schema_mismatch", "array_join(model.names, ',') <> '{names}'"),
    ("model_version_mismatch", "model.model_version <> '{version}'"),
)


def load(spark: SparkSession, path: str, names: tuple[str, ...] = R.FEATURE_NAMES) -> tuple[LinearRanker | None, str]:
    """The model, or None and the first reason for refusing it."""
    known = {"schema": R.ARTIFACT_SCHEMA_VERSION, "features": schema_hash(names), "names": ",".join(names), "version": R.MODEL_VERSION}
    verdict = F.lit(None).cast("string")
    for reason, condition in reversed(REFUSALS):
        verdict = F.when(F.expr(condition.format(**known)), F.lit(reason)).otherwise(verdict)
    try:
        document = spark.read.text(path, wholetext=True).select(F.from_json("value", ARTIFACT).alias("a")).select("a.*")
        row = document.withColumn("refused", verdict).first()
    except AnalysisException as exc:
        return None, f"artifact_unreadable:{type(exc).__name__}"
    if row is None or row["refused"] is not None:
        return None, row["refused"] if row else "artifact_unreadable:empty"
    return LinearRanker(**{k: tuple(v) if isinstance(v, list) else v for k, v in row["model"].asDict().items()}), "active"
