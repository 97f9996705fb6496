"""A revisioned history of sources, takes and explicit choices, kept as Parquet tables.

Row ids are content keys (sha256 of the natural key), so writers need no counter
and a replayed batch produces the same ids. ``seq`` orders deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..session import cut_lineage
from .ordered import join_null_safe

IDENTITY = ["project_id", "block_id", "phrase_id", "take_id"]
PHRASE = IDENTITY[:3]
REVISION = ["project_id", "path", "sha256"]


def key_of(*columns: str) -> Column:
    """Hash of named values; neither separators inside them nor nulls make two keys one."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def new_revisions(deliveries: DataFrame, known: DataFrame | None = None, along: tuple[str, ...] = ()) -> DataFrame:
    """First delivery of each (project, path, sha256) not yet known.

    ``min_by`` combines map-side, so a file delivered a billion times costs one
    row per map task. ``deliveries``: project_id, path, sha256, seq, ... ``along``
    names further columns that a revision determines.
    """
    at = [*along, *REVISION]
    rest = [c for c in deliveries.columns if c not in at]
    first = deliveries.groupBy(*at).agg(F.min_by(F.struct(*rest), "seq").alias("_first")).select(*at, "_first.*")
    return first if known is None else first.join(known.select(*at), at, "left_anti")


def revisions_not_stored(deliveries: DataFrame, stored: DataFrame, along: tuple[str, ...] = ()) -> DataFrame:
    """``new_revisions`` against stored ones, null names included.

    Stored revisions travel as 32 bytes each and meet the deliveries in their
    groups; deliveries that lie by ``along`` already stay where they are.
    """
    revision = F.unhex(key_of(*REVISION)).alias("_revision")
    rest = [c for c in deliveries.columns if c not in along]
    marks = stored.select(*along, revision)
    rows = deliveries.select(*along, revision, "seq", F.struct(*rest).alias("_row"))
    both = rows.unionByName(marks.repartition(*along) if along else marks, allowMissingColumns=True)
    grouped = both.groupBy(*along, "_revision").agg(F.min_by("_row", "seq").alias("_first"), F.bool_or(F.col("_row").isNull()).alias("_stored"))
    return grouped.where("NOT _stored").select(*along, "_first.*")


def ingest_outcomes(deliveries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per project: inserted, unchanged and error counts of one run.

    Deliveries carry ``error`` (null when readable). Everything is an aggregate
    over distinct revisions; no delivery list is ever gathered.
    """
    good = deliveries.where("error IS NULL")
    fresh = new_revisions(good, known).groupBy("project_id").agg(F.count(F.lit(1)).alias("inserted"))
    seen = deliveries.groupBy("project_id").agg(
        F.count_if(F.col("error").isNull()).alias("_good"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
    return seen.join(fresh, "project_id", "left").select(
        "project_id",
        F.coalesce("inserted", F.lit(0)).alias("inserted"),
        (F.col("_good") - F.coalesce("inserted", F.lit(0))).alias("unchanged"),
        "errors",
    )


def with_pin(phrases: DataFrame, pins: DataFrame) -> DataFrame:
    """Phrases with the take that their pin names; takes that join them need not be shuffled again for their pin."""
    return phrases.join(pins.select(*PHRASE, F.col("take_id").alias("pinned_take")), PHRASE, "left")


def pin_decision(takes: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """selected / not_selected by the phrase's pin; rejected by the gate; else unknown.

    Without ``pins`` the takes carry the ``pinned_take`` of their phrase.
    """
    refused = (F.col("ok") == F.lit(False)) & (F.size("why") > 0)
    return (
        (takes if pins is None else with_pin(takes, pins))
        .withColumn(
            "decision",
            F.when(F.col("pinned_take") == F.col("take_id"), "selected")
            .when(F.col("pinned_take").isNotNull(), "not_selected")
            .when(refused, "rejected")
            .otherwise("unknown"),
        )
        .withColumn("rejected_reason", F.when(F.col("decision") == "rejected", F.array_join("why", ",")))
        .drop("pinned_take")
    )


def take_rows(fresh: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Bank rows of new revisions: decision and derived measures."""
    return pin_decision(fresh, pins).withColumns(
        {
            "syllables_per_second": ratio(F.col("n_syl"), F.col("dur")),
            "relative_tail": ratio(F.col("tail_delta"), F.col("range_st")),
        }
    )


def selection_events(takes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One 'selected' event per (revision, identity); replays add nothing."""
    at = ["revision_id", *IDENTITY, "event_type"]
    events = (
        takes.where("decision = 'selected'")
        .withColumn("event_type", F.lit("selected"))
        .groupBy(*at)
        .agg(F.min("seq").alias("event_seq"))
    )
    return events if known is None else events.join(known.select(*at), at, "left_anti")


def take_history(
    takes: DataFrame, revisions: DataFrame, sources: DataFrame, revision: tuple = ("revision_id",), source: tuple = ("source_id",)
) -> DataFrame:
    """Takes with their revision and source. Order at the sink, where it is cheap to ask for.

    ``revision`` and ``source`` name the columns that identify them, null like any
    other value; ``revisions`` holds those of both. Revisions meet their sources
    first, as takes are the wider rows.
    """
    return join_null_safe(takes, join_null_safe(revisions, sources, list(source)), list(revision))


def selected_with_features(
    takes: DataFrame, events: DataFrame, revisions: DataFrame, sources: DataFrame
) -> DataFrame:
    """Takes with each of their selection events and the source of that choice."""
    origin = (
        revisions.join(sources, "source_id")
        .select(
            F.col("revision_id").alias("pin_revision_id"),
            F.col("path").alias("selection_source_path"),
            F.col("sha256").alias("selection_source_sha256"),
        )
    )
    return takes.join(events.select(*IDENTITY, "event_type", "pin_revision_id"), IDENTITY).join(
        origin, "pin_revision_id"
    )


def latest_pin_hash(takes: DataFrame, events: DataFrame) -> DataFrame:
    """Hash of the pin file behind the newest event of each take, null where none."""
    newest = events.groupBy(*IDENTITY).agg(F.max_by("pin_sha256", "event_seq").alias("selection_source_sha256"))
    return takes.join(newest, IDENTITY, "left")


def latest_revision(takes: DataFrame, order: str = "revision_seq") -> DataFrame:
    """Newest row per take identity, without sorting a group."""
    rest = [c for c in takes.columns if c not in IDENTITY]
    return takes.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*IDENTITY, "_r.*")


def gate_status(metrics_json: Column) -> Column:
    """pass / fail / unknown from a stored metrics document."""
    flag = F.get_json_object(metrics_json, "$.hard_gate_pass")
    text = F.lower(F.coalesce(F.get_json_object(metrics_json, "$.hard_gate_status"), F.lit("")))
    return (
        F.when((flag == "true") | (text == "pass"), "pass")
        .when((flag == "false") | (text == "fail"), "fail")
        .otherwise("unknown")
    )


def training_rows(takes: DataFrame, events: DataFrame, project_id: str | None = None) -> DataFrame:
    """Newest explicitly judged row per take, with gate evidence made explicit."""
    judged = takes.where(F.col("decision").isin("selected", "not_selected"))
    if project_id is not None:
        judged = judged.where(F.col("project_id") == project_id)
    status = gate_status(F.col("metrics_json"))
    rows = latest_revision(judged).withColumn("hard_gate_status", status)
    return latest_pin_hash(rows, events).withColumn("hard_gate_pass", F.col("hard_gate_status") == "pass")


def latest_issue(issues: DataFrame) -> DataFrame:
    """Newest revision per issue, and the number its next revision will carry."""
    rest = [c for c in issues.columns if c != "issue_id"]
    newest = issues.groupBy("issue_id").agg(F.max_by(F.struct(*rest), "revision").alias("_r"))
    return newest.select("issue_id", "_r.*", (F.col("_r.revision") + 1).alias("next_revision"))


def retest(previous: DataFrame) -> DataFrame:
    """The follow-up revision of each issue row given its ``outcome``."""
    return previous.withColumn("revision", F.col("revision") + 1).withColumn(
        "status", F.when(F.col("outcome") == "RESOLVED", "RESOLVED").otherwise("RETESTED")
    )


class Bank:
    """Tables under one folder, each a directory of ``run_id=...`` partitions written once.

    A row in ``runs`` is written last and makes a run visible, also one that
    brought nothing but errors. A run that was interrupted before can be repeated
    under its id; a finished one cannot. Takes are stored once, with the names of
    their revision: ``revisions`` is a view of them, and the revision id, a hash of
    those names, is computed where it is read.
    """

    TABLES = ("revisions", "takes", "events", "errors")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str) -> DataFrame:
        """Rows of finished runs."""
        if name == "revisions":
            return self.table("takes").select(*REVISION, "seq", "revision_id", "run_id")
        rows = self.spark.read.parquet(self.path(name)).withColumn("run_id", F.col("run_id").cast("string"))
        rows = rows.join(self.runs().select("run_id"), "run_id", "left_semi")
        return rows.withColumn("revision_id", key_of(*REVISION)) if name == "takes" else rows

    def runs(self) -> DataFrame:
        return self.spark.read.schema("run_id string, revisions bigint").parquet(self.path("runs"))

    def finished(self, run_id: str) -> bool:
        return self.exists(f"runs/of={run_id}")

    def _append(self, name: str, df: DataFrame, run_id: str) -> DataFrame:
        """The rows as they were written; replaces what an interrupted run of this id has left."""
        at = f"{self.path(name)}/run_id={run_id}"
        # zstd: hashes in letters take half the room
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.parquet(at)

    def ingest(self, parsed: DataFrame, pins: DataFrame | None, run_id: str, along: tuple[str, ...] = ()) -> DataFrame:
        """One idempotent run. ``parsed`` carries project_id, path, sha256, seq, error and the take fields.

        Known revisions are skipped whole: their decisions do not change even if
        pins did. Without ``pins`` the takes carry the ``pinned_take`` of their phrase.
        ``along`` names columns that a revision determines and by which ``parsed``
        is dealt out already; no take is shuffled again then. Returns
        inserted/unchanged/errors per project.
        """
        if self.finished(run_id):
            raise ValueError(f"run {run_id} is finished")
        # one row per project
        seen = cut_lineage(
            parsed.groupBy("project_id").agg(F.count_if(F.col("error").isNull()).alias("_good"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        )
        good = parsed.where("error IS NULL").drop("error")
        if not seen.where("_good > 0").head(1):
            fresh = good.where(F.lit(False))
        elif self.exists("runs"):
            fresh = revisions_not_stored(good, self.table("takes"), along)
        else:
            fresh = new_revisions(good, along=along)
        written = self._append("takes", take_rows(fresh, pins), run_id)
        inserted = written.groupBy("project_id").agg(F.count(F.lit(1)).alias("_new"))
        counted = join_null_safe(seen, inserted, ["project_id"], "left").withColumn("inserted", F.coalesce("_new", F.lit(0)))
        stats = self._append(
            "stats", counted.select("project_id", "inserted", (F.col("_good") - F.col("inserted")).alias("unchanged"), "errors"), run_id
        )
        self._append("events", selection_events(written.withColumn("revision_id", key_of(*REVISION))), run_id)
        self._append("errors", parsed.where("error IS NOT NULL").select("project_id", "path", "error"), run_id)
        # last, so that an interrupted run leaves nothing marked as known
        count = written.agg(F.lit(run_id).alias("run_id"), F.count(F.lit(1)).alias("revisions"))
        count.write.mode("errorifexists").parquet(f"{self.path('runs')}/of={run_id}")
        return stats
