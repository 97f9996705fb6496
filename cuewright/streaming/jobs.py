"""Streaming queries over session events and file deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from ..operators import sessions
from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVISION = ["project_id", "path", "sha256"]


def folder_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Parquet files below a folder (or a pattern of folders) as they arrive."""
    return spark.readStream.schema(schema).options(recursiveFileLookup="true", **options).parquet(path)


def keyed(events: DataFrame, processor, lateness: str, key: str = "session_id") -> DataFrame:
    """Runs an ordered processor per session behind a watermark; state lives in RocksDB, so it may exceed memory.

    ``events`` has the event time ``ts``. Rows later than ``lateness`` would be
    dropped here; ``split_late`` keeps them apart before.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", lateness).select(key, "ts", F.unix_micros("ts").alias("at"), *processor.INPUT)
    return rows.groupBy(key).transformWithState(
        statefulProcessor=processor(), outputStructType=processor.OUTPUT, outputMode="append", timeMode="EventTime"
    )


def append_to(stream: DataFrame, base: str) -> StreamingQuery:
    """Appends all that is there to ``base/out``, exactly once over any number of runs."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )


def deliver(parts: Iterable[DataFrame], inbox: str, steps: list[Callable[[], StreamingQuery]]) -> None:
    """Puts the parts into ``inbox`` one after the other and lets every step work off each.

    Steps stop and start again from their checkpoints in between, as scheduled runs do.
    """
    for i, part in enumerate(parts):
        part.write.parquet(f"{inbox}/part={i}")
        for step in steps:
            step().awaitTermination()


# ---- late rows ------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def split_late(events: DataFrame, base: str, lateness: str) -> StreamingQuery:
    """Sends each row to ``base/rows/batch=*/late=false`` or, if it is too late, to ``late=true``.

    A row is late if it lies more than ``lateness`` behind the newest row of all
    earlier batches. Each batch writes the newest time so far, so a batch needs
    only the one before; a batch that was written whole is not written again, so
    a replay neither moves nor doubles a row. Whatever reads the rows in time with
    the same lateness as its watermark drops none of them.
    """
    spark = events.sparkSession

    def route(batch: DataFrame, batch_id: int) -> None:
        target, before = f"{base}/rows/batch={batch_id}", f"{base}/newest/batch={batch_id - 1}"
        known = spark.read.parquet(before).first()["newest"] if batch_id else None
        if not _exists(spark, f"{target}/_SUCCESS"):
            horizon = F.lit(known).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
            late = F.coalesce(F.col("ts") < horizon, F.lit(False))
            batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(target)
        newest = spark.read.schema(batch.schema).parquet(target).agg(F.greatest(F.max("ts"), F.lit(known).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{base}/newest/batch={batch_id}")

    return events.writeStream.foreachBatch(route).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()


def in_time(spark: SparkSession, base: str, schema) -> DataFrame:
    """The stream of rows that ``split_late`` found in time."""
    return folder_stream(spark, f"{base}/rows/batch=*/late=false", schema)


def late_rows(spark: SparkSession, base: str, schema) -> DataFrame:
    """The side table of late rows, with the batch in which each arrived."""
    rows = spark.read.schema(StructType([*schema, StructField("batch", IntegerType()), StructField("late", BooleanType())])).parquet(f"{base}/rows")
    return rows.where("late").drop("late")


def behind_watermark(parts: Iterable[DataFrame], lateness: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(result, late rows) of a stateful stream over parts that arrive one after the other."""
    parts = list(parts)
    spark, schema = parts[0].sparkSession, parts[0].schema
    base = scratch_path(spark, "stream")
    made: dict[str, DataFrame] = {}

    def worked() -> StreamingQuery:
        made["out"] = work(in_time(spark, f"{base}/split", schema))
        return append_to(made["out"], f"{base}/work")

    deliver(parts, f"{base}/inbox", [lambda: split_late(folder_stream(spark, f"{base}/inbox", schema), f"{base}/split", lateness), worked])
    return spark.read.schema(made["out"].schema).parquet(f"{base}/work/out"), late_rows(spark, f"{base}/split", schema)


# ---- windows and deliveries -----------------------------------------------------------------------


def windowed_kpis(events: DataFrame, length: str, slide: str | None, lateness: str) -> DataFrame:
    """Event-time windows with a watermark: closed windows are emitted once and their state is dropped."""
    return sessions.kpis(events.withWatermark("ts", lateness), length, slide)


def session_kpis(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Activity windows per session, which grow and merge while rows within ``gap`` of each other arrive."""
    return sessions.activity(events.withWatermark("ts", lateness), gap)


def ingest(deliveries: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Continuous idempotent ingest: each micro-batch appends only revisions never delivered before.

    What was delivered is keyed state, combined map-side, so a batch reads nothing
    of the store. A revision is new in the batch whose time is its first one;
    batch times are kept in the checkpoint, so a replayed batch finds the same
    ones new, and overwrites its own rows and nothing else.
    """
    deliveries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rest = [c for c in deliveries.columns if c not in REVISION]
    seen = deliveries.withColumn("_now", F.current_timestamp()).groupBy(*REVISION).agg(
        F.min_by(F.struct(*rest), "seq").alias("_first"), F.min("_now").alias("_since"), F.max("_now").alias("_now")
    )
    fresh = seen.where("_since = _now").select(*REVISION, "_first.*")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return fresh.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
