"""Streams of records: incremental upsert, first-wins per key, windowed counts, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tamis.sources.change_table import ChangeTable
from tamis.sources.sinks import replace_table


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """STM-3: the first row of each key within the time that state is kept."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """STM-9: rows per window of time and key, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), *by).agg(F.count("*").alias("n"))


#: How columns of upserted records follow from their changes; others take the last value that isn't null.
UPSERT = {"stage": "first", "first_seen": "first", "run_ids": "union"}


def upsert_changes(batch: DataFrame, *, key: str, run_id: str, now: Column, ord_: str = "ord") -> DataFrame:
    """What a batch of records changes in a table under the rules of UPSERT: a row per key, its later values over earlier
    ones, with the run, the time, and what a record that is new gets."""
    folds = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ord_))).alias(c) for c in batch.columns if c not in (key, ord_, "notes")]
    one = batch.groupBy(key).agg(*folds, F.lit(run_id).alias("_run"))
    stage = F.when(F.col("stage") != "", F.col("stage")) if "stage" in one.columns else F.lit(None)
    first = F.col("first_seen") if "first_seen" in one.columns else F.lit(None)
    made = {"stage": F.coalesce(stage, F.lit("new")), "first_seen": F.coalesce(first, now), "last_seen": now, "run_ids": F.array("_run")}
    return one.withColumns(made).drop("_run")


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, *, key: str, now: Callable[[], Column], empty: DataFrame, buckets: int = 16, fan: int = 8) -> StreamingQuery:
    """STM-2, UPS-1: every micro-batch is merged into the table by key, with the batch's number as run id. It costs what the
    batch holds: its changes are appended as a run (see ChangeTable), which readers merge and which folds from time to time.
    A batch that runs again after a failure is passed over if it was committed, and is no more than an unlisted run if not."""
    kept = ChangeTable(stream.sparkSession, table, empty.schema, [key], UPSERT, ranges=buckets, fan=fan)

    def merge(batch: DataFrame, n: int) -> None:
        kept.append(upsert_changes(batch, key=key, run_id=f"batch-{n}", now=now()), n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, table: str) -> DataFrame | None:
    """The table that `upsert_stream` keeps; null before its first batch."""
    kept = ChangeTable.open(spark, table)
    return kept.read().na.fill("", ["notes"]) if kept else None


def cooled_down(now: Column, done: Column, hours: float) -> Column:
    """STM-5: whether the hours since the last work have passed; what was never done has."""
    return done.isNull() | ((F.unix_micros(now) - F.unix_micros(done)) >= F.lit(int(hours * 3_600_000_000)))


def stale(status: DataFrame, now: Column, at: str, minutes: float = 15) -> DataFrame:
    """STM-6: workers whose last sign of life is too old, or that never gave one, with its age in minutes."""
    age = (F.unix_micros(now) - F.unix_micros(at)) / 6e7
    return status.withColumn("age_minutes", age).filter(F.col("age_minutes").isNull() | (F.col("age_minutes") > minutes))


def periodic_export(stream: DataFrame, path: str, checkpoint: str, every: str = "90 seconds", once: bool = False) -> StreamingQuery:
    """STM-1, STM-7: polls the source and writes what came as the next version of an export; `once` takes what is there."""

    def write(batch: DataFrame, n: int) -> None:
        replace_table(batch.withColumn("batch", F.lit(n)), path)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
