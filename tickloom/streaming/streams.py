"""Streaming twins of the ingest operators.

Each function takes a streaming DataFrame and returns one, or a writer for ``foreachBatch``.
Watermarks bound every state: first sightings remember three days, windows close after their
delay, and rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators import bars as B
from tickloom.operators import quality as Q
from tickloom.session import cut_lineage, shared_folder
from tickloom.sources import lake

MEMORY = "3 days"  # fixed value: how long a first sighting is remembered


def events(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Files as a stream with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def register_first_sightings(stream: DataFrame, at: str = "observed_at", key: str = "pool") -> DataFrame:
    """First sighting per key within the dedup memory, with its UTC date for partitioning.

    A key seen again after the memory has passed registers again; the batch registry, which never
    forgets, would not.
    """
    kept = stream.withWatermark(at, MEMORY).dropDuplicatesWithinWatermark([key])
    return kept.withColumn("dt", F.to_date(at))


def register_batches(path: str, at: str = "observed_at", key: str = "pool", memory_days: int = 3) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of a first-sighting registry whose kept rows are defined whatever the order inside a batch.

    Rows more than the memory behind the latest time of earlier batches are late: they are counted
    and not registered. Of the others the earliest of each key (then the smallest other columns)
    registers unless an earlier batch registered the key within the memory before it. Registry,
    count and clock of a batch are written under its id and only those of smaller ids are read,
    so a replayed batch writes the same. Partitions by date keep the look-back to the memory.
    """
    memory = F.expr(f"INTERVAL {memory_days} DAYS")

    def earlier(spark: SparkSession, kind: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], f"{schema}, batch int")
        return spark.read.schema(schema + ", batch int").parquet(f"{path}/{kind}").where(F.col("batch") < batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.persist()
        try:
            clock = earlier(spark, "clock", batch_id, "seen timestamp, late bigint").agg(F.max("seen")).first()[0]
            late = F.lit(False) if clock is None else F.col(at) < F.lit(clock) - memory
            rest = [c for c in batch.columns if c not in (at, key)]
            first = own.where(~late).groupBy(key).agg(F.min(F.struct(at, *rest)).alias("f")).select(key, "f.*")
            oldest = own.where(~late).agg(F.date_sub(F.to_date(F.min(at)), memory_days)).first()[0]
            known = earlier(spark, "registry", batch_id, f"{key} {batch.schema[key].dataType.simpleString()}, {at} timestamp, dt date").where(F.col("dt") >= F.lit(oldest))
            known = known.groupBy(key).agg(F.max(at).alias("__last"))
            fresh = first.join(known, key, "left").where(F.col("__last").isNull() | (F.col("__last") <= F.col(at) - memory)).drop("__last")
            fresh.withColumn("dt", F.to_date(at)).write.mode("overwrite").partitionBy("dt").option("partitionOverwriteMode", "static").parquet(f"{path}/registry/batch={batch_id}")
            told = own.agg(F.max(at).alias("seen"), F.count_if(late).alias("late"))
            told.write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")
        finally:
            own.unpersist()

    return write


def resample(stream: DataFrame, source: str, target: str, delay: str = "1 hour") -> DataFrame:
    """Complete coarser bars, emitted once their window is past the watermark."""
    factor = B.INTERVAL_MS[target] // B.INTERVAL_MS[source]
    span = f"{B.INTERVAL_MS[target] // 1000} seconds"
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", span).alias("w"), "symbol")
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") == factor)
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_activity(stream: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Rows and volume per symbol over sliding windows."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume")
    ).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


def sessions(stream: DataFrame, gap: str, delay: str, key: str = "pool") -> DataFrame:
    """Runs of activity per key separated by more than ``gap``: the stream form of contiguous runs."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n")
    ).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def panel_pass(cohort: DataFrame, states: DataFrame, at: str) -> DataFrame:
    """One row per tracked pool for a pass; a pool without a state is written as not alive."""
    latest = states.groupBy("pool").agg(F.max_by(F.struct("price", "liquidity", "alive"), "observed_at").alias("s"))
    return cohort.select("pool").join(latest, "pool", "left").select(
        "pool", F.lit(at).cast("timestamp").alias("observed_at"), "s.price", "s.liquidity", F.coalesce("s.alive", F.lit(False)).alias("alive")
    )


def append_panel(cohort: DataFrame, path: str, at: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: every batch appends one panel pass under its own folder.

    The folder is named by the batch id and overwritten, so a replayed batch writes once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        panel_pass(cohort, batch, at(batch_id)).write.mode("overwrite").parquet(f"{path}/pass={batch_id}")

    return write


def upsert_bars(path: str, interval: str, now: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: merge complete bars into the lake; the running bar waits."""

    def write(batch: DataFrame, batch_id: int) -> None:
        end = B.floor_to(F.lit(now(batch_id)).cast("timestamp"), interval)
        done = batch.where(F.col("timestamp") < end).withColumn("interval", F.lit(interval))
        if not done.isEmpty():
            lake.write_bars(done, path)

    return write


def gate(good: str, bad: str, step_seconds: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: symbols of a batch with any error finding go to quarantine, whole.

    Findings are written beside the quarantined rows; both sinks are named by batch id, so a
    replay overwrites its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            found = cut_lineage(Q.findings(Q.by_stamp(rows, "seq"), step_seconds))
            refused = Q.report(found).where("not storable").select("symbol")
            rows.join(refused, "symbol", "left_anti").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            rows.join(refused, "symbol", "left_semi").write.mode("overwrite").parquet(f"{bad}/batch={batch_id}/rows")
            found.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}/findings")
        finally:
            rows.unpersist()

    return write


GUARD_SCHEMA = "account string, ts timestamp, equity double, day_start double, tripped boolean, killed boolean"
_GUARD_STATE = "day string, start double, tripped boolean, killed boolean"


def equity_guard(stream: DataFrame, daily_limit: float = 0.025, floor: float | None = None) -> DataFrame:
    """Per account: the day's starting equity, a trip for the rest of the day, a floor kept for ever.

    State is four values per account. Rows of a batch are taken in time order; a batch older than
    the state's day changes nothing but the floor.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, start, tripped, killed = state.get if state.exists else ("", 0.0, False, False)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, equity in zip(rows["ts"], rows["equity"], strict=True):
            today = ts.strftime("%Y-%m-%d")
            if today > day:
                day, start, tripped = today, float(equity), False
            tripped = tripped or equity <= start * (1 - daily_limit)
            killed = killed or (floor is not None and equity <= floor)
            out.append((key[0], ts, float(equity), start, bool(tripped), bool(killed)))
        state.update((day, start, bool(tripped), bool(killed)))
        yield pd.DataFrame(out, columns=["account", "ts", "equity", "day_start", "tripped", "killed"])

    return stream.groupBy("account").applyInPandasWithState(
        step, GUARD_SCHEMA, _GUARD_STATE, "append", GroupStateTimeout.NoTimeout
    )


def settle(stream: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what is available into the shared folder and read it back."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    done = writer.start(f"{root}/out")
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def replayed(write: Callable[[DataFrame, int], None], which: int) -> Callable[[DataFrame, int], None]:
    """The writer with one batch handed to it twice, as after a failure before the batch was noted."""

    def twice(batch: DataFrame, batch_id: int) -> None:
        for _ in range(2 if batch_id == which else 1):
            write(batch, batch_id)

    return twice


def settle_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str | None = None) -> None:
    """Run a ``foreachBatch`` writer over what is available; with ``state``, over what came since the last run."""
    state = state or f"{shared_folder(stream.sparkSession)}/{uuid.uuid4().hex}/state"
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
