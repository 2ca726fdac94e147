"""Streams of a running clip job: files that arrive, quality records, manifest rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelyard.operators.manifest import REQUIRED

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALL_FILES = (1 << len(REQUIRED)) - 1


def complete_clips(inventory: DataFrame) -> DataFrame:
    """clip_id of the clips of which all required files have arrived; update mode; repeated files change nothing."""
    good = inventory.where(F.col("valid") & (F.col("size") > 0) & F.col("file").isin(REQUIRED))
    return good.groupBy("clip_id").agg(F.collect_set("file").alias("_have")).where(F.size("_have") == len(REQUIRED)).select("clip_id")


class ClipArrivals(StatefulProcessor):
    """What has arrived of one clip: a bit for each required file, whether it was released, and when it was last heard of.

    A clip is released with the batch that completes it. With a hold (milliseconds of event time) a clip that isn't heard of
    for so long is forgotten: an incomplete one is told of as expired, a released one goes quietly. So the state is one small
    row for each clip that was heard of within the hold, and a file that comes again within it releases nothing twice."""

    def __init__(self, hold_ms: int | None):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "have long, released boolean, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have, released, last = self.seen.get() if self.seen.exists() else (0, False, 0)
        before = last
        for part in rows:
            for bit in part["bit"]:
                have |= 1 << int(bit)
            if self.hold_ms is not None:
                last = max(last, int(part["ms"].max()))
        if self.hold_ms is not None and last > before:
            if before:
                self.handle.deleteTimer(before + self.hold_ms)
            self.handle.registerTimer(last + self.hold_ms)
        done = have == ALL_FILES and not released
        self.seen.update((have, released or done, last))
        if done:
            yield pd.DataFrame({"clip_id": [key[0]], "outcome": ["complete"], "files": [len(REQUIRED)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have, released, _ = self.seen.get()
        self.seen.clear()
        if not released:
            yield pd.DataFrame({"clip_id": [key[0]], "outcome": ["expired"], "files": [int(have).bit_count()]})

    def close(self) -> None:
        pass


def clip_outcomes(inventory: DataFrame, hold: str | None = None) -> DataFrame:
    """clip_id, outcome (complete or expired), files: each clip once, when its last required file arrives or, with a hold such
    as '2 hours', when it has waited so long. inventory: clip_id, file, size, valid and, with a hold, arrived_at; empty,
    invalid and other files are left out. Append mode; needs the state store of STORE."""
    good = inventory.where(F.col("valid") & (F.col("size") > 0) & F.col("file").isin(REQUIRED))
    bit = (F.array_position(F.array(*map(F.lit, REQUIRED)), F.col("file")) - 1).cast("int").alias("bit")
    if hold is None:
        rows, ms, mode = good.select("clip_id", bit), None, "None"
    else:
        spark = inventory.sparkSession
        ms = spark.range(1).select((F.unix_millis(F.expr(f"timestamp'2000-01-01' + interval {hold}")) - F.unix_millis(F.expr("timestamp'2000-01-01'"))).alias("ms")).first()["ms"]
        rows, mode = good.withWatermark("arrived_at", "0 seconds").select("clip_id", bit, F.unix_millis("arrived_at").alias("ms"), "arrived_at"), "EventTime"
    kind = inventory.schema["clip_id"].dataType.simpleString()
    return rows.groupBy("clip_id").transformWithStateInPandas(ClipArrivals(ms), f"clip_id {kind}, outcome string, files int", "Append", mode)


def release_once(inventory: DataFrame, out: str, checkpoint: str, hold: str | None = None):
    """Start the query that appends each clip's outcome to `out` once, whatever is delivered again and however often the query
    starts anew: what a clip has is kept by key, and the file sink commits each batch once. Nothing is read back from `out`."""
    inventory.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = clip_outcomes(inventory, hold).writeStream.format("parquet").outputMode("append")
    return stream.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_counters(qc: DataFrame) -> DataFrame:
    """Running clips by flag, complete mode; an id counts once."""
    return qc.dropDuplicates(["id"]).select(F.explode(F.concat("hard_flags", "soft_flags")).alias("flag")).groupBy("flag").count()


def ready_counters(qc: DataFrame) -> DataFrame:
    """Running numbers of clips that are ready for training and not, complete mode; an id counts once."""
    return qc.dropDuplicates(["id"]).groupBy("training_ready").count()


def manifest_stream(qc: DataFrame, captions: DataFrame) -> DataFrame:
    """Manifest rows, appended as quality records arrive, by a join with the captions at rest."""
    return qc.join(captions, "id").select("id", "caption", "training_ready", "hard_flags", "soft_flags")
