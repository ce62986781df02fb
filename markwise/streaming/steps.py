"""Progress of images as a stream with state: which steps are left after every micro-batch, and which images are stuck.

Input: (image_id, kind, value, ts). kind is raw (the image itself), an artifact's kind as operators.progress takes it, or metrics, whose value is the scale
(a scale of 0 is a failed measurement). What an image has never goes away, so late and repeated rows, in any order and before the image itself, lead to the same state, as
long as they are within `late` of the newest row: Spark drops what the watermark has passed. An image that has steps left when the watermark
passes `patience` after its last row comes once more, as stuck.

The state of an image is a row of flags in the state store (RocksDB); a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from markwise.operators.progress import required_steps

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "image_id string, kind string, value double, ts timestamp"
#: What is known of an image, in the order of the state's columns.
KINDS = ("raw", "fish", "whole_fish", "ruler", "image", "mask", "qa_ticks", "qa_standardized", "metrics")
_STATE = ", ".join(f"{k} boolean" for k in KINDS) + ", version long"
PROGRESS = "image_id string, segmentation boolean, metrics boolean, standardization boolean, qa_plots boolean, stuck boolean, version long"


class Steps(StatefulProcessor):
    """Flags of one image; a row goes out whenever they change, and when the timer finds steps left."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("flags", _STATE)

    def _row(self, image: str, flags: tuple, version: int, stuck: bool) -> pd.DataFrame:
        has = dict(zip(KINDS, flags, strict=True))
        row = (image, (has["fish"] or has["whole_fish"]) and has["ruler"], has["metrics"], has["image"] and has["mask"], has["qa_ticks"] or has["qa_standardized"], stuck, version)
        return pd.DataFrame([row], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    def _done(self, flags: list) -> bool:
        has = dict(zip(KINDS, flags, strict=True))
        return (has["fish"] or has["whole_fish"]) and has["ruler"] and has["metrics"] and has["image"] and has["mask"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get()
        *before, version = known or (*[False] * len(KINDS), 0)
        flags, last = list(before), 0
        for part in rows:
            for kind, value, ts in zip(part["kind"], part["value"], part["ts"], strict=True):
                last = max(last, int(ts.timestamp() * 1000))
                if kind in KINDS and (kind != "metrics" or value > 0):
                    flags[KINDS.index(kind)] = True
        if flags != before:
            version += 1
            self.state.update((*flags, version))
        for timer in list(self.handle.listTimers()) if known else ():  # a new image has none
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if not self._done(flags):  # what an image has stays, so one that is done cannot be stuck
            self.handle.registerTimer(last + self.patience_ms)
        if flags[0] and flags != before:
            yield self._row(key[0], tuple(flags), version, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            *flags, version = self.state.get()
            if flags[0] and not self._done(flags):
                self.state.update((*flags, version + 1))
                yield self._row(key[0], tuple(flags), version + 1, True)

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, late: str = "30 days", patience_ms: int = 86_400_000) -> DataFrame:
    """A stream of PROGRESS rows from a stream of EVENTS rows."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = events.where("image_id is not null").withWatermark("ts", late).groupBy("image_id")
    return keyed.transformWithStateInPandas(Steps(patience_ms), PROGRESS, outputMode="Update", timeMode="EventTime")


def keep_steps(events: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs the stream over what is there; each micro-batch's rows stand under its number, so one that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = progress_stream(events, **options).writeStream.foreachBatch(write).outputMode("update")
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def steps_now(spark: SparkSession, target: str) -> DataFrame:
    """The steps of each image as of the last micro-batch, and whether it is stuck."""
    rows = spark.read.parquet(target)
    state = F.struct("segmentation", "metrics", "standardization", "qa_plots", "stuck")
    return required_steps(rows.groupBy("image_id").agg(F.max_by(state, "version").alias("s")).select("image_id", "s.*"))
