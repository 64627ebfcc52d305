"""Keyed state of streams: one small record a feed, kept by Spark's state store and touched only by a feed's own rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ERRORS = "feed_uid long, feed_errors long, longest long, suspended boolean"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB state store."""
    spark.conf.set(STATE_STORE, ROCKSDB)


class ErrorCounter(StatefulProcessor):
    """Failures of a feed since its last success, the longest run of them, and whether one was longer than allowed.

    Of the rows of a feed in one batch, which come in any order, the time, place and result are held
    (17 bytes a row); the batch size bounds them.
    """

    def __init__(self, max_errors: int):
        self.max_errors = max_errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "feed_errors long, longest long, suspended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        errors, longest, suspended = self.counts.get() if self.counts.exists() else (0, 0, False)
        held = pd.concat([part[["ts", "seq", "ok"]] for part in rows]).sort_values(["ts", "seq"], kind="stable")
        runs = failures_after(held["ok"].to_numpy(bool), int(errors))
        errors, longest = int(runs[-1]), max(int(longest), int(runs.max()))
        suspended = bool(suspended) or longest > self.max_errors
        self.counts.update((errors, longest, suspended))
        yield pd.DataFrame({
            "feed_uid": pd.array([key[0]], "Int64"), "feed_errors": [errors], "longest": [longest], "suspended": [suspended],
        })

    def close(self) -> None:
        pass


def failures_after(ok: np.ndarray, before: int) -> np.ndarray:
    """Failures since the last success after each result, ``before`` of them before the first."""
    place = np.arange(1, len(ok) + 1)
    last_ok = np.maximum.accumulate(np.where(ok, place, 0))
    return place - last_ok + np.where(last_ok == 0, before, 0)


def count_errors(fetches: DataFrame, max_errors: int) -> DataFrame:
    """A stream of fetch results (feed_uid, ts, seq, ok) as the counts of the feeds that each batch touches."""
    use_rocksdb(fetches.sparkSession)
    return fetches.select("feed_uid", "ts", "seq", "ok").groupBy("feed_uid").transformWithStateInPandas(
        statefulProcessor=ErrorCounter(max_errors), outputStructType=ERRORS, outputMode="Update", timeMode="None"
    )
