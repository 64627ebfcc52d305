"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on. A cluster may override the sizing ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split skewed side is worth an extra exchange further up the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Articles can be long; keep Arrow batches small in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name on storage all executors share.

    It lies in the directory the cluster names in ``spark.checkpoint.dir``.
    Only where that is unset (tests on one machine) is a temporary one used.
    """
    _checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _checkpoint_ready(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", "")
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


#: Folders written by ``durable`` in the innermost ``scratch`` block of this thread.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what :func:`durable` writes in this block when it ends.

    For jobs that have committed their outputs by then: tables read from such
    folders can't be used any more. Without a block the tables stay, as the
    frames returned may still read them.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        remove(spark, written)


def next_scratch(spark: SparkSession, last: bool = False) -> None:
    """For jobs of steps that each read only what the last one wrote out: remove the tables of the step before.

    To be called at the start of every step, when the result of the one before it is written. From the
    ``last`` step on tables stay again.
    """
    before = _WRITTEN.get() or []
    _WRITTEN.set(None if last else [])
    remove(spark, before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, where they exist."""
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


#: How tables that hold article text are compressed: a third less is written than by default.
TEXT = {"compression": "zstd"}


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and cut its lineage.

    A written table is computed once (a checkpoint runs its last stage twice),
    is read by column, and has a size the optimizer knows.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(builds: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The frames of several builds that write tables on their way, at the same time: their small jobs share the cluster.

    They write into the ``scratch`` block of the caller, if there is one.
    """
    with ThreadPoolExecutor(len(builds)) as pool:
        return [future.result() for future in [pool.submit(copy_context().run, build) for build in builds]]
