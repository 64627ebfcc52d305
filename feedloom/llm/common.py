"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.operators.sizing import measured_bytes
from feedloom.session import durable

#: A word: a run of characters other than the six ASCII white-space ones.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Derived tables up to this measured size are broadcast; executors may have little heap.
BROADCAST_BYTES = 16 << 20


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(column: str | Column = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def by_size(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, written, and marked for broadcast if its measured size is within ``limit``."""
    kept = durable(df)
    return F.broadcast(kept) if measured_bytes(kept) <= limit else kept


def numbered(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Adds ``__row``: 0 where the id is unique, else a number among the rows of that id.

    Ids are unique in a sound table, and then no text moves. Rows with a
    repeated or null id are numbered by their text; identical ones are
    interchangeable.
    """
    ids = docs.groupBy(F.col(id_column).alias("__id")).count().where("count > 1").drop("count")
    if ids.isEmpty():
        return docs.withColumn("__row", F.lit(0).cast("long"))
    ids = durable(ids)
    again = docs.join(ids, F.col(id_column).eqNullSafe(F.col("__id")), "left_semi")
    once = docs.join(ids, F.col(id_column).eqNullSafe(F.col("__id")), "left_anti")
    order = Window.partitionBy(id_column).orderBy("text")
    return once.withColumn("__row", F.lit(0).cast("long")).unionByName(
        again.withColumn("__row", F.row_number().over(order).cast("long"))
    )


def text_pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, int, memoryview, np.ndarray]]:
    """Runs of rows of ``batch`` of at most ``limit`` text bytes (one row may have more).

    Yields (first row, end row, bytes of their texts, offsets into these bytes).
    A null text is empty. Nothing is copied or decoded.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(data) if data is not None else memoryview(b"")
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        lo, hi = int(offsets[start]), int(offsets[end])
        yield start, end, data[lo:hi], offsets[start : end + 1] - lo
        start = end


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: fewer of them to an Arrow batch than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
