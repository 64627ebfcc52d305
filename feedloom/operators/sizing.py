"""Broadcasts only after measuring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.session import durable

BROADCAST_BYTES = 64 << 20


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows: 16 bytes a field, and what strings, binaries, arrays, maps and structs hold."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        width = width + _held(F.col(f"`{field.name}`"), field.dataType)
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"])


def _held(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value holds besides its own 16; none if it is null."""
    if isinstance(kind, T.StringType | T.BinaryType):
        held = F.octet_length(value).cast("long")
    elif isinstance(kind, T.ArrayType):
        held = 16 * F.array_size(value).cast("long")
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType):
            held = held + F.aggregate(value, F.lit(0).cast("long"), lambda sum_, x: sum_ + _held(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        held = _held(F.map_keys(value), T.ArrayType(kind.keyType)) + _held(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        held = F.lit(16 * len(kind.fields)).cast("long")
        for field in kind.fields:
            held = held + _held(value.getField(field.name), field.dataType)
        held = F.when(value.isNotNull(), held)
    else:
        held = F.lit(0).cast("long")
    return F.coalesce(held, F.lit(0).cast("long"))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise ``df``, measure it, and mark it for broadcast within ``limit``.

    Beyond the limit it is returned unmarked, and the join shuffles with AQE
    splitting hot keys. Used for derived tables whose size Catalyst cannot
    know before it runs them; it would otherwise shuffle the big side too.
    """
    kept = durable(df)
    return F.broadcast(kept) if measured_bytes(kept) <= limit else kept
