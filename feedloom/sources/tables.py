"""Scans and appends of the model's Parquet tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schema
from feedloom.session import TEXT


class Tables(NamedTuple):
    feeds: DataFrame
    items: DataFrame
    rules: DataFrame
    tags: DataFrame


def load(spark: SparkSession, path: str) -> Tables:
    """Feeds, items, rules and tags under ``path``; Catalyst prunes and pushes down."""
    def table(name, struct):
        return spark.read.schema(struct).parquet(f"{path}/{name}")

    return Tables(
        table("feeds", schema.FEEDS), table("items", schema.ITEMS),
        table("rules", schema.RULES), table("tags", schema.TAGS),
    )


def conform(df: DataFrame, struct) -> DataFrame:
    """Columns of ``struct`` in its order and types; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct.fields
    ])


def append(df: DataFrame, path: str, name: str) -> None:
    conform(df, getattr(schema, name.upper())).write.mode("append").options(**TEXT).parquet(f"{path}/{name}")


def save(path: str, **frames: DataFrame) -> None:
    """Write whole tables to a new folder."""
    for name, df in frames.items():
        conform(df, getattr(schema, name.upper())).write.mode("overwrite").options(**TEXT).parquet(f"{path}/{name}")


#: Below this many bytes per core an input is spread over all cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a small scan that feeds heavy text work one partition per core.

    A Parquet row group is one task, so a file of one row group would be
    worked on by one core. Inputs with a full split per core are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPREAD_BYTES else df
