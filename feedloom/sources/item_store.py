"""Articles with changes beside them: text is written once, and a change is a narrow row merged on reading.

A store is two tables bucketed alike by ``item_uid``: the articles, and the changes (uid, version, and the fields that can
change). Reading merges the latest change of each field in a join of equal buckets, so neither side, and no text, is shuffled at
any size. Compaction writes the merged view as a new store.

The tables are registered in the session's catalog under the store's name; their files lie under its path.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import schema

BUCKETS = 32
#: What a change can set; a null leaves a field as it is. ``cleared`` empties the content, ``deleted`` removes the article.
CHANGES = (
    "item_uid long, version long, item_rating int, item_rated timestamp, item_rule_uid long, item_rule_side string, updated timestamp, "
    "cleared boolean, deleted boolean"
)
FIELDS = ("item_rating", "item_rated", "item_rule_uid", "item_rule_side", "updated", "cleared", "deleted")


class Store(NamedTuple):
    """The tables ``{name}_items`` and ``{name}_changes``."""

    name: str
    path: str
    buckets: int

    @property
    def items(self) -> str:
        return f"{self.name}_items"

    @property
    def changes(self) -> str:
        return f"{self.name}_changes"


def _write(df: DataFrame, store: Store, table: str, mode: str) -> None:
    (
        df.write.mode(mode).format("parquet").bucketBy(store.buckets, "item_uid").sortBy("item_uid")
        .option("path", f"{store.path}/{table}").saveAsTable(table)
    )


def create(items: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> Store:
    """A new store of these articles. The one shuffle of text is here."""
    store = Store(name, path, buckets)
    _write(items.repartition(buckets, "item_uid"), store, store.items, "errorifexists")
    _write(items.sparkSession.createDataFrame([], CHANGES), store, store.changes, "errorifexists")
    return store


def attach(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> Store:
    """A store that another session wrote."""
    store = Store(name, path, buckets)
    for table, columns in ((store.items, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.ITEMS)), (store.changes, CHANGES)):
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (item_uid) SORTED BY (item_uid) INTO {buckets} BUCKETS "
            f"LOCATION '{path}/{table}'"
        )
    return store


def add_changes(changes: DataFrame, store: Store, version: int) -> None:
    """Append changes (item_uid and some of ``FIELDS``), a row an article. Only these rows are written."""
    given = [F.col(f).cast(t.split()[1]).alias(f) if f in changes.columns else F.lit(None).cast(t.split()[1]).alias(f)
             for f, t in ((t.split()[0], t) for t in CHANGES.split(", ")) if f in FIELDS]
    rows = changes.select("item_uid", F.lit(version).cast("long").alias("version"), *given)
    _write(rows.repartition(store.buckets, "item_uid"), store, store.changes, "append")


def merged(spark: SparkSession, store: Store) -> DataFrame:
    """The articles as their changes left them: of each field the value of the highest version that sets it, of ``updated`` the latest."""
    items = spark.table(store.items)
    latest = spark.table(store.changes).groupBy("item_uid").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("version"))).alias(f"new_{f}") for f in FIELDS
    ])
    joined = items.join(latest, "item_uid", "left").where(~F.coalesce("new_deleted", F.lit(False)))
    values = {f: F.coalesce(f"new_{f}", f) for f in ("item_rating", "item_rated", "item_rule_uid", "item_rule_side")}
    values["updated"] = F.greatest("updated", "new_updated")
    values["item_content"] = F.when(F.coalesce("new_cleared", F.lit(False)), F.lit("")).otherwise(F.col("item_content"))
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in items.columns])


def compact(spark: SparkSession, store: Store, name: str, path: str) -> Store:
    """The merged view as a new store without changes. Buckets are kept, so nothing is shuffled."""
    new = Store(name, path, store.buckets)
    _write(merged(spark, store), new, new.items, "errorifexists")
    _write(spark.createDataFrame([], CHANGES), new, new.changes, "errorifexists")
    return new
