"""Incremental forms of derived tables: statistics and client copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.stats import COUNTS

STAT_COUNTS = [*COUNTS, "total"]


def _delta(value: int | None) -> Column:
    """+1 for a new row that counts, -1 for an old one, summed over both ends."""
    def counted(side: str) -> Column:
        present = F.col(f"{side}_uid").isNotNull()
        hit = present if value is None else present & (F.col(f"{side}_rating") == value)
        return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)

    return F.sum(counted("new") - counted("old"))


def stat_deltas(changes: DataFrame) -> DataFrame:
    """Per-feed changes of the counts from item changes.

    ``changes``: feed_uid, old_uid, old_rating, new_uid, new_rating,
    new_changed. An insert has no old side, a delete no new side. The deltas
    add up, so a hot feed shrinks to one row per task before the shuffle.
    """
    return changes.groupBy("feed_uid").agg(
        *[_delta(value).alias(name) for name, value in COUNTS.items()],
        _delta(None).alias("total"),
        F.max("new_changed").alias("last_modified"),
    )


def merge_stats(
    stats: DataFrame, changes: DataFrame, new_feeds: DataFrame | None = None, gone_feeds: DataFrame | None = None
) -> DataFrame:
    """Statistics after a batch of changes.

    Counts follow exactly. ``last_modified`` only grows, and the SNR stays as
    it was until the next full rebuild. New feeds start at zero, removed ones
    go.
    """
    deltas = stat_deltas(changes).alias("d")
    base = stats
    if new_feeds is not None:
        fresh = new_feeds.select("feed_uid").join(stats, "feed_uid", "left_anti").select(
            "feed_uid", *[F.lit(0).cast("long").alias(c) for c in STAT_COUNTS],
            F.lit(None).cast("timestamp").alias("last_modified"), F.lit(0.0).alias("snr"),
        )
        base = base.unionByName(fresh)
    merged = base.alias("s").join(deltas, "feed_uid", "full_outer").select(
        "feed_uid",
        *[(F.coalesce(f"s.{c}", F.lit(0)) + F.coalesce(f"d.{c}", F.lit(0))).alias(c) for c in STAT_COUNTS],
        F.greatest("s.last_modified", "d.last_modified").alias("last_modified"),
        F.coalesce("s.snr", F.lit(0.0)).alias("snr"),
    )
    return merged if gone_feeds is None else merged.join(gone_feeds.select("feed_uid"), "feed_uid", "left_anti")


def item_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change rows between two versions of the items."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "item_uid", F.col("item_feed_uid").alias(f"{name}_feed"), F.col("item_uid").alias(f"{name}_uid"),
            F.col("item_rating").alias(f"{name}_rating"),
            F.coalesce("item_modified", "item_created").alias(f"{name}_changed"),
        )

    both = side(old, "old").join(side(new, "new"), "item_uid", "full_outer")
    same = (
        F.col("old_uid").eqNullSafe(F.col("new_uid")) & F.col("old_rating").eqNullSafe(F.col("new_rating"))
        & F.col("old_changed").eqNullSafe(F.col("new_changed"))
    )
    return both.where(~same).select(
        F.coalesce("new_feed", "old_feed").alias("feed_uid"),
        "old_uid", "old_rating", "new_uid", "new_rating", "new_changed",
    )


def high_water(client: DataFrame) -> DataFrame:
    """The latest change a client has seen (one row)."""
    return client.agg(F.max("updated").alias("since"))


def sync(client: DataFrame, items: DataFrame, since=None) -> DataFrame:
    """The client's copy after fetching what changed since ``since``.

    Without ``since`` the client's own high-water mark is used. Rows are
    merged by key; a change fetched replaces the copy.
    """
    columns = client.columns
    if since is None:
        since = high_water(client).first()["since"] or "1970-01-01 00:00:00"
    fetched = items.where(F.col("updated") > F.lit(str(since)).cast("timestamp"))
    fetched = fetched.select(*columns)
    kept = client.join(fetched.select("item_uid"), "item_uid", "left_anti")
    return kept.unionByName(fetched)


def client_unread(client: DataFrame) -> DataFrame:
    return client.where(F.col("item_rating") == 0)
