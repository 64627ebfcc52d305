"""Operators on article links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ordered import range_blocks


def link_seen(probes: DataFrame, links: DataFrame, url: str = "url", link: str = "link") -> DataFrame:
    """Distinct probe URLs for which the next stored link in order contains them.

    This is an as-of join on a total order of strings. Both sides are reduced
    to distinct URLs, range-partitioned together and scanned once; a probe at
    the end of a block takes the first link of the following blocks. The work
    is linear, whatever share of the URLs sits on one host.
    """
    both = (
        probes.select(F.col(url).alias("url"), F.lit(None).cast("string").alias("stored"))
        .unionByName(links.select(F.col(link).alias("url"), F.col(link).alias("stored")))
        .where(F.col("url").isNotNull())
        .groupBy("url")
        # null: only probed; otherwise stored. ``probed`` keeps the probes apart.
        .agg(F.max("stored").alias("stored"), F.max(F.col("stored").isNull()).alias("probed"))
    )
    blocks = range_blocks(both, "url")
    # The next stored link within the block, the row itself included.
    ahead = Window.partitionBy("block").orderBy(F.desc("url")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = blocks.withColumn("next", F.last("stored", ignorenulls=True).over(ahead))
    # One row per block: the first link found in any later block.
    heads = blocks.groupBy("block").agg(F.min("stored").alias("head"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("later_head", F.last("head", ignorenulls=True).over(later))
    return (
        scanned.where("probed")
        .join(heads.select("block", "later_head"), "block", "left")
        .where(F.contains(F.coalesce("next", "later_head"), F.col("url")))
        .select("url")
    )


def resolve_guid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of items of a feed sharing a link, where the link is not the GUID.

    Of a pair, the first item whose link differs from its GUID goes and its
    GUID moves to the other. Links shared by more than two items are only
    reported. Returns (items, report). A pair is found with one aggregate that
    keeps a constant-size state per (feed, link).
    """
    differs = F.col("item_link") != F.col("item_guid")
    groups = (
        items.where(F.col("item_link").isNotNull())
        .groupBy("item_feed_uid", "item_link")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(differs, F.struct("item_uid", "item_guid"))).alias("gone"),
            F.min("item_uid").alias("lo"),
            F.max("item_uid").alias("hi"),
        )
        .where((F.col("n") > 1) & F.col("gone").isNotNull())
    )
    moves = groups.where(F.col("n") == 2).select(
        F.col("gone.item_uid").alias("gone_uid"),
        F.when(F.col("lo") == F.col("gone.item_uid"), F.col("hi")).otherwise(F.col("lo")).alias("item_uid"),
        F.col("gone.item_guid").alias("new_guid"),
    )
    changes = moves.select("item_uid", "new_guid", F.lit(False).alias("gone")).unionByName(
        moves.select(F.col("gone_uid").alias("item_uid"), F.lit(None).cast("string").alias("new_guid"),
                     F.lit(True).alias("gone"))
    )
    resolved = (
        items.join(changes, "item_uid", "left")
        .where(~F.coalesce("gone", F.lit(False)))
        .withColumn("item_guid", F.coalesce("new_guid", "item_guid"))
        .select(*items.columns)
    )
    report = groups.where(F.col("n") > 2).select("item_feed_uid", "item_link", "n")
    return resolved, report


def rewrite_links(df: DataFrame, redirects: DataFrame, link: str = "item_link", only=None) -> DataFrame:
    """Replace links by their final URL; ``only`` limits which rows change."""
    final = redirects.groupBy(F.col("url").alias(link)).agg(F.max("final_url").alias("__final"))
    joined = df.join(final, link, "left")
    new = F.coalesce("__final", link)
    if only is not None:
        new = F.when(only, new).otherwise(F.col(link))
    return joined.withColumn(link, new).select(*df.columns)


def rewrite_promoted(items: DataFrame, redirects: DataFrame) -> DataFrame:
    return rewrite_links(items, redirects, only=F.col("item_rating") > 0)
