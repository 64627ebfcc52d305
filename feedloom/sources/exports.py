"""Reports and feeds written for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import truncate_html
from feedloom.functions.scalars import iso, share_author, share_title, xml_text
from feedloom.operators.stats import load_stats
from feedloom.operators.view import public_feeds
from feedloom.schema import SHARE_LIMIT

ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"


def blogroll(feeds_snr: DataFrame) -> DataFrame:
    return public_feeds(feeds_snr).select(
        F.col("feed_uid").alias("uid"), F.col("feed_title").alias("title"), F.col("feed_desc").alias("description"),
        F.col("feed_html").alias("html"), F.col("feed_xml").alias("xml"), "snr",
    )


def blogroll_json(feeds_snr: DataFrame) -> DataFrame:
    return blogroll(feeds_snr).select(F.to_json(F.struct("*")).alias("json"))


def share_order(df: DataFrame, n: int = SHARE_LIMIT) -> DataFrame:
    return df.orderBy(F.col("item_rated").desc_nulls_last(), F.col("item_uid").desc()).limit(n)


def share(items: DataFrame, feeds: DataFrame, n: int = SHARE_LIMIT) -> DataFrame:
    """Latest interesting articles of public feeds.

    The top rows are chosen on keys alone; the text of those few is joined after.
    """
    public = feeds.where(~F.col("feed_private")).select(F.col("feed_uid").alias("item_feed_uid"), "feed_title")
    liked = items.where(F.col("item_rating") == 1)
    chosen = share_order(
        liked.select("item_uid", "item_feed_uid", "item_rated").join(public, "item_feed_uid"), n
    ).select("item_uid", "feed_title")
    rows = liked.join(chosen, "item_uid")
    return share_order(rows, n).select(
        "item_uid", "item_guid", "item_creator", "item_title", "item_link", "item_content", "feed_title",
        iso(F.col("item_created")).alias("created"),
        share_title(F.col("feed_title"), F.col("item_title")).alias("entry_title"),
        share_author(F.col("item_creator"), F.col("feed_title")).alias("entry_author"),
        truncate_html(F.col("item_content")).alias("entry_content"),
    )


def share_entries(shared: DataFrame) -> DataFrame:
    """Rows of :func:`share` as Atom entries for the XML writer."""
    return shared.select(
        F.col("item_guid").alias("id"), F.col("entry_title").alias("title"), F.col("created").alias("updated"),
        F.struct(F.col("entry_author").alias("name")).alias("author"),
        F.struct(F.lit("html").alias("_type"), F.col("entry_content").alias("_VALUE")).alias("content"),
        F.struct(F.lit("alternate").alias("_rel"), F.col("item_link").alias("_href")).alias("link"),
    )


def write_share(items: DataFrame, feeds: DataFrame, path: str) -> None:
    share_entries(share(items, feeds)).write.mode("overwrite").format("xml").options(
        rowTag="entry", rootTag=f'feed xmlns="{ATOM_NAMESPACE}"', attributePrefix="_", valueTag="_VALUE"
    ).save(path)


def share_xml(shared: DataFrame) -> DataFrame:
    """The same entries as XML text, one per row."""
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), xml_text(value), F.lit(f"</{name}>"))

    return shared.select("item_uid", F.concat(
        F.lit("<entry>"), tag("id", F.col("item_guid")), tag("title", F.col("entry_title")),
        tag("updated", F.col("created")), F.lit("<author>"), tag("name", F.col("entry_author")), F.lit("</author>"),
        F.lit('<content type="html">'), xml_text(F.col("entry_content")), F.lit("</content>"),
        F.lit('<link rel="alternate" href="'), xml_text(F.col("item_link")), F.lit('" /></entry>'),
    ).alias("entry"))


def stats_csv(items: DataFrame, as_of) -> DataFrame:
    stats = load_stats(items, as_of)
    return stats.select(*[F.col(c).alias(c.capitalize()) for c in stats.columns])


def write_stats_csv(items: DataFrame, as_of, path: str) -> None:
    stats_csv(items, as_of).write.mode("overwrite").csv(path, header=True)


def sync_rows(view: DataFrame) -> DataFrame:
    """What an offline client stores of each article."""
    return view.select(
        F.col("item_uid").alias("uid"), "since_when", F.col("item_creator").alias("creator"),
        F.col("item_loaded_text").alias("loaded"), F.col("item_feed_uid").alias("feed_uid"),
        F.col("item_title").alias("title"), "feed_html", F.col("item_content").alias("content"), "tag_info",
        F.col("item_link").alias("redirect"), "feed_title", F.col("snr").alias("feed_snr"),
        F.unix_micros("updated").alias("updated_ts"), F.col("item_rating").alias("rating"), "feed_exempt",
    )


def sync_json(view: DataFrame) -> DataFrame:
    return sync_rows(view).select("uid", F.to_json(F.struct("*")).alias("json"))
