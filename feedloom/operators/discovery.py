"""Feed autodiscovery on stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import resolve_url

# --- fixed values: where feeds usually live, in the order they are tried ------
FEED_SUFFIXES = (
    "feed", "feed/", "rss", "atom", "feed.xml",
    "/feed", "/feed/", "/rss", "/atom", "/feed.xml",
    "index.atom", "index.rss", "index.xml", "atom.xml", "rss.xml",
    "/index.atom", "/index.rss", "/index.xml", "/atom.xml", "/rss.xml",
    ".rss", "/.rss", "?rss=1", "?feed=rss2",
)
FEED_TYPES = ("application/atom+xml", "application/rss+xml")
# ------------------------------------------------------------------------------


def attribute(tag: Column, name: str) -> Column:
    """Value of an HTML attribute, null if absent."""
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(quoted, rf"(?is)^\s{name}\s*=\s*", "")
    return F.when(quoted != "", F.regexp_replace(value, """^["']|["']$""", ""))


def page_base(pages: DataFrame) -> DataFrame:
    """Pages with ``base``: the target of the first base element, else the URL."""
    tag = F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0)
    return pages.withColumn("base", F.coalesce(attribute(tag, "href"), F.col("url")))


def discover_feeds(pages: DataFrame) -> DataFrame:
    """``feed_url`` of each page: its first alternate link, Atom before RSS.

    Links to comment feeds are passed over. Pages without any keep null.
    Everything is decided inside the row.
    """
    based = page_base(pages)
    head = F.regexp_extract("html", r"(?is)^.*?</head\s*>", 0)
    head = F.when(head == "", F.col("html")).otherwise(head)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))

    def describe(tag: Column, i: Column) -> Column:
        kind = attribute(tag, "type")
        return F.struct(
            F.when(kind == FEED_TYPES[0], 0).when(kind == FEED_TYPES[1], 1).alias("rank"),
            i.alias("i"),
            attribute(tag, "rel").alias("rel"),
            attribute(tag, "href").alias("href"),
            F.lower(F.coalesce(attribute(tag, "title"), F.lit(""))).alias("title"),
        )

    def usable(t: Column) -> Column:
        return (
            (t["rel"] == "alternate") & t["rank"].isNotNull() & t["href"].isNotNull()
            & ~F.contains(F.lower(t["href"]), F.lit("comments")) & ~F.contains(t["title"], F.lit("comments feed"))
        )

    best = F.array_min(F.filter(F.transform(tags, describe), usable))
    return based.withColumn("__best", best).select(
        *pages.columns,
        F.when(F.col("__best").isNotNull(), resolve_url(F.col("base"), F.col("__best.href"))).alias("feed_url"),
    )


def candidate_feeds(pages: DataFrame) -> DataFrame:
    """Places to look for the feed of a page that names none: 24 rows per page."""
    without = discover_feeds(pages).where(F.col("feed_url").isNull()).drop("feed_url")
    suffixes = F.array(*[F.lit(s) for s in FEED_SUFFIXES])
    return (
        page_base(without)
        .select("url", "base", F.posexplode(suffixes).alias("attempt", "suffix"))
        .select("url", "attempt", resolve_url(F.col("base"), F.col("suffix")).alias("candidate"))
    )
