"""Subscription lists: read, import, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.scalars import clean_desc, fix_scheme
from feedloom.operators.view import public_feeds

LATIN_1 = ("ISO-8859-1", "ISO8859-1", "LATIN-1", "LATIN1")
OUTLINE = "_xmlUrl string, _htmlUrl string, _title string, _description string"


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """Every outline with a feed URL, at any depth: xml_url, html_url, title, desc.

    The XML source takes an outline with everything nested in it as one row,
    so outline tags are picked out of the text and parsed one by one. The
    declared encoding is honoured; undeclared bytes that are not UTF-8 are
    read as ISO-8859-1.
    """
    files = spark.read.format("binaryFile").load(path)
    latin = F.decode("content", "ISO-8859-1")
    declaration = F.regexp_extract(latin, r"^[^<]*<\?xml\s[^>]*\?>", 0)
    declared = F.upper(F.regexp_extract(declaration, """encoding\\s*=\\s*["']([^"']+)["']""", 1))
    text = F.when(declared.isin(*LATIN_1), latin).otherwise(
        F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), latin)
    )
    tags = F.regexp_extract_all(text, F.lit(r"""(?s)<outline\b(?:"[^"]*"|'[^']*'|[^>"'])*>"""), F.lit(0))
    outlines = files.select("path", F.posexplode(tags).alias("pos", "tag"))
    # Some writers put the attribute names in lower case.
    fixed = F.regexp_replace(F.regexp_replace("tag", r"\sxmlurl=", " xmlUrl="), r"\shtmlurl=", " htmlUrl=")
    closed = F.regexp_replace(fixed, r"\s*/?>$", "/>")
    return (
        outlines.withColumn("o", F.from_xml(closed, OUTLINE, {"attributePrefix": "_"}))
        .where(F.col("o._xmlUrl").isNotNull())
        .select(
            F.col("o._xmlUrl").alias("xml_url"),
            F.coalesce("o._htmlUrl", F.lit("")).alias("html_url"),
            F.coalesce("o._title", F.lit("")).alias("title"),
            clean_desc(F.coalesce("o._description", F.lit(""))).alias("desc"),
        )
    )


def import_feeds(new: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds to add, and counts (added, rejected as duplicates).

    A URL listed several times is added once; the other mentions count as
    duplicates, like URLs already subscribed to.
    """
    urls = new.withColumn("feed_xml", fix_scheme(F.col("xml_url")))
    distinct = urls.groupBy("feed_xml").agg(
        F.min(F.struct("html_url", "title", "desc")).alias("r"), F.count(F.lit(1)).alias("mentions")
    )
    known = feeds.select("feed_xml", F.lit(True).alias("known")).distinct()
    marked = distinct.join(known, "feed_xml", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    added = marked.where(~F.col("known")).select(
        "feed_xml", F.col("r.html_url").alias("feed_html"), F.col("r.title").alias("feed_title"),
        F.col("r.desc").alias("feed_desc"), F.lit("").alias("feed_etag"),
    )
    counts = marked.agg(
        F.count_if(~F.col("known")).alias("added"),
        F.coalesce(F.sum(F.col("mentions") - F.when(F.col("known"), 0).otherwise(1)), F.lit(0)).alias("duplicates"),
    )
    return added, counts


def add_feed(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each requested feed: ``added`` or ``already exists``."""
    known = feeds.select("feed_xml", F.lit(True).alias("known")).distinct()
    return (
        new.withColumn("feed_xml", fix_scheme(F.col("xml_url")))
        .join(known, "feed_xml", "left")
        .select("feed_xml", F.when(F.col("known"), "already exists").otherwise("added").alias("status"))
    )


def opml_export(feeds_snr: DataFrame) -> DataFrame:
    """Public active feeds as outline attributes."""
    return public_feeds(feeds_snr).select(
        F.lit("rss").alias("_type"), F.col("feed_title").alias("_title"), F.col("feed_desc").alias("_description"),
        F.col("feed_xml").alias("_xmlUrl"), F.col("feed_html").alias("_htmlUrl"), F.col("snr").alias("_snr"),
    )


def write_opml(feeds_snr: DataFrame, path: str) -> None:
    """Write the outlines as XML; the writer escapes. :func:`read_opml` reads it back."""
    opml_export(feeds_snr).write.mode("overwrite").format("xml").options(
        rowTag="outline", rootTag="body", attributePrefix="_"
    ).save(path)
