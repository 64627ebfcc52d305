"""RSS and Atom documents as feed rows and normalised entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.html import remove_scripts, resolve_url
from feedloom.functions.scalars import feed_date
from feedloom.operators.cleaning import clean
from feedloom.schema import UNKNOWN_AUTHOR
from feedloom.session import durable

RSS_ITEM = """struct<
    `_xml:base`: string, title: string, link: string, guid: struct<_VALUE: string, _isPermaLink: string>,
    category: array<string>, `dc:creator`: string, author: string, pubDate: string, `dc:date`: string,
    description: string, `content:encoded`: string, `feedburner:origLink`: string>
"""
ATOM_TEXT = "struct<_VALUE: string, _type: string>"
ATOM_LINK = "struct<_href: string, _rel: string, _type: string, _VALUE: string>"
ATOM_ENTRY = f"""struct<
    `_xml:base`: string, id: string, title: {ATOM_TEXT}, link: array<{ATOM_LINK}>,
    author: struct<name: string>, published: string, updated: string, issued: string, modified: string,
    summary: {ATOM_TEXT}, content: {ATOM_TEXT}, category: array<struct<_term: string>>,
    `feedburner:origLink`: string>
"""
#: A whole document of any kind: its root is ``rss``, ``RDF``, ``channel`` or ``feed``.
DOCUMENT = f"""
    `_xml:base` string, title {ATOM_TEXT}, subtitle {ATOM_TEXT}, description string, link array<{ATOM_LINK}>, author struct<name: string>,
    channel struct<`_xml:base`: string, title: string, link: array<string>, description: string, item: array<{RSS_ITEM}>>,
    item array<{RSS_ITEM}>, entry array<{ATOM_ENTRY}>, broken string
"""
UNTITLED = "Untitled"


def parsed_documents(reader, path: str) -> DataFrame:
    """Each document under ``path`` parsed once: ``document``, its parts ``x``, and the ``base`` that its references are relative to.

    The base is what ``xml:base`` says, from the outside in, else the page that the feed is of.
    """
    options = {"ignoreSurroundingSpaces": "true", "columnNameOfCorruptRecord": "broken"}
    docs = reader.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_path").alias("document"), F.from_xml("value", DOCUMENT, options).alias("x")
    )
    outer, inner = F.col("x.`_xml:base`"), F.col("x.channel.`_xml:base`")
    declared = F.when(inner.isNull(), outer).otherwise(_against(outer, inner))
    return docs.withColumn("base", F.coalesce(declared, _page_of("x"))).withColumn("base", F.nullif(F.trim("base"), F.lit("")))


def _against(base: Column, reference: Column) -> Column:
    """A reference made absolute; as it is where there is no base."""
    return F.when(base.isNull() | ~base.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference).otherwise(resolve_url(base, reference))


def _page_of(x: str) -> Column:
    """The page that a feed is of."""
    return F.coalesce(F.get(f"{x}.channel.link", F.lit(0)), F.get(f"{x}.link", F.lit(0))["_VALUE"], _alternate(F.col(f"{x}.link")))


def _alternate(links: Column) -> Column:
    """The page an Atom link list points to."""
    pages = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.try_element_at(pages, F.lit(1))["_href"], F.try_element_at(links, F.lit(1))["_href"])


def _exploded(docs: DataFrame, entries: Column) -> DataFrame:
    """A row for each entry ``e``, in order, with the base of what it says."""
    rows = docs.select("document", "base", F.col("x.author.name").alias("feed_author"), F.explode(entries).alias("e"))
    own = F.col("e.`_xml:base`")
    return rows.withColumn("base", F.when(own.isNull(), F.col("base")).otherwise(_against(F.col("base"), own)))


def rss_entries(docs: DataFrame) -> DataFrame:
    none = F.array().cast(f"array<{RSS_ITEM}>")
    raw = _exploded(docs, F.concat(F.coalesce("x.channel.item", none), F.coalesce("x.item", none)))
    guid = F.col("e.guid._VALUE")
    permalink = F.when(F.coalesce(F.lower("e.guid._isPermaLink"), F.lit("true")) == "true", guid)
    link = F.coalesce("e.`feedburner:origLink`", "e.link", permalink)
    return raw.select(
        "document", "base",
        F.coalesce(guid, link).alias("guid"), link.alias("link"), F.col("e.title").alias("title"),
        F.coalesce("e.`content:encoded`", "e.description").alias("content"),
        F.coalesce("e.`dc:creator`", "e.author").alias("author"),
        F.coalesce(feed_date(F.col("e.pubDate")), feed_date(F.col("e.`dc:date`"))).alias("created"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.col("e.category").alias("tags"),
    )


def atom_entries(docs: DataFrame) -> DataFrame:
    raw = _exploded(docs, F.col("x.entry"))
    published = F.coalesce("e.published", "e.issued")
    changed = F.coalesce("e.updated", "e.modified")
    link = F.coalesce(F.col("e.`feedburner:origLink`"), _alternate(F.col("e.link")))
    return raw.select(
        "document", "base",
        F.coalesce("e.id", link).alias("guid"), link.alias("link"), F.col("e.title._VALUE").alias("title"),
        F.coalesce("e.content._VALUE", "e.summary._VALUE").alias("content"),
        F.coalesce("e.author.name", "feed_author").alias("author"),
        feed_date(F.coalesce(published, changed)).alias("created"),
        F.when(published.isNotNull(), feed_date(changed)).alias("modified"),
        F.transform("e.category", lambda c: c["_term"]).alias("tags"),
    )


def absolute_links(html: Column, base: Column) -> Column:
    """HTML whose quoted ``href`` and ``src`` values are resolved against a base, where there is one."""
    # Most letters are passed by their first look: a boundary is dearer to test.
    start = r"""(?i)(?=[hs])(?=\b(?:href|src)\s*=\s*["'])"""
    value = r"""(?is)^((?:href|src)\s*=\s*(["']))(.*?)\2"""
    relative = r"""(?i)(?=[hs])\b(?:href|src)\s*=\s*["'](?![a-z][a-z0-9+.-]*:)"""

    # Each part is taken apart once, however often its pieces are used.
    def apart(part: Column) -> Column:
        return F.struct(part.alias("part"), F.regexp_extract(part, value, 1).alias("before"), F.regexp_extract(part, value, 3).alias("old"))

    def resolved(x: Column) -> Column:
        part, before, old = x["part"], x["before"], x["old"]
        new = F.concat(before, resolve_url(base, old), F.substr(part, F.length(before) + F.length(old) + 1))
        return F.when((before == "") | (old == ""), part).otherwise(F.coalesce(new, part))

    parts = F.transform(F.transform(F.split(html, start), apart), resolved)
    return F.when(base.isNotNull() & F.rlike(html, F.lit(relative)), F.array_join(parts, "")).otherwise(html)


def normalise(entries: DataFrame, base: Column | None = None) -> DataFrame:
    """Contract of a stored entry: no scripts, no ``>`` in titles, lower-case tags, absolute links where there is a ``base``.

    A missing author is ``Unknown``, a missing title ``Untitled``. An entry
    with neither title nor content is a runt.
    """
    blank = F.lit("")
    bare_title = F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]*>", ""), r"\s+", " "))
    title = F.replace(F.replace(bare_title, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tags = F.array_distinct(F.transform(
        F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(F.trim(t), blank) != ""),
        lambda t: F.lower(F.trim(t)),
    ))
    link, content = F.trim("link"), F.coalesce("content", blank)
    if base is not None:
        link, content = _against(base, link), absolute_links(content, base)
    runt = (F.coalesce(F.trim("title"), blank) == "") & (F.coalesce(F.trim("content"), blank) == "")
    return entries.withColumn("runt", runt).withColumns({
        "title": F.coalesce(F.nullif(title, blank), F.lit(UNTITLED)),
        "content": remove_scripts(content),
        "author": F.coalesce(F.nullif(F.trim("author"), blank), F.lit(UNKNOWN_AUTHOR)),
        "tags": tags,
        "link": link,
    })


def _entries(docs: DataFrame) -> DataFrame:
    """Normalised entries of parsed documents. ``position`` rises along each document."""
    entries = rss_entries(docs).unionByName(atom_entries(docs)).where(F.coalesce("guid", "link", "title", "content").isNotNull())
    # An item needs neither GUID nor link: what it says then tells it apart.
    said = F.md5(F.concat_ws("\n", "title", "content"))
    entries = entries.withColumn("guid", F.coalesce("guid", said)).withColumn("position", F.monotonically_increasing_id())
    return normalise(entries, F.col("base")).select(
        "document", "position", "guid", "link", "title", "content", "author", "created", "modified", "tags", "runt"
    )


def read_entries(reader, path: str) -> DataFrame:
    """Entries of all documents under ``path``; ``reader`` is ``spark.read`` or ``spark.readStream``."""
    return _entries(parsed_documents(reader, path))


def rejected_documents(spark: SparkSession, path: str) -> DataFrame:
    """``document`` and ``reason`` of the files under ``path`` that give no entries because they don't parse."""
    files = spark.read.format("text").option("wholetext", True).load(path).select(
        F.col("_metadata.file_path").alias("document"), "value",
        F.from_xml("value", "title string, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("x"),
    )
    known = F.col("value").rlike(r"<(?:\w+:)?(?:rss|RDF|channel|feed|item|entry)\b")
    reason = F.when(F.col("x.broken").isNotNull(), F.lit("malformed")).when(~known, F.lit("no feed"))
    return files.select("document", reason.alias("reason")).where("reason IS NOT NULL")


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(feeds, entries) of all documents under ``path``, keyed by ``document``. Each is read and parsed once."""
    docs = durable(parsed_documents(spark.read, path))
    feeds = docs.select(
        "document", F.trim(F.coalesce("x.channel.title", "x.title._VALUE")).alias("feed_title"),
        _against(F.col("base"), F.trim(_page_of("x"))).alias("feed_html"),
        F.trim(F.coalesce("x.channel.description", "x.description", "x.subtitle._VALUE")).alias("feed_desc"),
    ).where(F.coalesce("feed_title", "feed_html").isNotNull())
    return feeds, _entries(docs)


def entries_for_ingest(entries: DataFrame, documents: DataFrame, filters: list[tuple] | None = None) -> DataFrame:
    """Attach feed ids (``documents``: document, feed_uid) and run the cleaning filters."""
    keyed = clean(entries, filters).join(documents.select("document", "feed_uid"), "document")
    return keyed.select(
        "feed_uid", "position", "guid", "link", "title", "content", "author", "created", "modified", "tags", "runt"
    )
