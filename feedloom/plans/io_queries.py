"""Readers over files that Spark first derives from the tables, and the streaming jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators import maintain as M
from feedloom.operators import stats as A
from feedloom.plans.model import AS_OF, ts_text, with_model
from feedloom.plans.table_queries import INGEST_SQL, RUNS_SQL, batch_model
from feedloom.session import TEXT, shared_folder
from feedloom.sources import feeds as R
from feedloom.sources import opml as O
from feedloom.sources import tables as store
from feedloom.streaming import incremental as I
from feedloom.streaming import jobs as J


#: Entries of a written document.
A_DOCUMENT = 50


def _written(m, df, tag: str, start: str, end: str) -> str:
    """The folder of a file for each document of some entries, in order of ``item_uid``. Links go without a scheme, which the document's base has.

    A pattern of its files would make each of them a path that Spark lists by a task of its own.
    """
    path = f"{shared_folder(m.spark)}/{tag}"
    entry = F.to_xml(F.struct(*[c for c in df.columns if c != "item_uid"]), {"rowTag": tag, "attributePrefix": "_", "valueTag": "_VALUE"})
    documents = df.select("item_uid", entry.alias("entry")).groupBy(F.floor(F.col("item_uid") / A_DOCUMENT)).agg(
        F.array_sort(F.collect_list(F.struct("item_uid", "entry"))).alias("entries"))
    text = F.concat(F.lit(start), F.array_join(F.col("entries.entry"), "\n"), F.lit(end))
    documents.select(text.alias("value")).write.format("text").option("maxRecordsPerFile", 1).save(path)
    return path


BASE = 'xml:base="http://root.example.com/a/b"'


def _relative():
    return F.regexp_replace("item_link", "^http:", "")


def _linked():
    return F.concat(F.lit('<a href="'), _relative(), F.lit('?y">'), "item_content", F.lit('<img src="/z"></a>'))


def _as_rss(m) -> str:
    """Every article as an RSS item."""
    docs = m.texts_with("lang", "source")
    return _written(m, docs.select(
        "item_uid", F.col("item_title").alias("title"), _relative().alias("link"),
        F.struct(F.lit("false").alias("_isPermaLink"), F.col("item_guid").alias("_VALUE")).alias("guid"),
        F.array(F.upper("lang"), F.col("source"), F.col("lang")).alias("category"),
        F.col("item_creator").alias("author"),
        F.date_format("item_created", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
        _linked().alias("description"),
    ), "item", f'<?xml version="1.0" encoding="UTF-8"?><rss {BASE}><channel><title>Root</title>', "</channel></rss>")


def _compared(entries, *more):
    """What is compared of entries: also whether positions follow the order in which the document has them."""
    place = F.regexp_extract("guid", "([0-9]+)$", 1).cast("long")
    before = F.lag(place).over(Window.partitionBy("document").orderBy("position"))
    return entries.select(
        "guid", "link", "title", "content", "author", S.datetime_text(F.col("created")).alias("created"), *more,
        F.coalesce(before < place, F.lit(True)).alias("in_order"))


def _read_feeds(m):
    _, entries = R.read_feeds(m.spark, _as_rss(m))
    return _compared(entries, F.array_join("tags", ",").alias("tags"), "runt")


def _as_atom(m) -> str:
    docs = m.texts
    return _written(m, docs.select(
        "item_uid",
        F.col("item_guid").alias("id"), F.struct(F.lit("html").alias("_type"), F.col("item_title").alias("_VALUE")).alias("title"),
        F.array(F.struct(F.lit("self").alias("_rel"), F.lit("x").alias("_href")),
                F.struct(F.lit("alternate").alias("_rel"), _relative().alias("_href"))).alias("link"),
        F.struct(F.col("item_creator").alias("name")).alias("author"),
        F.date_format("item_created", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("published"),
        S.iso(F.coalesce("item_modified", "item_created")).alias("updated"),
        F.struct(F.lit("html").alias("_type"), _linked().alias("_VALUE")).alias("content"),
    ), "entry", f'<feed {BASE}><title>Root</title>', "</feed>")


def _read_atom(m):
    return _compared(R.read_entries(m.spark.read, _as_atom(m)), S.datetime_text(F.col("modified")).alias("modified"))


READ_SQL = """item_guid AS guid, item_link AS link, item_creator AS author, TRUE AS in_order,
  coalesce(nullif(replace(replace(trim(regexp_replace(regexp_replace(item_title, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;'), ''),
    'Untitled') AS title,
  '<a href="' || item_link || '?y">' || item_content || '<img src="http://root.example.com/z"></a>' AS content"""


def _read_opml(m):
    path = f"{shared_folder(m.spark)}/opml"
    O.write_opml(m.feeds_snr, path)
    return O.read_opml(m.spark, path)


#: What is compared of each stored table.
STORED = {
    "feeds": ("feed_uid", "feed_xml", "feed_title", "feed_desc", "feed_errors", "feed_private", "feed_filter"),
    "items": ("item_uid", "item_feed_uid", "item_guid", "item_link", "item_title", "item_content", "item_creator", "item_rating", "item_rule_uid"),
    "rules": ("rule_uid", "rule_type", "rule_feed_uid", "rule_text"),
    "tags": ("tag_item_uid", "tag_name", "tag_by"),
}


def _loaded(m):
    """All rows of the four tables, saved and loaded again."""
    path = shared_folder(m.spark)
    store.save(path, feeds=m.feeds, items=m.items, rules=m.rules, tags=m.tags)
    held = store.load(m.spark, path)
    return reduce(DataFrame.unionAll, [
        getattr(held, name).select(F.lit(name).alias("name"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("row"))
        for name, columns in STORED.items()
    ])


def _changed_url(m):
    feeds, ingested = M.change_feed_url(m.feeds, m.stored, m.rules, m.entries, 11, "http://moved.example.com/feed", AS_OF)
    return feeds.select(
        F.lit("feed").alias("kind"), F.col("feed_xml").alias("name"), F.col("feed_status").alias("state"), F.col("feed_errors").alias("errors")
    ).unionAll(ingested.new_items.select(F.lit("item"), F.concat_ws(" ", "item_guid", "item_title"), "item_rating", F.lit(0)))


def _stream(m, df, batches: int = 2):
    """``df`` as a stream of two batches, each of half the files it is written to. Only a table of fewer files is dealt anew."""
    path = f"{shared_folder(m.spark)}/landing"
    df.write.options(**TEXT).parquet(path)
    files = len(m.spark.read.schema(df.schema).parquet(path).inputFiles())
    if files < batches:
        written, path = path, f"{path}-{batches}"
        m.spark.read.schema(df.schema).parquet(written).repartition(batches).write.parquet(path)
        files = batches
    return m.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def _run(query) -> None:
    query.awaitTermination()


def _rating_stream(m):
    lake = shared_folder(m.spark)
    store.save(lake, feeds=m.feeds, items=m.items, rules=m.rules, tags=m.tags)
    _run(J.run_ratings(_stream(m, m.rating_events), lake, f"{lake}/checkpoint"))
    return J.rated_items(m.spark, lake).select(
        "item_uid", "item_rating", S.datetime_text(F.col("item_rated")).alias("item_rated"))


def _statistics_stream(m):
    lake = shared_folder(m.spark)
    changes = I.item_changes(m.items, M.apply_ratings(m.items, m.rating_events))
    _run(J.run_stats(_stream(m, changes), A.feed_stats(m.items, AS_OF), lake, f"{lake}/checkpoint"))
    return m.spark.read.parquet(f"{lake}/feed_stats/batch=1").select(
        "feed_uid", "interesting", "unread", "uninteresting", "filtered", "total")


def _error_stream(m):
    """Fetch results in two batches, each by a query of its own: the second takes up the state of the first."""
    lake, landing = shared_folder(m.spark), f"{shared_folder(m.spark)}/landing"
    middle = m.fetch_log.agg(F.expr("percentile_approx(seq, 0.5)").alias("h")).first()["h"]
    for part in (m.fetch_log.where(F.col("seq") <= middle), m.fetch_log.where(F.col("seq") > middle)):
        part.write.mode("append").parquet(landing)
        _run(J.run_errors(m.spark.readStream.schema(m.fetch_log.schema).parquet(landing), lake, f"{lake}/checkpoint", max_errors=12))
    return J.feed_errors(m.spark, lake)


def _refresh_stream(m):
    """All articles of a day arrive, with copies among them; then changed copies of all arrive again."""
    lake, landing = shared_folder(m.spark), f"{shared_folder(m.spark)}/landing"
    store.save(lake, feeds=m.feeds, items=m.stored, rules=m.rules, tags=m.tags.limit(0))
    for batch in (m.entries, m.entries.withColumns({
        "title": F.concat(F.lit("Again: "), "title"), "link": F.concat("link", F.lit("?again")),
    })):
        batch.write.mode("append").options(**TEXT).parquet(landing)
        entries = m.spark.readStream.schema(m.entries.schema).parquet(landing)
        _run(J.run_refresh(entries, lake, f"{lake}/checkpoint", AS_OF))
    return store.load(m.spark, lake).items.select("item_guid", "item_title", "item_rating")


def _seen_stream(m):
    """Entries of a stream of two batches, each GUID of a feed once."""
    lake = shared_folder(m.spark)
    _run(J.run_seen(_stream(m, m.entries), lake, f"{lake}/checkpoint", AS_OF))
    return m.spark.read.schema("feed_uid long, guid string").parquet(f"{lake}/fresh/*")


QUERIES = {
    "read_rss": (_read_feeds, with_model(f"""SELECT {READ_SQL}, {ts_text('item_created')} AS created, lang || ',' || source AS tags, FALSE AS runt
    FROM items""", "items")),
    "read_atom": (_read_atom, with_model(f"""SELECT {READ_SQL}, {ts_text('item_created - INTERVAL 2 HOUR')} AS created,
      {ts_text('coalesce(item_modified, item_created)')} AS modified FROM items""", "items")),
    "read_opml": (_read_opml, with_model("""SELECT coalesce(feed_pubxml, feed_xml) AS xml_url, feed_html AS html_url, feed_title AS title,
      replace(feed_desc, '& ', '&amp; ') AS desc FROM feeds WHERE feed_status = 0 AND NOT feed_private""", "feeds")),
    "load_tables": (_loaded, with_model("\nUNION ALL ".join(
        f"SELECT '{name}' AS name, concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), {chr(39)}-{chr(39)})' for c in columns)}) AS row FROM {name}"
        for name, columns in STORED.items()), *STORED)),
    "rating_stream": (_rating_stream, with_model(f"""SELECT i.item_uid,
      coalesce(CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 WHEN 'demote' THEN -1 END, item_rating) AS item_rating,
      {ts_text('coalesce(ts, item_rated)')} AS item_rated
    FROM items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n
      FROM rating_events WHERE op IS NOT NULL) WHERE n = 1) e ON i.item_uid = e.item_uid""", "items", "events")),
    "statistics_stream": (_statistics_stream, with_model("""SELECT feed_uid, count(*) FILTER (r = 1) AS interesting,
      count(*) FILTER (r = 0) AS unread, count(*) FILTER (r = -1) AS uninteresting, count(*) FILTER (r = -2) AS filtered, count(*) AS total
    FROM (SELECT item_feed_uid AS feed_uid,
      coalesce(CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 WHEN 'demote' THEN -1 END, item_rating) AS r
    FROM items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n
      FROM rating_events WHERE op IS NOT NULL) WHERE n = 1) e ON i.item_uid = e.item_uid) GROUP BY 1""", "items", "events")),
    "error_stream": (_error_stream, with_model("""SELECT feed_uid, arg_max(failures, seq) AS feed_errors, max(failures) AS longest,
      max(failures) > 12 AS suspended FROM runs GROUP BY 1""", "feeds", "events", extra=RUNS_SQL)),
    "refresh_stream": (_refresh_stream, batch_model("""SELECT item_guid, item_title, item_rating FROM stored
      UNION ALL SELECT item_guid, item_title, CASE WHEN rule_uid IS NULL THEN 0 ELSE -2 END
      FROM new_items LEFT JOIN first USING (item_uid)""", "rules", extra=INGEST_SQL)),
    "seen_stream": (_seen_stream, with_model("SELECT DISTINCT feed_uid, guid FROM entries", "entries")),
    "change_feed_url": (_changed_url, batch_model("""SELECT 'feed' AS kind, CASE WHEN feed_uid = 11 THEN 'http://moved.example.com/feed' ELSE feed_xml END AS name,
          CAST(CASE WHEN feed_uid = 11 THEN 0 ELSE feed_status END AS INTEGER) AS state,
          CAST(CASE WHEN feed_uid = 11 THEN 0 ELSE feed_errors END AS INTEGER) AS errors FROM feeds
        UNION ALL SELECT 'item', item_guid || ' ' || item_title, CASE WHEN rule_uid IS NULL THEN 0 ELSE -2 END, 0
        FROM new_items LEFT JOIN first USING (item_uid) WHERE item_feed_uid = 11""", "rules", extra=INGEST_SQL)),
    "apply_fetch_log": (
        lambda m: M.apply_fetch_log(m.feeds, m.fetch_log, 12).select("feed_uid", "feed_errors", "feed_status", "feed_etag"),
        with_model("""SELECT f.feed_uid, coalesce(last, feed_errors) AS feed_errors,
          CASE WHEN longest > 12 THEN 1 ELSE feed_status END AS feed_status, coalesce(etag, feed_etag) AS feed_etag
        FROM feeds f LEFT JOIN (SELECT feed_uid, CAST(arg_max(errors, seq) AS INTEGER) AS last, max(errors) AS longest FROM runs GROUP BY 1) r
          ON r.feed_uid = f.feed_uid
        LEFT JOIN (SELECT feed_uid, arg_max(etag, seq) AS etag FROM fetch_log WHERE ok GROUP BY 1) l ON l.feed_uid = f.feed_uid""",
                   "feeds", "events", extra=RUNS_SQL)),
}
