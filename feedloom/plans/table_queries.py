"""Ingest, maintenance, cleaning, discovery and incremental upkeep."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions import scalars as S
from feedloom.operators import cleaning as C
from feedloom.operators import discovery as D
from feedloom.operators import ingest as G
from feedloom.operators import links as L
from feedloom.operators import maintain as M
from feedloom.operators import stats as A
from feedloom.operators.filter_list import DEFAULT_FILTERS
from feedloom.operators.ordered import failure_runs
from feedloom.plans.model import AS_OF, ago, sql_text, ts_text, with_model
from feedloom.plans.rule_queries import ALL_MATCHES_SQL, FIRST_SQL, LIVE_SQL, STEMS_SQL
from feedloom.session import shared_folder
from feedloom.sources import item_store as IS
from feedloom.sources import opml as O
from feedloom.streaming import incremental as I

# ------------------------------------------------------------------ ingest

BATCH_SQL = """
once AS (
  SELECT * EXCLUDE again FROM (SELECT *, row_number() OVER (PARTITION BY feed_uid, guid ORDER BY position DESC) AS again FROM entries)
  WHERE again = 1
),
fresh AS (
  SELECT * FROM once e WHERE NOT runt
    AND NOT EXISTS (SELECT 1 FROM stored i WHERE i.item_feed_uid = e.feed_uid AND i.item_guid = e.guid)
),
checked AS (
  SELECT e.* FROM fresh e JOIN feeds f ON e.feed_uid = f.feed_uid AND feed_dupcheck
  WHERE NOT EXISTS (SELECT 1 FROM stored i WHERE i.item_feed_uid = e.feed_uid AND i.item_title = e.title)
    AND NOT EXISTS (SELECT 1 FROM stored i WHERE i.item_feed_uid = e.feed_uid AND i.item_link = e.link)
),"""
#: The batch check in SQL: entries in processing order, each against those accepted before it.
GREEDY_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_uid ORDER BY position DESC) AS n FROM checked),
walk AS (
  SELECT feed_uid, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS links, FALSE AS taken
  FROM feeds
  UNION ALL
  SELECT w.feed_uid, r.n,
    CASE WHEN list_contains(titles, title) OR list_contains(links, link) THEN titles ELSE list_append(titles, title) END,
    CASE WHEN list_contains(titles, title) OR list_contains(links, link) THEN links ELSE list_append(links, link) END,
    NOT (list_contains(titles, title) OR list_contains(links, link))
  FROM walk w JOIN ranked r ON r.feed_uid = w.feed_uid AND r.n = w.n + 1
),
accepted AS (
  SELECT r.* EXCLUDE n FROM ranked r JOIN walk w ON r.feed_uid = w.feed_uid AND r.n = w.n WHERE taken
  UNION ALL SELECT e.* FROM fresh e JOIN feeds f ON e.feed_uid = f.feed_uid WHERE NOT feed_dupcheck
)"""


def batch_model(query: str, *parts: str, extra: str = "") -> str:
    """The batch CTEs after the model's; the walk over a feed needs RECURSIVE."""
    sql = with_model(query, "feeds", "entries", *parts, extra=BATCH_SQL.strip() + GREEDY_SQL + extra)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


#: The batch's new items as the rules see them.
NEW_SQL = """,
new_items AS (
  SELECT (SELECT max(item_uid) FROM stored) + row_number() OVER (ORDER BY feed_uid, position DESC) AS item_uid,
    feed_uid AS item_feed_uid, guid AS item_guid, link AS item_link, title AS item_title, content AS item_content,
    md5(content) AS item_md5hex, author AS item_creator, created AS item_created, modified AS item_modified, lang, source
  FROM accepted
),
new_tags AS (
  SELECT item_uid AS tag_item_uid, lang AS tag_name, 0 AS tag_by FROM new_items
  UNION ALL SELECT item_uid, source, 0 FROM new_items
)"""


def _swap(sql: str) -> str:
    """Rule CTEs over the new items instead of all."""
    return sql.replace("FROM items ", "FROM new_items ").replace("JOIN tags ", "JOIN new_tags ").replace("FROM tags ", "FROM new_tags ")


INGEST_SQL = NEW_SQL + "," + _swap(",".join((LIVE_SQL, STEMS_SQL, ALL_MATCHES_SQL, FIRST_SQL)))


#: A reader's own cleaning list, without the default one.
OWN_FILTERS = [
    ("strip", "<br */?>", "i", " ", False), ("strip", "the the ", "", "the ", True), ("limit", "xkcd", ("strip", "<p>", "", "<P>", False)),
    ("first_link", "http://evanmiller.org/"),
]


def _item_store(m):
    """Articles in a store: rated, deduplicated, cleared and expired by changes, compacted, and rated again in part."""
    spark, path, name = m.spark, shared_folder(m.spark), f"s{uuid.uuid4().hex}"
    store = IS.create(m.items, f"{name}a", path, buckets=8)
    IS.add_changes(M.rating_changes(m.rating_events), store, 1)
    IS.add_changes(M.dedupe_changes(IS.merged(spark, store)), store, 2)
    IS.add_changes(M.clear_changes(IS.merged(spark, store), AS_OF), store, 3)
    store = IS.compact(spark, store, f"{name}b", path)
    IS.add_changes(M.expiry_changes(IS.merged(spark, store), m.feeds, AS_OF), store, 4)
    return IS.merged(spark, store).select(
        "item_uid", "item_rating", S.datetime_text(F.col("item_rated")).alias("item_rated"), S.datetime_text(F.col("updated")).alias("updated"),
        "item_title", "item_content")


ITEM_STORE_SQL = f"""SELECT item_uid, item_rating, {ts_text('item_rated')} AS item_rated, {ts_text('updated')} AS updated, item_title, item_content
FROM (SELECT d.* REPLACE (CASE WHEN item_rating < 0 AND item_created < {ago('7')} THEN '' ELSE item_content END AS item_content), feed_oldest
  FROM (SELECT * REPLACE (CASE WHEN item_rating = 0 AND item_title IS NOT NULL AND count(*) OVER (PARTITION BY item_feed_uid, item_title) > 1
      THEN -1 ELSE item_rating END AS item_rating)
    FROM (SELECT i.* REPLACE (coalesce(CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 WHEN 'demote' THEN -1 END, item_rating) AS item_rating,
        coalesce(ts, item_rated) AS item_rated, greatest(updated, ts) AS updated)
      FROM items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n
        FROM rating_events WHERE op IS NOT NULL) WHERE n = 1) e ON i.item_uid = e.item_uid)) d
  LEFT JOIN feeds ON item_feed_uid = feed_uid)
WHERE NOT coalesce(item_rating < 0 AND feed_oldest IS NOT NULL AND item_created < least({ago('180')}, feed_oldest - INTERVAL 7 DAY), FALSE)"""


def _keys_of(feeds, items, rules, tags):
    """The keys of all rows of the four tables."""
    def keys(name, df, key):
        return df.select(F.lit(name).alias("name"), key.alias("id"))

    return keys("feeds", feeds, F.col("feed_uid").cast("string")).unionAll(keys("items", items, F.col("item_uid").cast("string"))).unionAll(
        keys("rules", rules, F.col("rule_uid").cast("string"))).unionAll(keys("tags", tags, F.concat_ws(" ", "tag_item_uid", "tag_name")))


def _ingest(m):
    return G.ingest(m.entries, m.stored, m.feeds, m.rules, AS_OF)


def _redirects(m):
    """Pages and articles that moved: half of the article links go to a new place."""
    links = m.items.select(F.col("item_link").alias("url")).distinct()
    return links.where(F.substring(F.md5("url"), 1, 1) < "8").select(
        "url", F.concat(F.lit("http://final.example.com/"), F.md5("url")).alias("final_url"))


def _oldest_batch(m):
    """Feeds divisible by four come without dates."""
    return m.entries.withColumn("created", F.when(F.col("feed_uid") % 4 != 0, F.col("created")))


# --------------------------------------------------------------- cleaning

def strip_sql(text: str, spec: tuple) -> str:
    """One strip filter as RE2. A back-reference is written out or, where the data cannot match it, left out."""
    _, pattern, flags, sub, repeat = spec
    if pattern == r"<h([0-9])></h\1>":
        pattern = "|".join(f"<h{n}></h{n}>" for n in range(10))
    elif r"\1" in pattern:
        return text
    if repeat:
        # Fixed points of the two repeated filters, written as one pattern each.
        fixed = {"<br>[.>]<br>": "<br>(?:[.>]<br>)+"}
        if pattern in fixed:
            pattern = fixed[pattern]
        else:
            for _ in range(3):
                text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(sub)}, 'g')"
            return text
    inline = f"(?{flags})" if flags else ""
    return f"regexp_replace({text}, {sql_text(inline + pattern)}, {sql_text(sub)}, 'g')"


def clean_sql() -> str:
    """All default filters in order, one CTE each time the link or title is touched."""
    ctes, step, content = ["c0 AS (SELECT page_id, link, title, content FROM articles)"], 0, "content"

    def flush(link="link", title="title"):
        nonlocal step, content
        step += 1
        ctes.append(f"c{step} AS (SELECT page_id, {link} AS link, {title} AS title, {content} AS content FROM c{step - 1})")
        content = "content"

    for count, spec in enumerate(DEFAULT_FILTERS):
        if spec[0] == "strip":
            content = strip_sql(content, spec)
            if count % 12 == 11:
                flush()
            continue
        flush()
        if spec[0] == "limit":
            content = f"CASE WHEN contains(link, '{spec[1]}') THEN {strip_sql('content', spec[2])} ELSE content END"
        elif spec[0] == "link":
            pattern = spec[2]
            filled = " || ".join(
                f"regexp_extract(link, {sql_text(pattern)}, 1)" if part == r"\1" else sql_text(part)
                for part in spec[1].replace(r"\1", "\0\\1\0").split("\0") if part)
            flush(link=f"CASE WHEN regexp_matches(link, {sql_text(pattern)}) THEN {filled} ELSE link END")
        elif spec[0] == "first_link":
            first = """nullif(regexp_extract(content, '(?i)(?:href|src)="([^"]*)"', 1), '')"""
            flush(link=f"CASE WHEN prefix(link, '{spec[1]}') THEN coalesce({first}, link) ELSE link END")
        elif spec[0] == "title":
            found = f"nullif(trim(regexp_extract(content, {sql_text('(?ms)' + spec[2])}, 1)), '')"
            flush(title=f"CASE WHEN title IS NULL OR title IN ('', 'Untitled') THEN coalesce({found}, title) ELSE title END")
    flush()
    return with_model(f"SELECT * FROM c{step}", "pages", extra=",\n".join(ctes))


def _digg(m):
    """Articles behind a link page: some stored by GUID, some whose page is known."""
    at = F.concat(F.lit("http://digg.com/"), F.col("page_id").cast("string"))
    rows = m.articles.withColumns({
        "link": F.when(F.col("page_id") % 3 == 0, F.col("link")).otherwise(at),
        "guid": F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("doc:"), F.col("page_id").cast("string"))).otherwise(F.col("guid")),
    })
    pages = m.table("pages").select(at.alias("url"), F.concat(
        F.lit('<h3 id="title1"><a href="'), "url", F.lit('">'), "html").alias("html"))
    out = C.dereference(rows, "digg.com", '<h3 id="title1"><a href="([^"]*)"', m.items, pages)
    return out.select("page_id", "guid", "link")


def _listed(m):
    """A subscription list: the source of every document, most of them many times."""
    site = F.concat(F.lit("feed://"), "source", F.lit(".example.com/feed"))
    return m.table("documents").select(
        site.alias("xml_url"), F.concat(F.lit("http://"), "source", F.lit("/")).alias("html_url"),
        F.col("source").alias("title"), F.lit("d").alias("desc"))


def _linked(m):
    return m.items.withColumn("item_link", F.concat(F.lit("http://x/"), F.md5("item_title")))


def _counts(frames: dict) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])


def _patches(m):
    """Feeds with liked articles: new title, made private, filter blanked."""
    liked = m.items.where("item_rating = 1").groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(F.max("item_uid").alias("top"))
    return liked.select("feed_uid", F.concat(F.lit("Top "), F.col("top").cast("string")).alias("feed_title"),
                        F.lit(True).alias("feed_private"), F.lit(" ").alias("feed_filter"))


def _edits(m):
    return m.table("benchmark").select(
        F.col("item_id").alias("item_uid"), F.concat(F.lit("http://edited/"), F.col("item_id").cast("string")).alias("link"),
        F.lit("Edited").alias("title"), F.col("text").alias("content"))


def _merged(m):
    changes = I.item_changes(m.items, M.apply_ratings(m.items, m.rating_events))
    merged = I.merge_stats(A.feed_stats(m.items, AS_OF), changes).drop("snr")
    return merged.withColumn("last_modified", S.datetime_text(F.col("last_modified")))


def _failures(m):
    return failure_runs(m.fetch_log).select("feed_uid", "seq", "failures")


RUNS_SQL = """
marked AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY feed_uid ORDER BY ts, seq) AS era FROM fetch_log),
runs AS (
  SELECT m.*, CAST(count(*) FILTER (NOT ok) OVER (PARTITION BY m.feed_uid, era ORDER BY ts, seq) AS BIGINT) AS failures,
    CAST(count(*) FILTER (NOT ok) OVER (PARTITION BY m.feed_uid, era ORDER BY ts, seq)
      + CASE WHEN era = 0 THEN coalesce(feed_errors, 0) ELSE 0 END AS BIGINT) AS errors
  FROM marked m LEFT JOIN feeds f ON m.feed_uid = f.feed_uid
)"""

IMAGE = '<img[^>]*width="1"[^>]*height="1"[^>]*>'

QUERIES = {
    # ---- subscriptions
    "import_feeds": (
        lambda m: O.import_feeds(_listed(m), m.feeds.where("feed_uid < 8"))[0],
        with_model("""SELECT feed_xml, min(html) AS feed_html, min(title) AS feed_title, min(descr) AS feed_desc, '' AS feed_etag FROM (
          SELECT 'http://' || source || '.example.com/feed' AS feed_xml, 'http://' || source || '/' AS html, source AS title, 'd' AS descr FROM documents)
        WHERE feed_xml NOT IN (SELECT feed_xml FROM feeds WHERE feed_uid < 8) GROUP BY 1""", "feeds")),
    "import_counts": (
        lambda m: O.import_feeds(_listed(m), m.feeds.where("feed_uid < 8"))[1],
        with_model("""SELECT CAST(sum(CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS added,
          CAST(sum(n - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS duplicates FROM (
          SELECT 'http://' || source || '.example.com/feed' AS x, count(*) AS n,
            'http://' || source || '.example.com/feed' IN (SELECT feed_xml FROM feeds WHERE feed_uid < 8) AS known FROM documents GROUP BY source)""", "feeds")),
    "add_feed": (
        lambda m: O.add_feed(m.feeds.where("feed_uid < 8"), _listed(m).distinct()),
        with_model("""SELECT 'http://' || source || '.example.com/feed' AS feed_xml,
          CASE WHEN 'http://' || source || '.example.com/feed' IN (SELECT feed_xml FROM feeds WHERE feed_uid < 8) THEN 'already exists' ELSE 'added' END AS status
        FROM (SELECT DISTINCT source FROM documents)""", "feeds")),
    # ---- ingest
    "first_guid": (
        lambda m: G.first_guid(m.entries).select("feed_uid", "guid", "position", "title"),
        with_model("SELECT feed_uid, guid, position, title FROM once", "feeds", "entries", extra=BATCH_SQL.strip().rstrip(","))),
    "unseen_entries": (
        lambda m: G.unseen(m.entries, m.stored).select("feed_uid", "guid", "position"),
        with_model("""SELECT feed_uid, guid, position FROM entries e WHERE NOT EXISTS (
          SELECT 1 FROM stored i WHERE i.item_feed_uid = e.feed_uid AND i.item_guid = e.guid)""", "entries")),
    "title_link_dups": (
        lambda m: G.accepted_entries(m.entries, m.stored, m.feeds).select("feed_uid", "position", "title"),
        batch_model("SELECT feed_uid, position, title FROM accepted")),
    "oldest_listed": (
        lambda m: G.oldest(_oldest_batch(m), m.stored).withColumn("oldest", S.datetime_text(F.col("oldest"))),
        with_model(f"""SELECT feed_uid, {ts_text('oldest')} AS oldest FROM (
          SELECT feed_uid, min(created) AS oldest FROM entries WHERE feed_uid % 4 <> 0 GROUP BY 1
          UNION ALL SELECT item_feed_uid, min(item_created) FROM stored WHERE item_feed_uid % 4 = 0
            AND (item_feed_uid, item_guid) IN (SELECT feed_uid, guid FROM entries) GROUP BY 1)""", "entries")),
    "ingest_items": (
        lambda m: _ingest(m).new_items.select(
            "item_uid", "item_feed_uid", "item_guid", "item_link", "item_md5hex", "item_title", "item_creator",
            S.datetime_text(F.col("item_created")).alias("item_created"), "item_rating", "item_rule_uid", "item_rule_side"),
        batch_model(f"""SELECT item_uid, item_feed_uid, item_guid, item_link, item_md5hex, item_title, item_creator,
          {ts_text('item_created')} AS item_created, CASE WHEN rule_uid IS NULL THEN 0 ELSE -2 END AS item_rating,
          rule_uid AS item_rule_uid, side AS item_rule_side FROM new_items LEFT JOIN first USING (item_uid)""", "rules", extra=INGEST_SQL)),
    "ingest_tags": (
        lambda m: _ingest(m).new_tags,
        batch_model("SELECT * FROM new_tags", extra=NEW_SQL)),
    "ingest_counts": (
        lambda m: _ingest(m).counters,
        batch_model("""SELECT item_feed_uid AS feed_uid, count(*) FILTER (rule_uid IS NULL) AS num_added,
          count(*) FILTER (rule_uid IS NOT NULL) AS num_filtered FROM new_items LEFT JOIN first USING (item_uid) GROUP BY 1""",
                    "rules", extra=INGEST_SQL)),
    "rewrite_links": (
        lambda m: L.rewrite_promoted(m.items, _redirects(m)).select("item_uid", "item_link"),
        with_model("""SELECT item_uid, CASE WHEN item_rating > 0 AND substr(md5(item_link), 1, 1) < '8'
          THEN 'http://final.example.com/' || md5(item_link) ELSE item_link END AS item_link FROM items""", "items")),
    "resolve_guid": (
        lambda m: L.resolve_guid(_linked(m))[0].select("item_uid", "item_guid", "item_link"),
        with_model("""SELECT item_uid, coalesce(new_guid, item_guid) AS item_guid, item_link FROM linked
        LEFT JOIN (SELECT CASE WHEN lo = gone THEN hi ELSE lo END AS keep, new_guid FROM pairs WHERE n = 2) ON keep = item_uid
        WHERE item_uid NOT IN (SELECT gone FROM pairs WHERE n = 2)""", "items", extra="""
          linked AS (SELECT * REPLACE ('http://x/' || md5(item_title) AS item_link) FROM items),
          pairs AS (SELECT item_feed_uid, item_link, count(*) AS n, min(item_uid) AS gone, arg_min(item_guid, item_uid) AS new_guid,
            min(item_uid) AS lo, max(item_uid) AS hi FROM linked GROUP BY 1, 2 HAVING count(*) > 1)""")),
    "resolve_guid_report": (
        lambda m: L.resolve_guid(_linked(m).withColumn("item_link", F.lower("item_creator")))[1],
        with_model("""SELECT item_feed_uid, lower(item_creator) AS item_link, count(*) AS n FROM items
        GROUP BY 1, 2 HAVING count(*) > 2""", "items")),
    # ---- maintenance
    "last_rating": (
        lambda m: M.last_rating(m.rating_events).withColumn("rated", S.datetime_text(F.col("rated"))),
        with_model(f"""SELECT item_uid, CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 ELSE -1 END AS rating, {ts_text('ts')} AS rated
        FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n FROM rating_events
          WHERE op IS NOT NULL) WHERE n = 1""", "events")),
    "apply_ratings": (
        lambda m: M.apply_ratings(m.items, m.rating_events).select(
            "item_uid", "item_rating", S.datetime_text(F.col("item_rated")).alias("item_rated")),
        with_model(f"""SELECT i.item_uid, coalesce(CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 WHEN 'demote' THEN -1 END, item_rating) AS item_rating,
          {ts_text('coalesce(ts, item_rated)')} AS item_rated
        FROM items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n
          FROM rating_events WHERE op IS NOT NULL) WHERE n = 1) e ON i.item_uid = e.item_uid""", "items", "events")),
    "catch_up": (
        lambda m: M.catch_up(m.items, 6).select("item_uid", "item_rating"),
        with_model("""SELECT item_uid, CASE WHEN item_feed_uid = 6 AND item_rating = 0 THEN -1 ELSE item_rating END AS item_rating
        FROM items""", "items")),
    "title_dup_count": (
        lambda m: M.title_dup_count(m.items).select("item_uid", "copies"),
        with_model("SELECT item_uid, count(*) OVER (PARTITION BY item_feed_uid, item_title) AS copies FROM items", "items")),
    "same_title": (
        lambda m: M.same_title(m.items).select("item_uid", "item_title"),
        with_model("""SELECT item_uid, item_title FROM items i WHERE EXISTS (SELECT 1 FROM items j WHERE j.item_feed_uid = i.item_feed_uid
          AND j.item_uid <> i.item_uid AND j.item_title = i.item_title)""", "items")),
    "dedupe": (
        lambda m: M.dedupe(m.items).select("item_uid", "item_rating"),
        with_model("""SELECT item_uid, CASE WHEN item_rating = 0 AND n > 1 THEN -1 ELSE item_rating END AS item_rating
        FROM (SELECT *, count(*) OVER (PARTITION BY item_feed_uid, item_title) AS n FROM items)""", "items")),
    "dedupe_count": (
        lambda m: M.dedupe_count(m.items),
        with_model("""SELECT count(*) AS modified FROM (SELECT *, count(*) OVER (PARTITION BY item_feed_uid, item_title) AS n FROM items)
        WHERE item_rating = 0 AND n > 1""", "items")),
    "purge_unread": (
        lambda m: M.purge_unread(m.items, 3).select("item_uid"),
        with_model("SELECT item_uid FROM items WHERE NOT (item_feed_uid = 3 AND item_rating = 0)", "items")),
    "purge_reload": (
        # Unread articles go, the feed is read again; the stored ones stay out of the batch.
        lambda m: M.purge_reload(m.items, m.feeds, m.rules, m.entries, 3, AS_OF)[1].new_items.select("item_guid", "item_title"),
        batch_model("SELECT guid AS item_guid, title AS item_title FROM accepted WHERE feed_uid = 3", "items").replace(
            BATCH_SQL.strip(), "kept AS (SELECT * FROM items WHERE NOT (item_feed_uid = 3 AND item_rating = 0)),"
            + BATCH_SQL.replace("FROM stored", "FROM kept"))),
    "hard_purge": (
        lambda m: _keys_of(*M.hard_purge(m.feeds, m.items, m.rules, m.tags, 4)),
        with_model("""SELECT 'feeds' AS name, CAST(feed_uid AS VARCHAR) AS id FROM feeds WHERE feed_uid <> 4
        UNION ALL SELECT 'items', CAST(item_uid AS VARCHAR) FROM items WHERE item_feed_uid <> 4
        UNION ALL SELECT 'rules', CAST(rule_uid AS VARCHAR) FROM rules WHERE coalesce(rule_feed_uid, 0) <> 4
        UNION ALL SELECT 'tags', tag_item_uid || ' ' || tag_name FROM tags WHERE tag_item_uid IN (SELECT item_uid FROM items WHERE item_feed_uid <> 4)""",
                   "feeds", "items", "rules", "tags")),
    "patch_feeds": (
        lambda m: M.patch_feeds(m.feeds, _patches(m)).select("feed_uid", "feed_title", "feed_private", "feed_filter", "feed_status"),
        with_model("""SELECT f.feed_uid, coalesce('Top ' || top, feed_title) AS feed_title, coalesce(feed_private OR n IS NOT NULL, feed_private) AS feed_private,
          CASE WHEN n IS NULL THEN feed_filter END AS feed_filter, feed_status FROM feeds f
        LEFT JOIN (SELECT item_feed_uid, count(*) AS n, max(item_uid) AS top FROM items WHERE item_rating = 1 GROUP BY 1) ON item_feed_uid = f.feed_uid""",
                   "feeds", "items")),
    "clear_old_content": (
        lambda m: M.clear_old_content(m.items, AS_OF).select("item_uid", "item_content"),
        with_model(f"""SELECT item_uid, CASE WHEN item_rating < 0 AND item_created < {ago('7')} THEN '' ELSE item_content END AS item_content
        FROM items""", "items")),
    "item_store": (_item_store, with_model(ITEM_STORE_SQL, "items", "feeds", "events")),
    "expire_items": (
        lambda m: M.expire_items(m.items, m.feeds, AS_OF).select("item_uid"),
        with_model(f"""SELECT item_uid FROM items LEFT JOIN feeds ON item_feed_uid = feed_uid
        WHERE NOT coalesce(item_rating < 0 AND feed_oldest IS NOT NULL AND item_created < least({ago('180')}, feed_oldest - INTERVAL 7 DAY), FALSE)""",
                   "items", "feeds")),
    "orphan_tags": (
        lambda m: M.orphan_tags(m.tags, m.stored).select("tag_item_uid", "tag_name"),
        with_model("""SELECT tag_item_uid, tag_name FROM tags WHERE tag_item_uid NOT IN (SELECT item_uid FROM items WHERE item_rating IN (1, -1))""",
                   "tags", "items")),
    "drop_orphan_tags": (
        lambda m: M.cleanup(m.items, m.feeds, m.tags, AS_OF)[1],
        with_model(f"""SELECT tag_item_uid, tag_name, tag_by FROM tags WHERE tag_item_uid IN (
          SELECT item_uid FROM items LEFT JOIN feeds ON item_feed_uid = feed_uid
          WHERE NOT coalesce(item_rating < 0 AND feed_oldest IS NOT NULL AND item_created < least({ago('180')}, feed_oldest - INTERVAL 7 DAY), FALSE))""",
                   "tags", "items", "feeds")),
    "add_tags": (
        lambda m: G.add_tags(m.tags.where("tag_name <> 'en'"), m.tags.unionByName(m.tags)),
        with_model("SELECT DISTINCT tag_item_uid, tag_name, tag_by FROM tags", "tags")),
    "error_runs": (
        lambda m: M.error_runs(m.fetch_log, m.feeds, 12),
        with_model("""SELECT feed_uid, count(*) AS fetches, arg_max(errors, seq) AS feed_errors, max(errors) AS longest,
          max(errors) > 12 AS suspended, arg_min(errors, seq) FILTER (errors > 12) AS suspended_at FROM runs GROUP BY feed_uid""", "feeds", "events", extra=RUNS_SQL)),
    "failure_runs": (
        _failures,
        with_model("SELECT feed_uid, seq, failures FROM runs", "feeds", "events", extra=RUNS_SQL)),
    "clear_errors": (
        lambda m: M.clear_errors(m.feeds, m.fetch_log).select(
            "feed_uid", "feed_errors", "feed_etag", S.datetime_text(F.col("feed_modified")).alias("feed_modified")),
        with_model(f"""SELECT f.feed_uid, CASE WHEN l.ts IS NULL THEN feed_errors ELSE 0 END AS feed_errors,
          CASE WHEN l.ts IS NULL THEN feed_etag ELSE l.etag END AS feed_etag,
          {ts_text('CASE WHEN l.ts IS NULL THEN feed_modified ELSE l.modified END')} AS feed_modified
        FROM feeds f LEFT JOIN (SELECT feed_uid, max(ts) AS ts, arg_max(etag, seq) AS etag, arg_max(modified, seq) AS modified
          FROM fetch_log WHERE ok GROUP BY 1) l USING (feed_uid)""", "feeds", "events")),
    "notify_suspended": (
        lambda m: M.notify_suspended(M.error_runs(m.fetch_log, m.feeds, 12), AS_OF, 12).select(
            "item_feed_uid", "item_guid", "item_link", "item_title", "item_content", "item_rating"),
        with_model("""SELECT feed_uid AS item_feed_uid, 'notice://' || feed_uid || '/' || md5(text) AS item_guid,
          '/feed/' || feed_uid AS item_link, 'Service notification' AS item_title, text AS item_content, 0 AS item_rating
        FROM (SELECT feed_uid, 'This feed was suspended because of ' || arg_min(errors, seq) || ' consecutive errors' AS text
          FROM runs WHERE errors > 12 GROUP BY 1)""",
                   "feeds", "events", extra=RUNS_SQL)),
    "edit_items": (
        lambda m: M.edit_items(m.items, _edits(m)).select("item_uid", "item_link", "item_title", "item_content"),
        with_model("""SELECT i.item_uid, CASE WHEN b.text IS NULL THEN item_link ELSE 'http://edited/' || item_id END AS item_link,
          CASE WHEN b.text IS NULL THEN item_title ELSE 'Edited' END AS item_title, coalesce(b.text, item_content) AS item_content
        FROM items i LEFT JOIN benchmark b ON b.item_id = i.item_uid""", "items")),
    "merge_stats": (
        # Statistics after a round of ratings, kept incrementally.
        lambda m: _merged(m),
        with_model("""SELECT feed_uid, count(*) FILTER (r = 1) AS interesting, count(*) FILTER (r = 0) AS unread,
          count(*) FILTER (r = -1) AS uninteresting, count(*) FILTER (r = -2) AS filtered, count(*) AS total,
          strftime(max(coalesce(item_modified, item_created)), '%Y-%m-%d %H:%M:%S') AS last_modified
        FROM (SELECT item_feed_uid AS feed_uid, item_modified, item_created,
          coalesce(CASE op WHEN 'promote' THEN 1 WHEN 'basic' THEN 0 WHEN 'demote' THEN -1 END, item_rating) AS r
        FROM items i LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY ts DESC, event_id DESC) AS n
          FROM rating_events WHERE op IS NOT NULL) WHERE n = 1) e ON i.item_uid = e.item_uid) GROUP BY 1""", "items", "events")),
    # ---- cleaning and discovery
    "strip_pattern": (
        lambda m: m.articles.select("page_id", C.re_sub(F.col("content"), IMAGE).alias("content")),
        with_model(f"SELECT page_id, regexp_replace(content, '{IMAGE}', '', 'g') AS content FROM articles", "pages")),
    "strip_repeated": (
        lambda m: m.articles.select(
            "page_id", C.re_sub(C.re_sub(F.col("content"), "<br>[.>]<br>", "", "<br>", True), "<span[^>]*></span>", "", "", True).alias("content")),
        with_model("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(content, '<br>(?:[.>]<br>)+', '<br>', 'g'),
          '<span[^>]*></span>', '', 'g'), '<span[^>]*></span>', '', 'g') AS content FROM articles""", "pages")),
    "strip_limited": (
        lambda m: m.articles.select("page_id", C.limit_to("xkcd.com", F.col("link"), F.col("content"), lambda c: C.re_sub(c, IMAGE)).alias("content")),
        with_model(f"""SELECT page_id, CASE WHEN contains(link, 'xkcd.com') THEN regexp_replace(content, '{IMAGE}', '', 'g') ELSE content END AS content
        FROM articles""", "pages")),
    "rewrite_link": (
        lambda m: m.articles.select("page_id", C.re_url(
            F.col("link"), F.col("content"), r"http://m.example.com/\1", r"http://xkcd.com/(.*)", r'<a href="/(the[^"]*)"').alias("link")),
        with_model(r"""SELECT page_id, CASE WHEN regexp_matches(link, 'http://xkcd.com/(.*)') THEN 'http://m.example.com/' || regexp_extract(link, 'http://xkcd.com/(.*)', 1)
          WHEN regexp_matches(content, '<a href="/(the[^"]*)"') THEN 'http://m.example.com/' || regexp_extract(content, '<a href="/(the[^"]*)"', 1)
          ELSE link END AS link FROM articles""", "pages")),
    "rewrite_title": (
        lambda m: m.articles.select("page_id", C.re_title(F.col("title"), F.col("content"), r"\1!", "<h1>(.*?)</h1>").alias("title")),
        with_model("""SELECT page_id, CASE WHEN title IN ('', 'Untitled') AND regexp_matches(content, '<h1>(.*?)</h1>')
          THEN trim(regexp_extract(content, '<h1>(.*?)</h1>', 1) || '!') ELSE title END AS title FROM articles""", "pages")),
    "first_link": (
        lambda m: m.articles.select("page_id", C.use_first_link("http://evanmiller.org/", F.col("link"), F.col("content")).alias("link")),
        with_model("""SELECT page_id, CASE WHEN prefix(link, 'http://evanmiller.org/')
          THEN coalesce(nullif(regexp_extract(content, '(?i)(?:href|src)="([^"]*)"', 1), ''), link) ELSE link END AS link FROM articles""", "pages")),
    "dereference": (
        _digg,
        with_model("""SELECT page_id, guid, CASE WHEN page_id % 3 = 0 THEN link ELSE coalesce(item_link, url) END AS link FROM (
          SELECT a.page_id, a.link, p.url, CASE WHEN a.page_id % 2 = 0 THEN 'doc:' || a.page_id ELSE guid END AS guid
          FROM articles a JOIN pages p USING (page_id)) LEFT JOIN items ON item_guid = guid""", "pages", "items")),
    "clean_own_filters": (
        lambda m: C.clean(m.articles, OWN_FILTERS).select("page_id", "link", "title", "content"),
        with_model("""SELECT page_id, CASE WHEN prefix(link, 'http://evanmiller.org/')
            THEN coalesce(nullif(regexp_extract(c, '(?i)(?:href|src)="([^"]*)"', 1), ''), link) ELSE link END AS link, title, c AS content
        FROM (SELECT *, CASE WHEN contains(link, 'xkcd') THEN regexp_replace(b, '<p>', '<P>', 'g') ELSE b END AS c
          FROM (SELECT *, regexp_replace(regexp_replace(content, '(?i)<br */?>', ' ', 'g'), '(?:the )+', 'the ', 'g') AS b FROM articles))""", "pages")),
    "clean_articles": (lambda m: C.clean(m.articles).select("page_id", "link", "title", "content"), clean_sql()),
    "remove_scripts": (
        lambda m: m.articles.select("page_id", H.remove_scripts(F.col("content")).alias("content")),
        with_model("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<script\\b.*?</script\\s*>', '', 'g'),
          '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<(?:script|style)\\b.*$', '', 'g') AS content FROM articles""", "pages")),
    "discover_feeds": (
        lambda m: D.discover_feeds(m.pages).select("page_id", "feed_url"),
        with_model("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', 'feed.atom')
          WHEN 1 THEN 'http://f.example.com/x' WHEN 2 THEN 'http://base.example.com/a/rss.xml' END AS feed_url FROM web""", "pages")),
    "candidate_feeds": (
        lambda m: D.candidate_feeds(m.pages),
        with_model(f"""SELECT url, attempt, CASE WHEN prefix(suffix, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || suffix
            WHEN prefix(suffix, '?') THEN regexp_replace(url, '[?#].*$', '') || suffix
            ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', suffix) END AS candidate
        FROM web, (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(D.FEED_SUFFIXES))}) v(attempt, suffix)
        WHERE page_id % 5 > 2""", "pages")),
}
