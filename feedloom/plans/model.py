"""The feed model derived from the driver's tables, in Spark and in SQL.

Every table is a whole-table derivation: one item per document, one feed per
source. ``MODEL_SQL`` states the same derivations for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import schema
from feedloom.functions.scalars import as_of_column
from feedloom.functions.text import LIGATURES, WORD, fold_table
from feedloom.operators.sizing import broadcast_if_small
from feedloom.sources.tables import conform, spread

AS_OF = "2024-01-31 00:00:00"
DAY = 86_400_000_000

#: rule_uid, rule_type, rule_feed_uid, rule_expires, rule_text
RULES: list[tuple] = [
    (1, "title_word", None, None, "oned"),
    (2, "content_word", 3, None, "disgusting eringed"),
    (3, "union_word", None, "2023-06-01 00:00:00", "the"),
    (4, "title_exactword", None, "2025-01-01 00:00:00", "für auf"),
    (5, "content_exactword", 4, None, "Élle para"),
    (6, "union_exactword", 8, None, "nicht"),
    (7, "title_all", None, None, "thing oned"),
    (8, "content_all", 2, None, "ering thes oning"),
    (9, "union_all", 7, None, "und sich"),
    (10, "content_all", 12, None, ""),
    (11, "tag", None, None, "de"),
    (12, "tag", None, None, "es"),
    (13, "tag", 4, None, "FR"),
    (14, "author", None, None, 'desk "fr"'),
    (15, "author", 9, None, "nobody"),
    (16, "title_phrase", None, None, "Thst"),
    (17, "content_phrase", 6, None, "tion on"),
    (18, "union_phrase", 14, None, "is on"),
    (19, "title_phrase_lc", None, None, "the and"),
    (20, "content_phrase_lc", 10, None, "ing the"),
    (21, "union_phrase_lc", 15, None, "with by"),
    (22, "python", None, None, "# long and hard\nlength(content) > 20000\nAND any_word(title_words, array('the', 'of'))"),
    (23, "python", 16, None, "any_in(title_lc, array('ous', 'ent')) OR 1 div (length(title) - length(title)) = 1"),
    (24, "python", None, None, "no_such_field > 3"),
    (25, "python", None, None, "cast(title AS int) > 0"),
    (27, "python", None, None, "title rlike '('"),
    (28, "python", None, None, "raise_error('x') IS NULL"),
    (29, "python", None, None, "count(1) > 0"),
    (30, "python", None, None, "explode(array(1, 2)) = 1"),
    (33, "python", None, None, "row_number() OVER (ORDER BY title) > 0"),
    (34, "python", 12, None, "array_contains(category, 'en') AND any_word(title_words, array('the', 'ere'))"),
    # Rules that would raise on some title: an index of zero, a sequence that runs backwards, a pattern from the text.
    (35, "python", None, None, "element_at(split(title, ' '), length(title) - 5) = 'qqq'"),
    (36, "python", None, None, "size(sequence(1, length(title), -1)) > 0"),
    (37, "python", None, None, "to_date(title, author) IS NULL"),
    (38, "python", 18, None, "length(content) / (length(title) - length(title)) IS NULL AND element_at(split(title, ' '), 1) ILIKE 'th%'"),
    (26, "title_exactword", None, "2020-01-01 00:00:00", "of and"),
]

LOG_TYPES = ("error", "view", "click")


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


class Model:
    """Lazily built tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.as_of = AS_OF

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def feeds(self) -> DataFrame:
        """One feed per source and one (uid 0) without articles."""
        spark = self.spark
        sources = self.table("documents").select("source").distinct()
        uid = F.substring("source", 4, 20).cast("long") + 1
        rows = sources.select(uid.alias("feed_uid"), "source").unionByName(
            spark.range(1).select(F.col("id").alias("feed_uid"), F.lit("empty").alias("source"))
        )
        u, site = F.col("feed_uid"), F.concat(F.lit("http://"), "source", F.lit(".example.com/"))
        now = as_of_column(AS_OF)

        def back(days):
            return F.timestamp_micros(F.unix_micros(now) - days * F.lit(DAY))

        built = rows.select(
            u.alias("feed_uid"), F.concat(site, F.lit("feed")).alias("feed_xml"),
            F.when(u % 4 == 1, F.concat(site, F.lit("public"))).alias("feed_pubxml"),
            site.alias("feed_html"), F.concat(F.lit("Feed "), "source").alias("feed_title"),
            F.concat(F.lit("News & views from "), "source").alias("feed_desc"),
            F.concat(F.lit("e"), u.cast("string")).alias("feed_etag"),
            back(u).alias("feed_modified"), (u % 13).cast("int").alias("feed_errors"),
            F.when((u % 11 == 0) & (u > 0), 1).otherwise(0).alias("feed_status"),
            (u % 7 == 0).alias("feed_private"), (u % 2 == 1).alias("feed_dupcheck"),
            ((u % 5 == 0) & (u > 0)).alias("feed_exempt"),
            F.when(u % 6 != 0, back(F.lit(100))).alias("feed_oldest"),
            F.when(u % 9 == 4, F.lit("length(title) > 200")).alias("feed_filter"),
        )
        return broadcast_if_small(conform(built, schema.FEEDS))

    @cached_property
    def items(self) -> DataFrame:
        """One article per document, rated by its label where it has one."""
        return self._articles(self.table("documents"))

    @cached_property
    def texts(self) -> DataFrame:
        """The same articles for work on their text, spread over the cores."""
        return self.texts_with()

    def texts_with(self, *more: str) -> DataFrame:
        """``texts`` with ``more`` columns of the documents."""
        return self._articles(spread(self.table("documents"), "doc_id"), *more)

    def _articles(self, documents: DataFrame, *more: str) -> DataFrame:
        """Articles of the documents, with ``more`` of their columns."""
        docs = documents.join(self.table("labels"), "doc_id", "left")
        uid = F.col("doc_id")
        site = F.concat(F.lit("http://"), "source", F.lit(".example.com/"))
        created = F.timestamp_micros(F.unix_micros(as_of_column(AS_OF)) - (uid * 37 % 400) * F.lit(DAY))
        rule = F.when(F.col("quality").isNotNull(), None).when(F.col("lang") == "de", 11).when(F.col("lang") == "es", 12)
        rating = (
            F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1)
            .when(rule.isNotNull(), -2).otherwise(0)
        )

        def later(days, hours=0):
            return F.timestamp_micros(F.unix_micros("item_created") + F.lit(days * DAY + hours * DAY // 24))

        built = docs.select(
            uid.alias("item_uid"), (F.substring("source", 4, 20).cast("long") + 1).alias("item_feed_uid"),
            F.concat(F.lit("doc:"), uid.cast("string")).alias("item_guid"),
            F.concat(site, F.md5(F.substring_index("text", "\n", -1))).alias("item_link"),
            F.substring_index("text", "\n", 1).alias("item_title"), F.col("text").alias("item_content"),
            F.md5("text").alias("item_md5hex"),
            F.when(F.col("lang") == "en", schema.UNKNOWN_AUTHOR).otherwise(
                F.concat(F.lit('Desk "'), "lang", F.lit('"'))).alias("item_creator"),
            created.alias("item_created"), rating.alias("item_rating"), rule.cast("long").alias("item_rule_uid"), *more,
        ).withColumns({
            "item_loaded": later(0, 1),
            "item_modified": F.when(F.col("item_uid") % 3 != 0, later(2)),
            "item_rated": F.when(F.col("item_rating").isin(1, -1), later(3)),
        }).withColumn("updated", F.coalesce("item_rated", "item_modified", "item_loaded"))
        kept = T.StructType([*schema.ITEMS.fields, *(documents.schema[c] for c in more)])
        return conform(built, kept)

    @cached_property
    def tags(self) -> DataFrame:
        docs = self.table("documents")
        return docs.select(
            F.col("doc_id").alias("tag_item_uid"), F.explode(F.array("lang", "source")).alias("tag_name"),
            F.lit(0).alias("tag_by"),
        )

    @cached_property
    def rules(self) -> DataFrame:
        """The listed rules, and one phrase rule per benchmark passage (its first sentence)."""
        fixed = self.spark.createDataFrame(
            RULES, "rule_uid long, rule_type string, rule_feed_uid long, rule_expires string, rule_text string"
        ).withColumn("rule_expires", F.col("rule_expires").cast("timestamp"))
        sentence = F.substring_index("text", ".", 1)
        odd = F.col("item_id") % 2 == 1
        passages = self.table("benchmark").select(
            (F.col("item_id") + 1000).alias("rule_uid"),
            F.when(odd, "union_phrase_lc").otherwise("content_phrase").alias("rule_type"),
            F.lit(None).cast("long").alias("rule_feed_uid"), F.lit(None).cast("timestamp").alias("rule_expires"),
            F.when(odd, F.lower(sentence)).otherwise(sentence).alias("rule_text"),
        )
        return broadcast_if_small(conform(fixed.unionByName(passages), schema.RULES))

    @cached_property
    def stored(self) -> DataFrame:
        """Articles stored before the batch: those somebody has labelled."""
        return self.items.where(F.col("item_rating").isin(1, -1))

    @cached_property
    def entries(self) -> DataFrame:
        """The batch: every article, and labelled ones a second time further down."""
        docs = self.texts_with("lang", "source")
        first = docs.select(
            F.col("item_feed_uid").alias("feed_uid"), F.col("item_uid").alias("position"),
            F.col("item_guid").alias("guid"), F.col("item_link").alias("link"), F.col("item_title").alias("title"),
            F.col("item_content").alias("content"), F.col("item_creator").alias("author"),
            F.col("item_created").alias("created"), F.col("item_modified").alias("modified"),
            F.array("lang", "source").alias("tags"),
            (F.length("item_content") < 100).alias("runt"), "item_rating",
        )
        again = first.where(F.col("item_rating") == 0).withColumns({
            "position": F.col("position") + 1_000_000_000, "title": F.concat(F.lit("Update: "), "title"),
        })
        return first.unionByName(again).drop("item_rating")

    @cached_property
    def rating_events(self) -> DataFrame:
        """Purchases promote, errors demote, clicks reset; anything else is no rating."""
        n = self.table("documents").agg(F.count(F.lit(1)).alias("n")).first()["n"]
        kind = F.col("event_type")
        op = F.when(kind == "purchase", "promote").when(kind == "error", "demote").when(kind == "click", "basic")
        return self.table("events").select(
            "event_id", (F.col("event_id") % F.lit(n)).alias("item_uid"), op.alias("op"), "ts"
        )

    @cached_property
    def fetch_log(self) -> DataFrame:
        """One fetch per event: the user id picks the feed, errors, views and clicks fail."""
        ok = ~F.col("event_type").isin(*LOG_TYPES)
        return self.table("events").select(
            (F.col("user_id") % 21).alias("feed_uid"), "ts", F.col("event_id").alias("seq"), ok.alias("ok"),
            F.when(ok, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("etag"),
            F.when(ok, F.col("ts")).alias("modified"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        """Web pages with a head that names feeds in several ways, and some clutter."""
        kind = F.col("page_id") % 5
        link = '<link rel="alternate" type="application/{0}+xml" href="{1}" title="{2}">'
        head = (
            F.when(kind == 0, F.lit(link.format("rss", "/feed.rss", "Posts") + link.format("atom", "feed.atom", "Posts")))
            .when(kind == 1, F.lit(link.format("atom", "/comments/atom", "Talk") + link.format("rss", "http://f.example.com/x", "All")))
            .when(kind == 2, F.lit('<base href="http://base.example.com/a/b">' + link.format("rss", "rss.xml", "Posts")))
            .when(kind == 3, F.lit(link.format("rss", "/talk", "Comments Feed")))
            .otherwise(F.lit(""))
        )
        tail = (
            F.when(kind == 0, F.lit('<img src="x" width="1" height="1"><br><br ><br/>'))
            .when(kind == 1, F.lit('<FORM action="/q"><input></form><span><span a="1"></span></span>'))
            .when(kind == 2, F.lit('<br>.<br>.<br><a href="http://digg.com/submit?u">d</a> - - - <p class="x"></p>'))
            .when(kind == 3, F.lit('<div class="feedflare"><p>x</p></div><p>see feediz.com now</p><h3></h3>'))
            .otherwise(F.lit("<br>\n<br>"))
        )
        body = F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>")))
        return spread(self.table("pages"), "page_id").select("page_id", "url", F.concat(body, tail).alias("html"))

    @cached_property
    def articles(self) -> DataFrame:
        """Pages as articles to clean: guid, link, title, content."""
        kind = F.col("page_id") % 5
        link = (
            F.when(kind == 0, F.concat(F.lit("http://xkcd.com/"), F.col("page_id").cast("string")))
            .when(kind == 1, F.concat(F.lit("http://evanmiller.org/#"), F.col("page_id").cast("string")))
            .when(kind == 2, F.concat(F.lit("http://go.theregister.com/feed/"), "url"))
            .otherwise(F.col("url"))
        )
        title = F.when(kind == 3, F.lit("Untitled")).otherwise(
            F.regexp_extract("html", "<title>([^<]*)</title>", 1))
        return self.pages.select(
            "page_id", F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("guid"),
            link.alias("link"), title.alias("title"), F.col("html").alias("content"),
        )

    @cached_property
    def stats(self) -> DataFrame:
        from feedloom.operators.stats import feed_stats

        return feed_stats(self.items, self.as_of)

    @cached_property
    def feeds_snr(self) -> DataFrame:
        from feedloom.operators.stats import feeds_snr

        return feeds_snr(self.feeds, self.stats, self.as_of)


_MODELS: dict[tuple, Model] = {}


def model(spark: SparkSession, path: str) -> Model:
    key = (spark.sparkContext.applicationId, path)
    if key not in _MODELS:
        _MODELS[key] = Model(spark, path)
    return _MODELS[key]


# ------------------------------------------------------------------- oracle SQL

NOW = f"TIMESTAMP '{AS_OF}'"


def ago(days: str) -> str:
    return f"({NOW} - to_days(CAST({days} AS INTEGER)))"


def age_sql(ts: str) -> str:
    return f"(CAST(epoch_us({NOW}) - epoch_us({ts}) AS DOUBLE) / CAST(86400000000 AS DOUBLE))"


def ts_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


_rule_rows = ",\n    ".join(
    f"({u}, {sql_text(t)}, {f if f is not None else 'NULL'}, "
    + (f"TIMESTAMP {sql_text(e)}" if e else "NULL") + f", {sql_text(x)})"
    for u, t, f, e, x in RULES
)

FEEDS_SQL = f"""
feed_sources AS (
  SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS u, source FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT CAST(0 AS BIGINT), 'empty'
),
feeds AS (
  SELECT u AS feed_uid, 'http://' || source || '.example.com/feed' AS feed_xml,
    CASE WHEN u % 4 = 1 THEN 'http://' || source || '.example.com/public' END AS feed_pubxml,
    'http://' || source || '.example.com/' AS feed_html, 'Feed ' || source AS feed_title,
    'News & views from ' || source AS feed_desc, 'e' || u AS feed_etag, {ago('u')} AS feed_modified,
    CAST(u % 13 AS INTEGER) AS feed_errors, CASE WHEN u % 11 = 0 AND u > 0 THEN 1 ELSE 0 END AS feed_status,
    (u % 7 = 0) AS feed_private, (u % 2 = 1) AS feed_dupcheck, (u % 5 = 0 AND u > 0) AS feed_exempt,
    CASE WHEN u % 6 <> 0 THEN {ago('100')} END AS feed_oldest,
    CASE WHEN u % 9 = 4 THEN 'length(title) > 200' END AS feed_filter
  FROM feed_sources
)"""

ITEMS_SQL = f"""
item_base AS (
  SELECT d.doc_id AS item_uid, CAST(substr(source, 4) AS BIGINT) + 1 AS item_feed_uid,
    'doc:' || d.doc_id AS item_guid,
    'http://' || source || '.example.com/' || md5(split_part(text, chr(10), -1)) AS item_link,
    split_part(text, chr(10), 1) AS item_title, text AS item_content, md5(text) AS item_md5hex,
    CASE WHEN lang = 'en' THEN 'Unknown' ELSE 'Desk "' || lang || '"' END AS item_creator,
    {ago('d.doc_id * 37 % 400')} AS item_created,
    CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN -1
         WHEN lang IN ('de', 'es') THEN -2 ELSE 0 END AS item_rating,
    CASE WHEN quality IS NOT NULL THEN NULL WHEN lang = 'de' THEN 11 WHEN lang = 'es' THEN 12 END AS item_rule_uid,
    CAST(NULL AS VARCHAR) AS item_rule_side, lang, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
item_times AS (
  SELECT *, item_created + INTERVAL 1 HOUR AS item_loaded,
    CASE WHEN item_uid % 3 <> 0 THEN item_created + INTERVAL 2 DAY END AS item_modified,
    CASE WHEN item_rating IN (1, -1) THEN item_created + INTERVAL 3 DAY END AS item_rated
  FROM item_base
),
items AS (SELECT *, coalesce(item_rated, item_modified, item_loaded) AS updated FROM item_times)"""

TAGS_SQL = """
tags AS (
  SELECT doc_id AS tag_item_uid, lang AS tag_name, 0 AS tag_by FROM documents
  UNION ALL SELECT doc_id, source, 0 FROM documents
)"""

RULES_SQL = f"""
rules(rule_uid, rule_type, rule_feed_uid, rule_expires, rule_text) AS (
  SELECT * FROM (VALUES
    {_rule_rows})
  UNION ALL
  SELECT item_id + 1000, CASE WHEN item_id % 2 = 1 THEN 'union_phrase_lc' ELSE 'content_phrase' END, NULL, NULL,
    CASE WHEN item_id % 2 = 1 THEN lower(split_part(text, '.', 1)) ELSE split_part(text, '.', 1) END FROM benchmark
)"""

STATS_SQL = f"""
weighted AS (
  SELECT *, CASE WHEN steps >= 0 THEN pow(CAST(2 AS DOUBLE), -steps) END AS w FROM (
    SELECT *, CAST(trunc(least(62.0, {age_sql('item_created')} / 90)) AS INTEGER) AS steps FROM items)
),
stats AS (
  SELECT item_feed_uid AS feed_uid,
    CAST(count(*) FILTER (item_rating = 1) AS BIGINT) AS interesting,
    CAST(count(*) FILTER (item_rating = 0) AS BIGINT) AS unread,
    CAST(count(*) FILTER (item_rating = -1) AS BIGINT) AS uninteresting,
    CAST(count(*) FILTER (item_rating = -2) AS BIGINT) AS filtered, count(*) AS total,
    max(coalesce(item_modified, item_created)) AS last_modified,
    coalesce(sum(CASE WHEN item_rating > 0 THEN w ELSE w * 0 END) / nullif(sum(w), 0), 0) AS snr
  FROM weighted GROUP BY 1
),
feeds_stats AS (
  SELECT f.*, coalesce(interesting, 0) AS interesting, coalesce(unread, 0) AS unread,
    coalesce(uninteresting, 0) AS uninteresting, coalesce(filtered, 0) AS filtered, coalesce(total, 0) AS total,
    last_modified AS latest, coalesce(snr, 0) AS snr
  FROM feeds f LEFT JOIN stats s USING (feed_uid)
),
feeds_snr AS (SELECT *, {age_sql('latest')} AS last_modified FROM feeds_stats)"""

ENTRIES_SQL = """
entry_rows AS (
  SELECT item_feed_uid AS feed_uid, item_uid AS position, item_guid AS guid, item_link AS link, item_title AS title,
    item_content AS content, item_creator AS author, item_created AS created, item_modified AS modified,
    lang, source, length(item_content) < 100 AS runt, item_rating
  FROM items
),
entries AS (
  SELECT * FROM entry_rows
  UNION ALL
  SELECT * REPLACE (position + 1000000000 AS position, 'Update: ' || title AS title)
  FROM entry_rows WHERE item_rating = 0
),
stored AS (SELECT * FROM items WHERE item_rating IN (1, -1))"""

EVENTS_SQL = """
rating_events AS (
  SELECT event_id, event_id % (SELECT count(*) FROM documents) AS item_uid, ts,
    CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'demote' WHEN 'click' THEN 'basic' END AS op
  FROM events
),
fetch_log AS (
  SELECT user_id % 21 AS feed_uid, ts, event_id AS seq, event_type NOT IN ('error', 'view', 'click') AS ok,
    CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN 't' || event_id END AS etag,
    CASE WHEN event_type NOT IN ('error', 'view', 'click') THEN ts END AS modified
  FROM events
)"""

_link = '<link rel="alternate" type="application/{0}+xml" href="{1}" title="{2}">'
PAGES_SQL = f"""
web AS (
  SELECT page_id, url, replace(html, '</head>', CASE page_id % 5
      WHEN 0 THEN '{_link.format("rss", "/feed.rss", "Posts")}{_link.format("atom", "feed.atom", "Posts")}'
      WHEN 1 THEN '{_link.format("atom", "/comments/atom", "Talk")}{_link.format("rss", "http://f.example.com/x", "All")}'
      WHEN 2 THEN '<base href="http://base.example.com/a/b">{_link.format("rss", "rss.xml", "Posts")}'
      WHEN 3 THEN '{_link.format("rss", "/talk", "Comments Feed")}' ELSE '' END || '</head>')
    || CASE page_id % 5
      WHEN 0 THEN '<img src="x" width="1" height="1"><br><br ><br/>'
      WHEN 1 THEN '<FORM action="/q"><input></form><span><span a="1"></span></span>'
      WHEN 2 THEN '<br>.<br>.<br><a href="http://digg.com/submit?u">d</a> - - - <p class="x"></p>'
      WHEN 3 THEN '<div class="feedflare"><p>x</p></div><p>see feediz.com now</p><h3></h3>'
      ELSE '<br>' || chr(10) || '<br>' END AS html
  FROM pages
),
articles AS (
  SELECT page_id, 'page:' || page_id AS guid,
    CASE page_id % 5 WHEN 0 THEN 'http://xkcd.com/' || page_id WHEN 1 THEN 'http://evanmiller.org/#' || page_id
      WHEN 2 THEN 'http://go.theregister.com/feed/' || url ELSE url END AS link,
    CASE WHEN page_id % 5 = 3 THEN 'Untitled' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
    html AS content
  FROM web
)"""

_PARTS = {
    "feeds": FEEDS_SQL, "items": ITEMS_SQL, "tags": TAGS_SQL, "rules": RULES_SQL,
    "stats": STATS_SQL, "entries": ENTRIES_SQL, "events": EVENTS_SQL, "pages": PAGES_SQL,
}
_NEEDS = {"stats": ("feeds", "items"), "entries": ("items",)}


def with_model(query: str, *parts: str, extra: str = "") -> str:
    """``query`` with the model tables it uses as common table expressions."""
    wanted: list[str] = []
    for part in parts:
        for need in (*_NEEDS.get(part, ()), part):
            if need not in wanted:
                wanted.append(need)
    wanted.sort(key=list(_PARTS).index)
    ctes = [_PARTS[p] for p in wanted] + ([extra] if extra else [])
    return ("WITH " + ",".join(ctes) + "\n" if ctes else "") + query


def fold_sql(text: str) -> str:
    source, target = fold_table()
    out = f"translate(lower({text}), {sql_text(source)}, {sql_text(target)})"
    for char, base in LIGATURES.items():
        if len(base) > 1:
            out = f"replace({out}, '{char}', '{base}')"
    return out


def words_sql(text: str) -> str:
    stripped = f"regexp_replace(coalesce({text}, ''), '<[^>]*>', ' ', 'g')"
    return f"list_distinct(regexp_extract_all({fold_sql(stripped)}, {sql_text(WORD)}))"


def tokens_sql(text: str) -> str:
    filled = f"coalesce({text}, '')"
    return f"regexp_extract_all({fold_sql(filled)}, '[\\p{{L}}\\p{{N}}]+')"


def token_text_sql(text: str) -> str:
    return f"(' ' || array_to_string({tokens_sql(text)}, ' ') || ' ')"
