"""Article views: predicates, joins, orders, pages, search and display."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions import scalars as S
from feedloom.functions import text as T
from feedloom.functions.stemming import stem_phrases, with_stem
from feedloom.operators import search as Q
from feedloom.operators import token_index as TI
from feedloom.operators import view as V
from feedloom.plans.model import (
    AS_OF, age_sql, ago, token_text_sql, tokens_sql, ts_text, with_model, words_sql,
)
from feedloom.plans.reports import since_sql
from feedloom.plans.stem_sql import stem_ctes
from feedloom.session import shared_folder
from feedloom.sources import exports as X
from feedloom.streaming import incremental as I

SHOWS = {"all": "item_rating IS NOT NULL", "unread": "item_rating = 0", "down": "item_rating = -1",
         "up": "item_rating > 0", "filtered": "item_rating = -2"}
SORTS = {"created": "item_created DESC NULLS LAST,", "seen": "", "rated": "item_rated DESC NULLS LAST,",
         "snr": "snr DESC,", "oldest": "item_uid ASC,", "random": "md5('s' || item_uid),"}
SEARCHES = (
    "tion", "the of", '"of the"', "für AND auf", "(oned OR thing) AND ering", 'oned NOT "thing" the',
    "élle OR Ou on", '"is on" OR "thes the" NOT para', "AN(D", "",
)


def _ratings(m):
    """Every rating filter, one after the other."""
    return reduce(DataFrame.unionByName, [
        V.filter_rating(m.items, show).select(F.lit(show).alias("show"), "item_uid") for show in V.RATING_FILTERS
    ])


def _orders(m):
    """The first page of each order."""
    keyed = V.with_stats(V.items_with_feeds(m.items, m.feeds), m.stats)
    return reduce(DataFrame.unionByName, [
        V.page(V.sort_view(keyed, key, "s"), 0, 50).select(F.lit(key).alias("sort"), "item_uid") for key in SORTS
    ])


ALL_SEARCHES = [(query, scope) for query in SEARCHES for scope in ("title", "both")]


def _searches(m):
    return _named(Q.search_many(m.texts, ALL_SEARCHES))


def _index_searches(m):
    """The same searches on a positional index."""
    path = shared_folder(m.spark)
    TI.build(m.texts, path)
    return _named(TI.search_many(m.spark, path, ALL_SEARCHES))


def _updated_index(m):
    """An index after two batches and a compaction of them: uninteresting articles go, filtered ones lose their content
    in the second batch, which also brings the unread ones."""
    path = shared_folder(m.spark)
    TI.build(m.texts.where("item_rating <> 0"), path)
    changed = m.texts.select("item_uid", "item_title", "item_content", "item_rating", (F.col("item_rating") == -1).alias("deleted"))
    TI.update(changed.where("item_rating IN (-2, -1)"), path, 1)
    blank = F.when(F.col("item_rating") == -2, F.lit("")).otherwise(F.col("item_content"))
    TI.update(changed.where("item_rating IN (-2, 0)").withColumn("item_content", blank), path, 2)
    TI.compact(m.spark, path, first=False)
    TI.drop_replaced(m.spark, path)
    return TI.token_rows(m.spark, path)


def _named(found):
    return found.select(
        (F.col("search") / 2).cast("int").alias("query"),
        F.when(F.col("search") % 2 == 0, "title").otherwise("both").alias("scope"), "item_uid",
    )


def _search_sql() -> str:
    """The boolean of each query written out by hand over spaced token text."""
    def c(text):
        return f"contains(t, ' {text} ')"

    tests = (
        c("tion"), f"{c('the')} AND {c('of')}", c("of the"), f"{c('fur')} AND {c('auf')}",
        f"({c('oned')} OR {c('thing')}) AND {c('ering')}", f"{c('oned')} AND NOT ({c('thing')} AND {c('the')})",
        f"{c('elle')} OR ({c('ou')} AND {c('on')})", f"{c('is on')} OR ({c('thes the')} AND NOT {c('para')})",
    )
    parts = []
    for i, test in enumerate(tests):
        parts.append(f"SELECT {i} AS query, 'title' AS scope, item_uid FROM toks WHERE {test.replace('(t,', '(tt,')}")
        # A phrase lies in one column, so "both" tests either text per phrase.
        both = re.sub(r"contains\(t, ('[^']*')\)", r"(contains(tt, \1) OR contains(ct, \1))", test)
        parts.append(f"SELECT {i}, 'both', item_uid FROM toks WHERE {both}")
    return "\nUNION ALL ".join(parts)


def _view_sql(where: str, order: str, n: int) -> str:
    return f"""SELECT item_uid, item_creator, item_title, item_link, item_content,
      {ts_text('item_loaded')} AS item_loaded_text, strftime(item_created, '%Y-%m-%d') AS item_created_day,
      {ts_text('item_rated')} AS item_rated_text, {age_sql('item_created')} AS delta_created, item_rating,
      item_rule_uid, item_rule_side, item_feed_uid, feed_title, feed_html, feed_xml, snr,
      {ts_text('updated')} AS updated, feed_exempt, tags, {since_sql(age_sql('item_created'))} AS since_when,
      replace(tags, ',', ' ') || CASE WHEN item_creator <> 'Unknown' THEN ' ' || replace(item_creator, '"', '''') ELSE '' END
        AS tag_info
    FROM items JOIN feeds_snr ON item_feed_uid = feed_uid
    JOIN (SELECT tag_item_uid, array_to_string(list_sort(list(DISTINCT tag_name)), ',') AS tags FROM tags GROUP BY 1)
      ON tag_item_uid = item_uid
    WHERE {where} ORDER BY {order} item_uid DESC LIMIT {n}"""


def _flat_view(df):
    return df.withColumns({"tags": F.array_join("tags", ","), "updated": S.datetime_text(F.col("updated"))})


def _client(m):
    """A client copy: articles changed up to 60 days ago, as they were."""
    old = m.items.where(F.col("updated") <= S.days_before(AS_OF, 60))
    return old.select("item_uid", "item_rating", "item_title", "updated")


UPDATED_TOKENS_SQL = with_model(f"""SELECT DISTINCT item_uid, field, token FROM (
  SELECT item_uid, 'title' AS field, unnest({tokens_sql('item_title')}) AS token FROM items WHERE item_rating <> -1
  UNION ALL SELECT item_uid, 'content', unnest({tokens_sql('item_content')}) FROM items
  WHERE item_rating NOT IN (-1, -2))""", "items")
SEARCH_SQL = with_model(
    _search_sql(), "items",
    extra=f"toks AS (SELECT item_uid, {token_text_sql('item_title')} AS tt, {token_text_sql('item_content')} AS ct FROM items)")
SHARE_SQL = """SELECT item_uid, item_guid, item_creator, item_title, item_link, item_content, feed_title,
  strftime(item_created, '%Y-%m-%dT%H:%M:%SZ') AS created, feed_title || ': ' || item_title AS entry_title,
  CASE WHEN item_creator = 'Unknown' THEN feed_title ELSE item_creator END AS entry_author
FROM items, feeds WHERE item_feed_uid = feed_uid AND item_rating = 1 AND NOT feed_private
ORDER BY item_rated DESC NULLS LAST, item_uid DESC LIMIT 50"""

SYNC_SCHEMA = (
    "uid long, since_when string, creator string, loaded string, feed_uid long, title string, feed_html string, content string, "
    "tag_info string, redirect string, feed_title string, feed_snr double, updated_ts long, rating int, feed_exempt boolean"
)


def _marked_up(items):
    """Articles whose content is inside two elements after a break; what looks like a tag in it is none."""
    content = F.concat(F.lit('<p class="a">Intro<br><b>'), F.replace("item_content", F.lit("<"), F.lit("(")), F.lit("</b></p>"))
    return items.withColumn("item_content", content)


NUMERIC_SQL = """array_to_string([CASE WHEN c >= chr(128) AND c <= chr(255) THEN '&#' || ord(c) || ';' ELSE c END
  FOR c IN string_split({0}, '')], '')"""
XML_SQL = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
  '''', '&apos;')"""

QUERIES = {
    "filter_rating": (_ratings, with_model("\nUNION ALL ".join(
        f"SELECT '{show}' AS show, item_uid FROM items WHERE {test}" for show, test in SHOWS.items()), "items")),
    "filter_uid": (
        lambda m: V.filter_uid(m.items, 100, 100000).select("item_uid"),
        with_model("SELECT item_uid FROM items WHERE item_uid BETWEEN 100 AND 100000", "items")),
    "filter_feed": (
        lambda m: V.filter_feed(m.items, 5).select("item_uid", "item_title"),
        with_model("SELECT item_uid, item_title FROM items WHERE item_feed_uid = 5", "items")),
    "filter_rule": (
        lambda m: V.select_items(m.items, show="filtered", rule_uid=12).select("item_uid", "item_rule_uid"),
        with_model("SELECT item_uid, item_rule_uid FROM items WHERE item_rating = -2 AND item_rule_uid = 12", "items")),
    "filter_rule_ignored": (
        lambda m: V.select_items(m.items, show="up", rule_uid=12).select("item_uid"),
        with_model("SELECT item_uid FROM items WHERE item_rating > 0", "items")),
    "changed_since": (
        lambda m: V.select_items(m.items, updated="2023-12-01 00:00:00", feed_uid=2).select("item_uid", "item_rating"),
        with_model("""SELECT item_uid, item_rating FROM items
        WHERE updated > TIMESTAMP '2023-12-01 00:00:00' AND item_feed_uid = 2""", "items")),
    "where_expr": (
        lambda m: V.where_expr(V.search_like(m.items, "TION"), "length(item_title) > 20 AND item_rating <> -2").select("item_uid"),
        with_model("""SELECT item_uid FROM items
        WHERE contains(lower(item_title), 'tion') AND length(item_title) > 20 AND item_rating <> -2""", "items")),
    "search_like": (
        lambda m: V.search_like(m.items, "Für", "content").select("item_uid").unionByName(
            V.search_like(m.items, "ON ", "title").select("item_uid")),
        with_model("""SELECT item_uid FROM items WHERE contains(lower(item_content), 'für')
        UNION ALL SELECT item_uid FROM items WHERE contains(lower(item_title), 'on ')""", "items")),
    "search_tokens": (_searches, SEARCH_SQL),
    "search_index": (_index_searches, SEARCH_SQL),
    "token_table": (
        lambda m: Q.token_table(m.texts),
        with_model(f"""SELECT DISTINCT item_uid, field, token FROM (
          SELECT item_uid, 'title' AS field, unnest({tokens_sql('item_title')}) AS token FROM items
          UNION ALL SELECT item_uid, 'content', unnest({tokens_sql('item_content')}) FROM items)""", "items")),
    "update_tokens": (
        # Changes: filtered articles lose their content, uninteresting ones go, the batch's new ones come.
        lambda m: Q.update_tokens(
            Q.token_table(m.texts.where("item_rating <> 0")),
            m.texts.where("item_rating IN (-2, -1, 0)").select(
                "item_uid", "item_title",
                F.when(F.col("item_rating") == -2, F.lit("")).otherwise(F.col("item_content")).alias("item_content"),
                (F.col("item_rating") == -1).alias("deleted"))),
        UPDATED_TOKENS_SQL),
    "update_index": (_updated_index, UPDATED_TOKENS_SQL),
    "article_view": (
        lambda m: _flat_view(V.article_view(V.filter_rating(m.items), m.feeds, m.stats, m.tags, AS_OF)),
        with_model(_view_sql("item_rating = 0", "", 200), "stats", "tags")),
    "article_view_by_snr": (
        lambda m: _flat_view(V.article_view(
            V.filter_rating(m.items, "all"), m.feeds, m.stats, m.tags, AS_OF, sort="snr", n=120)),
        with_model(_view_sql("item_rating IS NOT NULL", "snr DESC,", 120), "stats", "tags")),
    "items_with_feeds": (
        lambda m: V.items_with_feeds(m.items, m.feeds).select("item_uid", "feed_title", "feed_private"),
        with_model("SELECT item_uid, feed_title, feed_private FROM items JOIN feeds ON item_feed_uid = feed_uid", "items", "feeds")),
    "with_stats": (
        lambda m: V.with_stats(m.feeds, m.stats).select("feed_uid", "feed_title", "snr"),
        with_model("SELECT feed_uid, feed_title, snr FROM feeds_snr", "stats")),
    "with_tags": (
        lambda m: V.with_tags(m.items.select("item_uid"), m.tags.where("tag_name <> 'src1'")).select(
            "item_uid", F.array_join("tags", ",").alias("tags")),
        with_model("""SELECT item_uid, coalesce(tags, '') AS tags FROM items LEFT JOIN (
          SELECT tag_item_uid, array_to_string(list_sort(list(DISTINCT tag_name)), ',') AS tags FROM tags
          WHERE tag_name <> 'src1' GROUP BY 1) ON tag_item_uid = item_uid""", "items", "tags")),
    "semi_join": (
        lambda m: V.semi(m.items, m.tags.where("tag_name = 'fr'").select(F.col("tag_item_uid").alias("item_uid")), "item_uid")
        .select("item_uid"),
        with_model("SELECT item_uid FROM items WHERE item_uid IN (SELECT tag_item_uid FROM tags WHERE tag_name = 'fr')",
                   "items", "tags")),
    "sort_orders": (_orders, with_model("\nUNION ALL ".join(
        f"SELECT * FROM (SELECT '{key}' AS sort, item_uid FROM items JOIN feeds_snr ON item_feed_uid = feed_uid "
        f"ORDER BY {order} item_uid DESC LIMIT 50)" for key, order in SORTS.items()), "stats")),
    "second_page": (
        lambda m: V.page(V.sort_view(V.filter_rating(m.items, "up"), "created"), 40, 60).select("item_uid"),
        with_model("""SELECT item_uid FROM items WHERE item_rating > 0
        ORDER BY item_created DESC NULLS LAST, item_uid DESC LIMIT 60 OFFSET 40""", "items")),
    "get_item": (
        lambda m: V.get_item(m.items, 42),
        with_model("SELECT item_title, item_content, item_link FROM items WHERE item_uid = 42", "items")),
    "share": (lambda m: X.share(m.items, m.feeds).drop("entry_content"), with_model(SHARE_SQL, "items", "feeds")),
    "share_xml": (
        lambda m: X.share_xml(X.share(_marked_up(m.items), m.feeds)),
        with_model(f"""SELECT item_uid, '<entry><id>' || {XML_SQL.format('item_guid')} || '</id><title>' || {NUMERIC_SQL.format(XML_SQL.format('entry_title'))}
          || '</title><updated>' || created || '</updated><author><name>' || {NUMERIC_SQL.format(XML_SQL.format('entry_author'))} || '</name></author>'
          || '<content type="html">' || {NUMERIC_SQL.format(XML_SQL.format('content'))} || '</content><link rel="alternate" href="'
          || {XML_SQL.format('item_link')} || '" /></entry>' AS entry
        FROM (SELECT *, '<p class="a">Intro<br><b>' || CASE WHEN len(regexp_extract_all(t, '\\S+')) > 49
            THEN regexp_extract(t, '^(?:\\s*\\S+){{49}}') || '...' ELSE t END || '</b></p>' AS content
          FROM (SELECT *, replace(item_content, '<', '(') AS t FROM ({SHARE_SQL})))""", "items", "feeds")),
    "sync_json": (
        lambda m: X.sync_json(V.article_view(
            V.select_items(m.items, updated="2024-01-01 00:00:00"), m.feeds, m.stats, m.tags, AS_OF)).select(
            F.from_json("json", SYNC_SCHEMA).alias("j")).select("j.*"),
        with_model(f"""SELECT item_uid AS uid, since_when, item_creator AS creator, item_loaded_text AS loaded, item_feed_uid AS feed_uid,
          item_title AS title, feed_html, item_content AS content, tag_info, item_link AS redirect, feed_title, snr AS feed_snr,
          epoch_us(CAST(updated AS TIMESTAMP)) AS updated_ts, item_rating AS rating, feed_exempt
        FROM ({_view_sql("updated > TIMESTAMP '2024-01-01 00:00:00'", "", 200)})""", "stats", "tags")),
    "client_sync": (
        lambda m: I.sync(_client(m).withColumn("item_rating", F.lit(0)), m.items).select("item_uid", "item_rating"),
        with_model(f"""SELECT item_uid, CASE WHEN updated <= {ago('60')} THEN 0 ELSE item_rating END AS item_rating
        FROM items""", "items")),
    "article_times": (
        # Date functions over every article, the age text among them.
        lambda m: m.items.select(
            "item_uid", S.day(F.col("item_created")).alias("day"), S.iso(F.col("item_created")).alias("iso"),
            S.epoch(F.col("item_created")).alias("epoch"),
            S.age_days(F.col("item_created"), AS_OF).alias("age"),
            S.since(S.age_days(F.col("item_created"), AS_OF) / 50, AS_OF).alias("since_when"),
            F.coalesce(S.datetime_text(F.col("item_modified")), F.lit("-")).alias("modified")),
        with_model(f"""SELECT item_uid, strftime(item_created, '%Y-%m-%d') AS day,
          strftime(item_created, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(item_created) AS BIGINT) AS epoch,
          {age_sql('item_created')} AS age,
          {since_sql(f"({age_sql('item_created')} / 50)")} AS since_when,
          coalesce({ts_text('item_modified')}, '-') AS modified FROM items""", "items")),
    "display_fields": (
        lambda m: V.with_tags(m.items, m.tags).select(
            "item_uid", S.display_author(F.col("item_creator")).alias("author"),
            S.tag_label(F.col("tags"), F.col("item_creator")).alias("label"), F.lower("item_title").alias("title_lc"),
            H.md5_hex(F.col("item_content")).alias("md5"), S.fix_scheme(F.replace("item_link", F.lit("http:"), F.lit("feed:"))).alias("link"),
            S.clean_desc(F.col("item_title")).alias("desc")),
        with_model("""SELECT item_uid, replace(item_creator, '"', '''') AS author,
          lang || ' ' || source || CASE WHEN lang <> 'en' THEN ' ' || replace(item_creator, '"', '''') ELSE '' END AS label,
          lower(item_title) AS title_lc, md5(item_content) AS md5, item_link AS link,
          trim(replace(replace(replace(regexp_replace(item_title, '<[^>]*>', '', 'g'), '"', '&quot;'), '& ', '&amp; '), '©', '&copy;')) AS desc
        FROM items""", "items")),
    "word_sets": (
        lambda m: m.texts.select("item_uid", F.array_join(F.array_sort(T.words(F.col("item_title"))), " ").alias("title_words"),
                                 F.size(T.words(F.col("item_content"))).cast("long").alias("content_words")),
        with_model(f"""SELECT item_uid, array_to_string(list_sort({words_sql('item_title')}), ' ') AS title_words,
          len({words_sql('item_content')}) AS content_words FROM items""", "items")),
    "stems": (
        lambda m: with_stem(m.texts.select(F.explode(T.words(F.col("item_content"))).alias("word")).distinct()),
        with_model("SELECT word, stem FROM stems", "items", extra=f"""
          vocab AS (SELECT DISTINCT unnest({words_sql('item_content')}) AS word FROM items),{stem_ctes('vocab', 'stems')}""")),
    "stem_titles": (
        lambda m: stem_phrases(m.texts, "item_uid", "item_title"),
        with_model("""SELECT item_uid, coalesce(string_agg(stem, ' ' ORDER BY stem), '') AS stems FROM (
          SELECT DISTINCT t.item_uid, s.stem FROM title_words t JOIN stems s USING (word)) GROUP BY 1""", "items", extra=f"""
          title_words AS (SELECT item_uid, unnest({words_sql('item_title')}) AS word FROM items),
          vocab AS (SELECT DISTINCT word FROM title_words),{stem_ctes('vocab', 'stems')}""")),
}
