"""Feed statistics, rule activity and daily reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators import stats as A
from feedloom.operators import view as V
from feedloom.operators.ordered import number_rows
from feedloom.plans.model import AS_OF, NOW, ago, ts_text, with_model
from feedloom.sources import exports as X
from feedloom.sources import opml as O

COUNT_COLUMNS = "interesting, unread, uninteresting, filtered, total"


def _flat(df, *names):
    """Timestamps as text, so both engines print them alike."""
    out = df
    for name in names:
        out = out.withColumn(name, S.datetime_text(F.col(name)))
    return out


def since_sql(age: str) -> str:
    return f"""CASE WHEN {age} IS NULL OR {age} = 0 THEN 'never'
      WHEN {age} < CAST(2 AS DOUBLE) / 24 THEN CAST(trunc({age} * 24.0 * 60.0) AS INTEGER) || ' minutes ago'
      WHEN {age} < 1 THEN CAST(trunc({age} * 24.0) AS INTEGER) || ' hours ago'
      WHEN {age} < 2 THEN 'one day ago' WHEN {age} < 3 THEN CAST(trunc({age}) AS INTEGER) || ' days ago'
      ELSE strftime({NOW} - to_microseconds(CAST(round({age} * 86400000000) AS BIGINT)), '%Y-%m-%d') END"""


FEED_ORDERS = tuple((key, direction) for key in V.FEED_SORTS for direction in ("ASC", "DESC"))


def _feed_orders(m):
    """Place of every feed under each order of the feed list, both ways."""
    ranked = []
    for key, direction in FEED_ORDERS:
        places = number_rows(m.feeds_snr, *V.feed_sort_keys(key, direction))
        ranked.append(places.select(
            F.lit(f"{key} {direction}").alias("sort"), "feed_uid", F.col("row_number").alias("place")))
    return reduce(DataFrame.unionByName, ranked)


def _by_many_rules(m):
    """A rule for every fifth article, some of them a feed's own, and articles of the last 16 days filtered by them."""
    u = F.col("item_uid")
    rules = m.items.where(u % 5 == 0).select(
        u.alias("rule_uid"), F.lit("title_phrase").alias("rule_type"), F.when(u % 3 == 0, F.col("item_feed_uid")).alias("rule_feed_uid"),
        F.lit(None).cast("timestamp").alias("rule_expires"), F.col("item_title").alias("rule_text"))
    items = m.items.withColumns({
        "item_rating": F.lit(-2), "item_rule_uid": u - u % 15 + F.when(u % 4 == 0, 5).otherwise(10),
        "item_created": F.timestamp_micros(F.unix_micros(S.as_of_column(AS_OF)) - (u % 16) * F.lit(86_400_000_000) - 3_600_000_000),
    })
    return rules, items


MANY_RULES_SQL = f"""own_rules AS (
  SELECT item_uid AS rule_uid, 'title_phrase' AS rule_type, CASE WHEN item_uid % 3 = 0 THEN item_feed_uid END AS rule_feed_uid,
    item_title AS rule_text FROM items WHERE item_uid % 5 = 0),
judged AS (
  SELECT item_uid, item_feed_uid, -2 AS item_rating, item_uid - item_uid % 15 + CASE WHEN item_uid % 4 = 0 THEN 5 ELSE 10 END AS item_rule_uid,
    {ago('item_uid % 16')} - INTERVAL 1 HOUR AS item_created FROM items)"""

QUERIES = {
    "feed_list": (
        lambda m: V.feed_page(m.feeds_snr, AS_OF),
        with_model(f"""SELECT feed_uid, feed_title, feed_html, feed_xml, last_modified, {COUNT_COLUMNS}, snr,
          feed_status, feed_private, feed_exempt, feed_errors, feed_filter IS NOT NULL AS has_filter,
          {since_sql('last_modified')} AS since_when, CAST(trunc(100 * snr) AS INTEGER) AS snr_percent,
          CASE WHEN feed_errors > 10 THEN 'error' WHEN feed_errors > 0 THEN 'small-error' ELSE '' END AS error_level,
          concat_ws(', ', CASE WHEN feed_status = 1 THEN 'suspended' END, CASE WHEN feed_private THEN 'private' END,
            CASE WHEN feed_exempt THEN 'exempt' END, CASE WHEN feed_filter IS NOT NULL THEN 'filtered' END) AS flags
        FROM feeds_snr""", "stats"),
    ),
    "feed_list_orders": (
        _feed_orders,
        with_model("\nUNION ALL ".join(
            f"SELECT '{key} {d}' AS sort, feed_uid, row_number() OVER (ORDER BY feed_status, {head}{expr} {d} "
            f"NULLS {'LAST' if d == 'DESC' else 'FIRST'}, lower(feed_title), feed_uid) AS place FROM feeds_snr"
            for key, d in FEED_ORDERS
            for head, expr in [("(unread > 0) DESC, ", "snr") if key == "default" else ("", "lower(feed_title)" if key == "feed_title" else key)]),
            "stats"),
    ),
    "rating_counts": (
        lambda m: A.rating_counts(m.items),
        with_model(f"SELECT feed_uid, {COUNT_COLUMNS} FROM stats", "stats"),
    ),
    "latest_change": (
        lambda m: _flat(A.latest_change(m.items), "last_modified"),
        with_model(f"SELECT feed_uid, {ts_text('last_modified')} AS last_modified FROM stats", "stats"),
    ),
    "decayed_snr": (
        lambda m: A.snr(m.items, AS_OF),
        with_model("SELECT feed_uid, snr FROM stats", "stats"),
    ),
    "feed_stats": (
        lambda m: _flat(A.feed_stats(m.items, AS_OF), "last_modified"),
        with_model(f"SELECT feed_uid, {COUNT_COLUMNS}, {ts_text('last_modified')} AS last_modified, snr FROM stats", "stats"),
    ),
    "feeds_with_items": (
        lambda m: _flat(A.feeds_with_items(m.feeds, m.items, AS_OF), "last_modified"),
        with_model(f"SELECT feed_uid, {COUNT_COLUMNS}, {ts_text('latest')} AS last_modified, snr FROM feeds_stats", "stats"),
    ),
    "feeds_snr": (
        lambda m: m.feeds_snr.select("feed_uid", "feed_title", "last_modified", *COUNT_COLUMNS.split(", "), "snr"),
        with_model(f"SELECT feed_uid, feed_title, last_modified, {COUNT_COLUMNS}, snr FROM feeds_snr", "stats"),
    ),
    "load_stats": (
        lambda m: A.load_stats(m.items, AS_OF),
        with_model(f"""SELECT strftime(item_loaded, '%Y-%m-%d') AS date, count(*) AS articles,
          count(*) FILTER (item_rating = 1) AS interesting, count(*) FILTER (item_rating = 0) AS unread,
          count(*) FILTER (item_rating = -1) AS filtered
        FROM items WHERE item_loaded > {ago('30')} GROUP BY 1""", "items"),
    ),
    "daily_stats": (
        lambda m: A.daily_stats(m.items, m.feeds),
        with_model("""SELECT strftime(item_created, '%Y-%m-%d') AS day, count(*) FILTER (item_rating > 0) AS interesting,
          count(*) FILTER (item_rating = -2) AS filtered, count(*) FILTER (item_rating = -1) AS uninteresting
        FROM feeds, items WHERE item_feed_uid = feed_uid GROUP BY 1""", "feeds", "items"),
    ),
    "top_feeds": (
        lambda m: A.top_feeds(m.items, m.feeds),
        with_model("""SELECT feed_title, i * 100 // nullif(i + u, 0) AS interest_ratio FROM (
          SELECT feed_title, count(*) FILTER (item_rating = 1) AS i, count(*) FILTER (item_rating = -1) AS u
          FROM feeds, items WHERE item_feed_uid = feed_uid GROUP BY 1)
        ORDER BY interest_ratio DESC NULLS LAST, feed_title LIMIT 20""", "feeds", "items"),
    ),
    "hit_ratio": (
        lambda m: A.hit_ratio(m.feeds_snr),
        with_model("""SELECT feed_uid, coalesce(interesting * 100 // nullif(interesting + uninteresting, 0), 0) AS ratio
        FROM feeds_snr""", "stats"),
    ),
    "feed_totals": (
        lambda m: A.feed_totals(m.feeds_snr),
        with_model("""SELECT CAST(sum(unread) AS BIGINT) AS unread, CAST(sum(filtered) AS BIGINT) AS filtered,
          CAST(sum(interesting) AS BIGINT) AS interesting, CAST(sum(total) AS BIGINT) AS total FROM feeds_snr""", "stats"),
    ),
    "rule_hits": (
        lambda m: A.rule_hits(m.rules, m.items, m.feeds).groupBy("rule_uid", "rule_type", "rule_feed_title").agg(
            F.count(F.lit(1)).alias("hits"), F.min("item_uid").alias("first_item")),
        with_model("""SELECT rule_uid, rule_type, feed_title AS rule_feed_title, count(*) AS hits,
          min(item_uid) AS first_item
        FROM rules JOIN items ON item_rule_uid = rule_uid LEFT JOIN feeds ON rule_feed_uid = feed_uid
        GROUP BY 1, 2, 3""", "rules", "items", "feeds"),
    ),
    "top_rules": (
        lambda m: A.top_rules(_by_many_rules(m)[1], _by_many_rules(m)[0], 1),
        with_model("""SELECT item_rule_uid, rule_type, rule_text, count(*) AS hits FROM judged
        JOIN own_rules ON rule_uid = item_rule_uid WHERE item_feed_uid = 1 AND item_rating = -2
        GROUP BY 1, 2, 3 ORDER BY hits DESC, rule_text, item_rule_uid LIMIT 25""", "items", extra=MANY_RULES_SQL),
    ),
    "rule_stats": (
        lambda m: A.rule_stats(*_by_many_rules(m), m.feeds, AS_OF),
        with_model(f"""SELECT rule_uid, rule_type, rule_text, coalesce(rule_feed_uid, -1) AS rule_feed_uid, feed_title,
          count(*) FILTER (item_created > {ago('7')}) AS last_7, count(*) FILTER (item_created < {ago('7')}) AS prev_7,
          min(CASE WHEN item_created > {ago('7')} THEN item_uid ELSE 2000000000 END) AS first_item,
          max(CASE WHEN item_created > {ago('7')} THEN item_uid ELSE 0 END) AS last_item
        FROM own_rules JOIN judged ON item_rule_uid = rule_uid LEFT JOIN feeds ON rule_feed_uid = feed_uid
        WHERE item_created > {ago('14')} GROUP BY 1, 2, 3, 4, 5 ORDER BY last_7 DESC, rule_uid LIMIT 100""",
                   "items", "feeds", extra=MANY_RULES_SQL),
    ),
    "tag_lists": (
        lambda m: A.tag_lists(m.tags).select("item_uid", F.array_join("tags", ",").alias("tags")),
        with_model("""SELECT tag_item_uid AS item_uid, array_to_string(list_sort(list(DISTINCT tag_name)), ',') AS tags
        FROM tags GROUP BY 1""", "tags"),
    ),
    "tags_json": (
        lambda m: A.tag_lists(m.tags).select("item_uid", S.tags_json(F.col("tags")).alias("tags")),
        with_model("""SELECT tag_item_uid AS item_uid,
          '["' || array_to_string(list_sort(list(DISTINCT tag_name)), '","') || '"]' AS tags FROM tags GROUP BY 1""", "tags"),
    ),
    "link_set": (
        lambda m: A.link_set(m.items),
        with_model("SELECT DISTINCT item_link FROM items", "items"),
    ),
    "opml_export": (
        lambda m: O.opml_export(m.feeds_snr),
        with_model("""SELECT 'rss' AS _type, feed_title AS _title, feed_desc AS _description,
          coalesce(feed_pubxml, feed_xml) AS "_xmlUrl", feed_html AS "_htmlUrl", snr AS _snr
        FROM feeds_snr WHERE feed_status = 0 AND NOT feed_private""", "stats"),
    ),
    "public_feeds": (
        lambda m: V.public_feeds(m.feeds_snr),
        with_model("""SELECT feed_uid, feed_title, feed_desc, feed_html, coalesce(feed_pubxml, feed_xml) AS feed_xml, snr
        FROM feeds_snr WHERE feed_status = 0 AND NOT feed_private""", "stats"),
    ),
    "blogroll": (
        lambda m: X.blogroll(m.feeds_snr),
        with_model("""SELECT feed_uid AS uid, feed_title AS title, feed_desc AS description, feed_html AS html,
          coalesce(feed_pubxml, feed_xml) AS xml, snr
        FROM feeds_snr WHERE feed_status = 0 AND NOT feed_private""", "stats"),
    ),
    "blogroll_json": (
        # Read back, as the engines write numbers differently; the text is compared up to the number.
        lambda m: X.blogroll_json(m.feeds_snr).select(
            F.concat(F.regexp_extract("json", r'^(.*),"snr":[^,}]*}$', 1), F.lit("}")).alias("json"),
            F.get_json_object("json", "$.snr").cast("double").alias("snr")),
        with_model("""SELECT '{"uid":' || feed_uid || ',"title":"' || feed_title || '","description":"' || feed_desc
          || '","html":"' || feed_html || '","xml":"' || coalesce(feed_pubxml, feed_xml) || '"}' AS json, snr
        FROM feeds_snr WHERE feed_status = 0 AND NOT feed_private""", "stats"),
    ),
    "stats_csv": (
        lambda m: X.stats_csv(m.items, AS_OF),
        with_model(f"""SELECT strftime(item_loaded, '%Y-%m-%d') AS "Date", count(*) AS "Articles",
          count(*) FILTER (item_rating = 1) AS "Interesting", count(*) FILTER (item_rating = 0) AS "Unread",
          count(*) FILTER (item_rating = -1) AS "Filtered"
        FROM items WHERE item_loaded > {ago('30')} GROUP BY 1""", "items"),
    ),
    "feed_info": (
        lambda m: reduce(DataFrame.unionAll, [V.feed_info(m.feeds_snr, uid) for uid in (4, 8, 13)]),
        with_model(f"""SELECT feed_title, feed_desc, feed_filter, feed_html, feed_xml, feed_pubxml, last_modified, {COUNT_COLUMNS},
          feed_status, feed_private, feed_exempt, feed_dupcheck, feed_errors FROM feeds_snr WHERE feed_uid IN (4, 8, 13)""", "stats"),
    ),
    "worklist": (
        lambda m: V.worklist(m.feeds).select("feed_uid", "feed_xml", "feed_etag", "feed_dupcheck", "feed_modified_epoch"),
        with_model("""SELECT feed_uid, feed_xml, feed_etag, feed_dupcheck,
          CAST(epoch(feed_modified) AS BIGINT) AS feed_modified_epoch FROM feeds WHERE feed_status = 0""", "feeds"),
    ),
    "worklist_errors": (
        lambda m: V.worklist(m.feeds, only_errors=True).select("feed_uid", "feed_xml"),
        with_model("SELECT feed_uid, feed_xml FROM feeds WHERE feed_status = 0 AND feed_errors > 0", "feeds"),
    ),
    "rule_list": (
        lambda m: V.rule_list(m.rules),
        with_model("""SELECT CASE WHEN rule_type = 'python' THEN 'Python'
            WHEN regexp_full_match(upper(substr(rule_text, 1, 1)), '[A-Z]') THEN upper(substr(rule_text, 1, 1))
            ELSE '0' END AS tab, rule_uid, rule_type, strftime(rule_expires, '%Y-%m-%d') AS rule_expires, rule_text
        FROM rules WHERE rule_feed_uid IS NULL""", "rules"),
    ),
    "rule_list_feed": (
        lambda m: V.rule_list(m.rules.join(m.feeds, m.rules.rule_feed_uid == m.feeds.feed_uid, "left_semi"), 4),
        with_model("""SELECT CASE WHEN rule_type = 'python' THEN 'Python'
            WHEN regexp_full_match(upper(substr(rule_text, 1, 1)), '[A-Z]') THEN upper(substr(rule_text, 1, 1))
            ELSE '0' END AS tab, rule_uid, rule_type, strftime(rule_expires, '%Y-%m-%d') AS rule_expires, rule_text
        FROM rules WHERE rule_feed_uid = 4 AND rule_feed_uid IN (SELECT feed_uid FROM feeds)""", "rules", "feeds"),
    ),
}
