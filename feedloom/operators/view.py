"""The article view and the feed list: predicates, joins, orders and pages.

No join carries a broadcast hint: Catalyst and AQE broadcast a side when its
size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffle,
splitting a hot feed's partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.scalars import (
    age_days, datetime_text, day, error_level, feed_flags, since, snr_percent, tag_label,
)
from feedloom.operators.stats import tag_lists
from feedloom.schema import PAGE_LIMIT

RATING_FILTERS = {
    "all": lambda: F.col("item_rating").isNotNull(),
    "unread": lambda: F.col("item_rating") == 0,
    "down": lambda: F.col("item_rating") == -1,
    "up": lambda: F.col("item_rating") > 0,
    "filtered": lambda: F.col("item_rating") == -2,
}


def rating_predicate(show: str = "unread") -> Column:
    return RATING_FILTERS.get(show, RATING_FILTERS["unread"])()


def filter_rating(df: DataFrame, show: str = "unread") -> DataFrame:
    return df.where(rating_predicate(show))


def filter_uid(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    if lo is not None:
        df = df.where(F.col("item_uid") >= lo)
    if hi is not None:
        df = df.where(F.col("item_uid") <= hi)
    return df


def filter_feed(df: DataFrame, feed_uid: int) -> DataFrame:
    return df.where(F.col("item_feed_uid") == feed_uid)


def filter_rule(df: DataFrame, rule_uid: int, show: str = "filtered") -> DataFrame:
    """Only honoured when filtered articles are shown."""
    return df.where(F.col("item_rule_uid") == rule_uid) if show == "filtered" else df


def changed_since(df: DataFrame, ts) -> DataFrame:
    moment = ts if isinstance(ts, Column) else F.lit(str(ts)).cast("timestamp")
    return df.where(F.col("updated") > moment)


def where_expr(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.expr(text))


def search_like(df: DataFrame, term: str, search_in: str = "title") -> DataFrame:
    column = "item_title" if search_in == "title" else "item_content"
    return df.where(F.contains(F.lower(F.col(column)), F.lit(term.lower())))


def select_items(
    items: DataFrame,
    show: str = "unread",
    updated=None,
    rule_uid: int | None = None,
    lo: int | None = None,
    hi: int | None = None,
    feed_uid: int | None = None,
) -> DataFrame:
    """All view predicates together; ``updated`` replaces the rating predicate."""
    show = show if show in RATING_FILTERS else "unread"
    out = changed_since(items, updated) if updated is not None else filter_rating(items, show)
    if rule_uid is not None:
        out = filter_rule(out, rule_uid, show)
    out = filter_uid(out, lo, hi)
    return filter_feed(out, feed_uid) if feed_uid is not None else out


def items_with_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    return items.join(feeds, items.item_feed_uid == feeds.feed_uid)


def with_stats(df: DataFrame, stats: DataFrame, columns: tuple[str, ...] = ("snr",)) -> DataFrame:
    """Left join of per-feed statistics; a feed without statistics has SNR 0."""
    joined = df.join(stats.select("feed_uid", *columns), "feed_uid", "left")
    return joined.withColumn("snr", F.coalesce("snr", F.lit(0.0))) if "snr" in columns else joined


def with_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds the tag list; an item without tags has an empty list.

    Tags are reduced to one row per item before the join, and only for items
    in ``df`` when the caller has already cut it to a page.
    """
    joined = df.join(tag_lists(tags), "item_uid", "left")
    return joined.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def sort_keys(key: str = "seen", seed: str = "") -> list[Column]:
    """Six orders; the tie-break is always the newest item first."""
    orders = {
        "created": [F.col("item_created").desc_nulls_last()],
        "seen": [],
        "rated": [F.col("item_rated").desc_nulls_last()],
        "snr": [F.col("snr").desc_nulls_last()],
        "oldest": [F.col("item_uid").asc()],
        "random": [F.md5(F.concat(F.lit(seed), F.col("item_uid").cast("string")))],
    }
    return [*orders.get(key, []), F.col("item_uid").desc()]


def sort_view(df: DataFrame, key: str = "seen", seed: str = "") -> DataFrame:
    return df.orderBy(*sort_keys(key, seed))


def page(df: DataFrame, offset: int = 0, n: int = PAGE_LIMIT) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def article_view(
    items: DataFrame,
    feeds: DataFrame,
    stats: DataFrame,
    tags: DataFrame,
    as_of,
    sort: str = "seen",
    seed: str = "",
    n: int = PAGE_LIMIT,
    offset: int = 0,
) -> DataFrame:
    """One page of articles with feed, SNR, age and tags.

    The page is cut on narrow rows (keys and sort columns) before the text is
    fetched, so only a page of article bodies is ever joined or sorted.
    """
    keyed = items.select("item_uid", "item_feed_uid", "item_created", "item_rated").join(
        feeds.select(F.col("feed_uid").alias("item_feed_uid")), "item_feed_uid", "left_semi"
    )
    if sort == "snr":
        snr = stats.select(F.col("feed_uid").alias("item_feed_uid"), "snr")
        keyed = keyed.join(snr, "item_feed_uid", "left").withColumn("snr", F.coalesce("snr", F.lit(0.0)))
    chosen = page(sort_view(keyed, sort, seed), offset, n).select("item_uid")

    rows = items.join(chosen, "item_uid", "left_semi")
    rows = with_stats(items_with_feeds(rows, feeds), stats)
    page_tags = tags.join(chosen.withColumnRenamed("item_uid", "tag_item_uid"), "tag_item_uid", "left_semi")
    rows = with_tags(rows, page_tags)
    age = age_days(F.col("item_created"), as_of)
    return sort_view(
        rows.select(
            "item_uid", "item_creator", "item_title", "item_link", "item_content",
            datetime_text(F.col("item_loaded")).alias("item_loaded_text"),
            day(F.col("item_created")).alias("item_created_day"),
            datetime_text(F.col("item_rated")).alias("item_rated_text"),
            age.alias("delta_created"), "item_rating", "item_rule_uid", "item_rule_side",
            "item_feed_uid", "feed_title", "feed_html", "feed_xml", "snr", "updated", "feed_exempt",
            "tags", since(age, as_of).alias("since_when"),
            tag_label(F.col("tags"), F.col("item_creator")).alias("tag_info"),
            "item_created", "item_rated",
        ),
        sort,
        seed,
    ).drop("item_created", "item_rated")


def get_item(items: DataFrame, uid: int) -> DataFrame:
    return items.where(F.col("item_uid") == uid).select("item_title", "item_content", "item_link")


def feed_info(feeds_snr: DataFrame, uid: int) -> DataFrame:
    return feeds_snr.where(F.col("feed_uid") == uid).select(
        "feed_title", "feed_desc", "feed_filter", "feed_html", "feed_xml", "feed_pubxml", "last_modified",
        "interesting", "unread", "uninteresting", "filtered", "total",
        "feed_status", "feed_private", "feed_exempt", "feed_dupcheck", "feed_errors",
    )


def worklist(feeds: DataFrame, only_errors: bool = False) -> DataFrame:
    active = feeds.where(F.col("feed_status") == 0)
    if only_errors:
        active = active.where(F.col("feed_errors") > 0)
    return active.select(
        "feed_uid", "feed_xml", "feed_etag", "feed_dupcheck",
        F.unix_timestamp("feed_modified").alias("feed_modified_epoch"),
    )


FEED_SORTS = {
    "default": lambda: [(F.col("unread") > 0).desc(), F.col("snr")],
    "feed_title": lambda: [F.lower("feed_title")],
    "lower(feed_title)": lambda: [F.lower("feed_title")],
    "last_modified": lambda: [F.col("last_modified")],
    "unread": lambda: [F.col("unread")],
    "filtered": lambda: [F.col("filtered")],
    "interesting": lambda: [F.col("interesting")],
    "snr": lambda: [F.col("snr")],
    "total": lambda: [F.col("total")],
}


def feed_sort_keys(key: str = "default", order: str = "DESC") -> list[Column]:
    """Active feeds first, then the chosen key; the direction binds to its last part.

    Unknown values come first ascending and last descending.
    """
    if key not in FEED_SORTS or order not in ("ASC", "DESC"):
        raise ValueError(f"unknown feed order {key!r} {order!r}")
    *head, last = FEED_SORTS[key]()
    last = last.desc_nulls_last() if order == "DESC" else last.asc_nulls_first()
    return [F.col("feed_status").asc(), *head, last, F.lower("feed_title").asc(), F.col("feed_uid").asc()]


def feed_list(feeds_snr: DataFrame, key: str = "default", order: str = "DESC") -> DataFrame:
    return feeds_snr.select(
        "feed_uid", "feed_title", "feed_html", "feed_xml", "last_modified",
        "interesting", "unread", "uninteresting", "filtered", "total", "snr",
        "feed_status", "feed_private", "feed_exempt", "feed_errors",
        F.col("feed_filter").isNotNull().alias("has_filter"),
    ).orderBy(*feed_sort_keys(key, order))


def feed_page(feeds_snr: DataFrame, as_of, key: str = "default", order: str = "DESC") -> DataFrame:
    """The feed list with its display columns."""
    listed = feed_list(feeds_snr, key, order)
    return listed.select(
        "*",
        since(F.col("last_modified"), as_of).alias("since_when"),
        snr_percent(F.col("snr")).alias("snr_percent"),
        error_level(F.col("feed_errors")).alias("error_level"),
        feed_flags(
            F.col("feed_status"), F.col("feed_private"), F.col("feed_exempt"),
            F.when(F.col("has_filter"), F.lit("")),
        ).alias("flags"),
    )


def public_feeds(feeds_snr: DataFrame) -> DataFrame:
    """Active public feeds, best first; a public URL stands in for the private one."""
    return (
        feeds_snr.where((F.col("feed_status") == 0) & ~F.col("feed_private"))
        .select(
            "feed_uid", "feed_title", "feed_desc", "feed_html",
            F.coalesce("feed_pubxml", "feed_xml").alias("feed_xml"), "snr",
        )
        .orderBy(F.desc("snr"), F.lower("feed_title"), "feed_uid")
    )


def rule_list(rules: DataFrame, feed_uid: int | None = None) -> DataFrame:
    """Rules of one feed, or the global ones, with the tab each belongs to."""
    scope = F.col("rule_feed_uid").isNull() if feed_uid is None else F.col("rule_feed_uid") == feed_uid
    initial = F.upper(F.substring("rule_text", 1, 1))
    tab = (
        F.when(F.col("rule_type") == "python", F.lit("Python"))
        .when(initial.rlike("^[A-Z]$"), initial)
        .otherwise(F.lit("0"))
    )
    return rules.where(scope).select(
        tab.alias("tab"), "rule_uid", "rule_type", day(F.col("rule_expires")).alias("rule_expires"), "rule_text"
    ).orderBy(F.lower("rule_text"), "rule_uid")
