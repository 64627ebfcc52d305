"""Table maintenance as pure functions: old table in, new table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import md5_hex
from feedloom.functions.rule_helpers import clean_rule
from feedloom.functions.scalars import as_of_column, days_before
from feedloom.operators.ingest import Ingested, ingest
from feedloom.operators.ordered import failure_runs
from feedloom.operators.rules import check_rules, filtered_by_global, refused_texts, rule_fields
from feedloom.operators.sizing import broadcast_if_small
from feedloom.schema import (
    CLEAR_CONTENT_DAYS, EXPIRE_DAYS, MAX_ERRORS, OLDEST_MARGIN_DAYS, RATING_OPS, STATUS_ACTIVE,
    STATUS_SUSPENDED, UNINTERESTING, UNREAD,
)

NOTICE_TITLE = "Service notification"
NOTICE_AUTHOR = "Service notifications"


# ---------------------------------------------------------------- ratings

def last_rating(events: DataFrame) -> DataFrame:
    """Last operation per item; ties in time go to the higher event id."""
    ops = F.create_map(*[F.lit(x) for pair in RATING_OPS.items() for x in pair])
    known = events.where(F.col("op").isin(*RATING_OPS))
    return (
        known.groupBy("item_uid")
        .agg(F.max(F.struct("ts", "event_id", "op")).alias("e"))
        .select("item_uid", ops[F.col("e.op")].alias("rating"), F.col("e.ts").alias("rated"))
    )


def apply_ratings(items: DataFrame, events: DataFrame) -> DataFrame:
    joined = items.join(last_rating(events), "item_uid", "left")
    return joined.withColumns({
        "item_rating": F.coalesce("rating", "item_rating"),
        "item_rated": F.coalesce("rated", "item_rated"),
        "updated": F.greatest("updated", "rated"),
    }).select(*items.columns)


def rating_changes(events: DataFrame) -> DataFrame:
    """The same as changes for a store (:mod:`feedloom.sources.item_store`): no article is read."""
    return last_rating(events).select(
        "item_uid", F.col("rating").alias("item_rating"), F.col("rated").alias("item_rated"), F.col("rated").alias("updated")
    )


def catch_up(items: DataFrame, feed_uid: int) -> DataFrame:
    mine = (F.col("item_feed_uid") == feed_uid) & (F.col("item_rating") == UNREAD)
    return items.withColumn("item_rating", F.when(mine, UNINTERESTING).otherwise(F.col("item_rating")))


# ---------------------------------------------------------------- duplicates

def title_dup_count(items: DataFrame) -> DataFrame:
    """How many items of its feed share each item's title (null titles: none).

    Titles are counted with partial aggregation and joined back, rather than
    gathered in a window, so a title with very many copies stays spread out.
    """
    counts = items.where(F.col("item_title").isNotNull()).groupBy("item_feed_uid", "item_title").agg(
        F.count(F.lit(1)).alias("copies")
    )
    return items.join(counts, ["item_feed_uid", "item_title"], "left").withColumn(
        "copies", F.coalesce("copies", F.lit(0))
    )


def same_title(items: DataFrame) -> DataFrame:
    """Items with another item of the same feed and title."""
    shared = (
        items.where(F.col("item_title").isNotNull()).groupBy("item_feed_uid", "item_title")
        .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    return items.join(shared, ["item_feed_uid", "item_title"], "left_semi")


def dedupe(items: DataFrame, feed_uid: int | None = None) -> DataFrame:
    """Every unread item whose title is shared in its feed becomes uninteresting.

    No copy is kept unread. Without ``feed_uid`` all feeds are treated.
    """
    mine = items if feed_uid is None else items.where(F.col("item_feed_uid") == feed_uid)
    shared = (
        mine.where(F.col("item_title").isNotNull()).groupBy("item_feed_uid", "item_title")
        .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select("item_feed_uid", "item_title", F.lit(True).alias("shared"))
    )
    joined = items.join(shared, ["item_feed_uid", "item_title"], "left")
    hit = F.coalesce("shared", F.lit(False)) & (F.col("item_rating") == UNREAD)
    return joined.withColumn(
        "item_rating", F.when(hit, UNINTERESTING).otherwise(F.col("item_rating"))
    ).select(*items.columns)


def dedupe_changes(items: DataFrame, feed_uid: int | None = None) -> DataFrame:
    """The same as changes for a store. Only keys, titles and ratings are read, of one feed if it is named."""
    narrow = items.select("item_uid", "item_feed_uid", "item_title", "item_rating")
    mine = narrow if feed_uid is None else narrow.where(F.col("item_feed_uid") == feed_uid)
    return same_title(mine).where(F.col("item_rating") == UNREAD).select("item_uid", F.lit(UNINTERESTING).alias("item_rating"))


def dedupe_count(items: DataFrame, feed_uid: int | None = None) -> DataFrame:
    shared = same_title(items).where(F.col("item_rating") == UNREAD)
    if feed_uid is not None:
        shared = shared.where(F.col("item_feed_uid") == feed_uid)
    return shared.agg(F.count(F.lit(1)).alias("modified"))


# ---------------------------------------------------------------- purges

def purge_unread(items: DataFrame, feed_uid: int) -> DataFrame:
    return items.where(~((F.col("item_feed_uid") == feed_uid) & (F.col("item_rating") == UNREAD)))


def purge_reload(
    items: DataFrame, feeds: DataFrame, rules: DataFrame, entries: DataFrame, feed_uid: int, as_of
) -> tuple[DataFrame, Ingested]:
    """Drop the unread items of a feed, forget its validators, ingest it again."""
    kept = purge_unread(items, feed_uid)
    mine = F.col("feed_uid") == feed_uid
    reset = feeds.withColumns({
        "feed_etag": F.when(~mine, F.col("feed_etag")),
        "feed_modified": F.when(~mine, F.col("feed_modified")),
        "feed_errors": F.when(mine, 0).otherwise(F.col("feed_errors")),
    })
    return kept, ingest(entries.where(mine), kept, reset, rules, as_of)


def hard_purge(feeds: DataFrame, items: DataFrame, rules: DataFrame, tags: DataFrame, feed_uid: int):
    """Remove a feed with its items, rules and tags: (feeds, items, rules, tags)."""
    left = items.where(F.col("item_feed_uid") != feed_uid)
    return (
        feeds.where(F.col("feed_uid") != feed_uid),
        left,
        rules.where(F.col("rule_feed_uid").isNull() | (F.col("rule_feed_uid") != feed_uid)),
        drop_orphan_tags(tags, left),
    )


def clear_old_content(items: DataFrame, as_of, days: int = CLEAR_CONTENT_DAYS) -> DataFrame:
    old = (F.col("item_rating") < 0) & (F.col("item_created") < days_before(as_of, days))
    return items.withColumn("item_content", F.when(old, F.lit("")).otherwise(F.col("item_content")))


def clear_changes(items: DataFrame, as_of, days: int = CLEAR_CONTENT_DAYS) -> DataFrame:
    """The same as changes for a store; content is not read."""
    old = (F.col("item_rating") < 0) & (F.col("item_created") < days_before(as_of, days))
    return items.where(old).select("item_uid", F.lit(True).alias("cleared"))


def expire_items(items: DataFrame, feeds: DataFrame, as_of, days: int = EXPIRE_DAYS) -> DataFrame:
    """Delete negatively rated items old enough and no longer in the feed.

    The bound is the earlier of ``days`` ago and a week before the oldest item
    the feed still lists. A feed whose oldest item is unknown loses nothing.
    """
    gone = _expired(items, feeds, as_of, days)
    return gone.where("NOT gone").select(*items.columns)


def expiry_changes(items: DataFrame, feeds: DataFrame, as_of, days: int = EXPIRE_DAYS) -> DataFrame:
    """The same as changes for a store: the articles to delete."""
    narrow = items.select("item_uid", "item_feed_uid", "item_rating", "item_created")
    return _expired(narrow, feeds, as_of, days).where("gone").select("item_uid", F.lit(True).alias("deleted"))


def _expired(items: DataFrame, feeds: DataFrame, as_of, days: int) -> DataFrame:
    margin = F.timestamp_micros(F.unix_micros("feed_oldest") - F.lit(OLDEST_MARGIN_DAYS * 86_400_000_000))
    bound = feeds.where(F.col("feed_oldest").isNotNull()).select(
        F.col("feed_uid").alias("item_feed_uid"), F.least(days_before(as_of, days), margin).alias("bound")
    )
    gone = F.coalesce((F.col("item_rating") < 0) & (F.col("item_created") < F.col("bound")), F.lit(False))
    return items.join(bound, "item_feed_uid", "left").withColumn("gone", gone)


def orphan_tags(tags: DataFrame, items: DataFrame) -> DataFrame:
    return tags.join(items.select(F.col("item_uid").alias("tag_item_uid")), "tag_item_uid", "left_anti")


def drop_orphan_tags(tags: DataFrame, items: DataFrame) -> DataFrame:
    return tags.join(items.select(F.col("item_uid").alias("tag_item_uid")), "tag_item_uid", "left_semi")


def cleanup(items: DataFrame, feeds: DataFrame, tags: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """The nightly pass: clear old content, expire items, drop their tags."""
    left = expire_items(clear_old_content(items, as_of), feeds, as_of)
    return left, drop_orphan_tags(tags, left)


# ---------------------------------------------------------------- rules

def exempt_feed(items: DataFrame, rules: DataFrame, feed_uid: int) -> DataFrame:
    """A newly exempt feed gets back what global rules filtered, if its content remains."""
    freed = filtered_by_global(items.where(F.col("item_feed_uid") == feed_uid), rules).where(
        F.col("item_content") != ""
    ).select("item_uid", F.lit(True).alias("freed"))
    return _back_to_unread(items.join(freed, "item_uid", "left").withColumn(
        "freed", F.coalesce("freed", F.lit(False))), items.columns)


def _back_to_unread(flagged: DataFrame, columns: list[str]) -> DataFrame:
    freed = F.col("freed")
    return flagged.withColumns({
        "item_rating": F.when(freed, UNREAD).otherwise(F.col("item_rating")),
        "item_rule_uid": F.when(~freed, F.col("item_rule_uid")),
        "item_rule_side": F.when(~freed, F.col("item_rule_side")),
    }).select(*columns)


def delete_rule(items: DataFrame, rules: DataFrame, rule_uid: int) -> tuple[DataFrame, DataFrame]:
    """Remove a rule. Its items with content become unread, the others go with it."""
    mine = F.coalesce(F.col("item_rule_uid") == rule_uid, F.lit(False))
    content = F.coalesce(F.col("item_content") != "", F.lit(False))
    kept = items.where(~mine | content).withColumn("freed", mine)
    return _back_to_unread(kept, items.columns), rules.where(F.col("rule_uid") != rule_uid)


def refused_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """(rule_uid, rule_text, reason) of the ``changes`` to expression rules whose new text can't be a rule."""
    own = changes.where(F.col("rule_text").isNotNull()).select("rule_uid", "rule_text").join(
        rules.select("rule_uid", "rule_type"), "rule_uid"
    )
    return check_rules(own, rule_fields(rules.sparkSession))


def update_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Change text and expiry of rules (``rule_uid``, ``rule_text``, ``rule_expires``).

    A change to a text that can't be a rule is refused as a whole (:func:`refused_changes` says why).
    """
    changes = changes.join(broadcast_if_small(refused_changes(rules, changes).select("rule_uid")), "rule_uid", "left_anti")
    new = changes.select("rule_uid", F.col("rule_text").alias("t"), F.col("rule_expires").alias("e"), F.lit(True).alias("c"))
    joined = rules.join(new, "rule_uid", "left")
    return joined.withColumns({
        "rule_text": F.coalesce("t", "rule_text"),
        "rule_expires": F.when(F.col("c"), F.col("e")).otherwise(F.col("rule_expires")),
    }).select(*rules.columns)


# ---------------------------------------------------------------- feeds

PATCHABLE = (
    "feed_title", "feed_html", "feed_desc", "feed_pubxml", "feed_private", "feed_exempt",
    "feed_dupcheck", "feed_status", "feed_filter",
)


def patch_feeds(feeds: DataFrame, changes: DataFrame) -> DataFrame:
    """Set feed attributes; null in ``changes`` means no change, a blank filter clears it.

    A filter that can't be a rule is refused: the feed keeps the one it has.
    """
    fields = [c for c in PATCHABLE if c in changes.columns]
    if "feed_filter" in fields:
        changes = _checked_filters(changes)
    new = changes.select("feed_uid", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = feeds.join(new, "feed_uid", "left")
    for name in fields:
        given = F.col(f"new_{name}")
        if name == "feed_filter":
            value = F.when(given.isNotNull(), F.nullif(F.trim(given), F.lit(""))).otherwise(F.col(name))
        else:
            value = F.coalesce(given, F.col(name))
        joined = joined.withColumn(name, value)
    return joined.select(*feeds.columns)


def _checked_filters(changes: DataFrame) -> DataFrame:
    """``changes`` without the filters that can't be rules. The different new filter texts, which are code, come to the driver."""
    texts = changes.where(F.trim("feed_filter") != "").select("feed_filter", clean_rule(F.col("feed_filter")).alias("text")).distinct()
    bad = refused_texts([(r["text"], (r["feed_filter"],)) for r in texts.collect()], rule_fields(changes.sparkSession))
    if not bad:
        return changes
    refused = changes.sparkSession.createDataFrame(bad, "feed_filter string, __reason string")
    marked = changes.join(broadcast_if_small(refused), "feed_filter", "left")
    return marked.withColumn("feed_filter", F.when(F.col("__reason").isNull(), F.col("feed_filter"))).select(*changes.columns)


def clear_errors(feeds: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Feeds fetched without error: count back to 0, validators as fetched or null."""
    ok = (
        fetch_log.where("ok").groupBy("feed_uid")
        .agg(F.max(F.struct("ts", "seq", "etag", "modified")).alias("s"))
        .select("feed_uid", F.nullif("s.etag", F.lit("")).alias("etag"), F.col("s.modified").alias("modified"),
                F.lit(True).alias("fetched"))
    )
    joined = feeds.join(ok, "feed_uid", "left")
    fetched = F.coalesce("fetched", F.lit(False))
    return joined.withColumns({
        "feed_errors": F.when(fetched, 0).otherwise(F.col("feed_errors")),
        "feed_etag": F.when(fetched, F.col("etag")).otherwise(F.col("feed_etag")),
        "feed_modified": F.when(fetched, F.col("modified")).otherwise(F.col("feed_modified")),
    }).select(*feeds.columns)


def error_runs(fetch_log: DataFrame, feeds: DataFrame | None = None, max_errors: int = MAX_ERRORS) -> DataFrame:
    """Per feed: consecutive errors at the end of the log, the longest run, suspended or not.

    With ``feeds`` the run a feed entered the log with is counted in.
    ``max_errors`` of -1 never suspends.
    """
    runs = failure_runs(fetch_log)
    first_ok = fetch_log.where("ok").groupBy("feed_uid").agg(F.min(F.struct("ts", "seq")).alias("first_ok"))
    runs = runs.join(first_ok, "feed_uid", "left")
    start = F.lit(0)
    if feeds is not None:
        runs = runs.join(feeds.select("feed_uid", "feed_errors"), "feed_uid", "left")
        start = F.coalesce("feed_errors", F.lit(0))
    early = F.col("first_ok").isNull() | (F.struct("ts", "seq") < F.col("first_ok"))
    errors = F.col("failures") + F.when(early, start).otherwise(0)
    limit = F.lit(max_errors)
    return (
        runs.withColumn("errors", errors)
        .groupBy("feed_uid")
        .agg(
            F.count(F.lit(1)).alias("fetches"),
            F.max(F.struct("ts", "seq", "errors")).alias("last"),
            F.max("errors").alias("longest"),
            F.min(F.when((limit != -1) & (F.col("errors") > limit), F.struct("ts", "seq", "errors"))).alias("over"),
        )
        .select(
            "feed_uid", "fetches", F.col("last.errors").alias("feed_errors"), "longest",
            F.col("over").isNotNull().alias("suspended"), F.col("over.errors").alias("suspended_at"),
        )
    )


def apply_fetch_log(feeds: DataFrame, fetch_log: DataFrame, max_errors: int = MAX_ERRORS) -> DataFrame:
    """Feeds after a log of fetches: validators, error counts and suspensions."""
    runs = error_runs(fetch_log, feeds, max_errors).select(
        "feed_uid", F.col("feed_errors").alias("errors"), "suspended"
    )
    joined = clear_errors(feeds, fetch_log).join(runs, "feed_uid", "left")
    return joined.withColumns({
        "feed_errors": F.coalesce(F.col("errors").cast("int"), "feed_errors"),
        "feed_status": F.when(F.coalesce("suspended", F.lit(False)), STATUS_SUSPENDED).otherwise(F.col("feed_status")),
    }).select(*feeds.columns)


def notify_suspended(runs: DataFrame, as_of, max_errors: int = MAX_ERRORS) -> DataFrame:
    """A notification item for every feed suspended by :func:`error_runs`.

    The text has the count at which the limit was passed, which is more than one past it for a
    feed that entered the log over the limit.
    Its GUID comes from the feed and the MD5 of the text. Ids are left to the
    ingest that appends it.
    """
    now = as_of_column(as_of)
    uid = F.col("feed_uid").cast("string")
    text = F.concat(
        F.lit("This feed was suspended because of "),
        F.coalesce("suspended_at", F.lit(max_errors + 1)).cast("string"), F.lit(" consecutive errors"),
    )
    return runs.where("suspended").select(
        F.col("feed_uid").alias("item_feed_uid"),
        F.concat(F.lit("notice://"), uid, F.lit("/"), md5_hex(text)).alias("item_guid"),
        now.alias("item_created"), now.alias("item_modified"),
        F.concat(F.lit("/feed/"), uid).alias("item_link"),
        md5_hex(text).alias("item_md5hex"),
        F.lit(NOTICE_TITLE).alias("item_title"), text.alias("item_content"),
        F.lit(NOTICE_AUTHOR).alias("item_creator"), F.lit(UNREAD).alias("item_rating"),
    )


def edit_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Set link, title and content of edited items."""
    names = ("link", "title", "content")
    new = edits.select("item_uid", *[F.col(n).alias(f"new_{n}") for n in names], F.lit(True).alias("edited"))
    joined = items.join(new, "item_uid", "left")
    return joined.withColumns({
        f"item_{n}": F.when(F.col("edited"), F.col(f"new_{n}")).otherwise(F.col(f"item_{n}")) for n in names
    }).select(*items.columns)


def change_feed_url(
    feeds: DataFrame, items: DataFrame, rules: DataFrame, entries: DataFrame, feed_uid: int, url: str, as_of
) -> tuple[DataFrame, Ingested]:
    """Move a feed to a new URL and ingest it there.

    Raises ValueError if another feed has the URL. A suspended feed becomes
    active again.
    """
    mine = F.col("feed_uid") == feed_uid
    if not feeds.where(~mine & (F.col("feed_xml") == url)).isEmpty():
        raise ValueError(f"another feed already has the URL {url}")
    moved = feeds.withColumns({
        "feed_xml": F.when(mine, F.lit(url)).otherwise(F.col("feed_xml")),
        "feed_errors": F.when(mine, 0).otherwise(F.col("feed_errors")),
        "feed_status": F.when(mine, STATUS_ACTIVE).otherwise(F.col("feed_status")),
    })
    return moved, ingest(entries.where(mine), items, moved, rules, as_of)
