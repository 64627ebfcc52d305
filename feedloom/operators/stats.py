"""Aggregations: feed statistics, signal-to-noise and activity reports.

Counts, sums and extremes all have partial aggregates, so a feed holding a
large share of the items shrinks to one row per task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.scalars import age_days, day, days_before
from feedloom.schema import DECAY_DAYS, STATS_DAYS

COUNTS = {"interesting": 1, "unread": 0, "uninteresting": -1, "filtered": -2}


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("item_rating") == value).alias(name) for name, value in COUNTS.items()
    ] + [F.count(F.lit(1)).alias("total")]


def last_change() -> Column:
    return F.coalesce(F.col("item_modified"), F.col("item_created"))


def rating_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(*_counts())


def latest_change(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(
        F.max(last_change()).alias("last_modified")
    )


def decay_weight(created: Column, as_of, decay: int = DECAY_DAYS) -> Column:
    """Weight halves at every full ``decay`` days; the exponent stops at 62.

    The step truncates towards zero. An item created a full step or more in
    the future, or at no known time, has no weight (null).
    """
    steps = F.least(F.lit(62.0), age_days(created, as_of) / F.lit(float(decay))).cast("int")
    return F.when(created.isNotNull() & (steps >= 0), F.pow(F.lit(2.0), -steps))


def _snr(as_of, decay: int) -> Column:
    weight = decay_weight(F.col("item_created"), as_of, decay)
    signal = F.sum(F.when(F.col("item_rating") > 0, weight).otherwise(weight * 0.0))
    return F.coalesce(F.try_divide(signal, F.sum(weight)), F.lit(0.0))


def snr(items: DataFrame, as_of, decay: int = DECAY_DAYS) -> DataFrame:
    return items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(_snr(as_of, decay).alias("snr"))


def feed_stats(items: DataFrame, as_of, decay: int = DECAY_DAYS) -> DataFrame:
    """All statistics of a feed in one pass over the items."""
    return items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(
        *_counts(), F.max(last_change()).alias("last_modified"), _snr(as_of, decay).alias("snr")
    )


def feeds_with_items(feeds: DataFrame, items: DataFrame, as_of, decay: int = DECAY_DAYS) -> DataFrame:
    """Statistics for every feed, those without items included."""
    return with_feed_stats(feeds.select("feed_uid"), feed_stats(items, as_of, decay))


def with_feed_stats(feeds: DataFrame, stats: DataFrame) -> DataFrame:
    joined = feeds.join(stats, "feed_uid", "left")
    filled = {name: F.coalesce(F.col(name), F.lit(0)).alias(name) for name in [*COUNTS, "total"]}
    filled["snr"] = F.coalesce(F.col("snr"), F.lit(0.0)).alias("snr")
    return joined.select(*[filled.get(c, F.col(c)) for c in joined.columns])


def feeds_snr(feeds: DataFrame, stats: DataFrame, as_of) -> DataFrame:
    """Feed rows with statistics; ``last_modified`` becomes an age in days."""
    joined = with_feed_stats(feeds, stats)
    return joined.withColumn("last_modified", age_days(F.col("last_modified"), as_of))


def load_stats(items: DataFrame, as_of, days: int = STATS_DAYS) -> DataFrame:
    """Articles per load day. ``filtered`` counts rating -1, as readers of the report expect."""
    rating = F.col("item_rating")
    return (
        items.where(F.col("item_loaded") > days_before(as_of, days))
        .groupBy(day(F.col("item_loaded")).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("articles"),
            F.count_if(rating == 1).alias("interesting"),
            F.count_if(rating == 0).alias("unread"),
            F.count_if(rating == -1).alias("filtered"),
        )
        .orderBy("date")
    )


def daily_stats(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per creation day. Items are counted per feed and day before the feed join."""
    rating = F.col("item_rating")
    per_feed = items.groupBy(
        F.col("item_feed_uid").alias("feed_uid"), day(F.col("item_created")).alias("day")
    ).agg(
        F.count_if(rating > 0).alias("interesting"),
        F.count_if(rating == -2).alias("filtered"),
        F.count_if(rating == -1).alias("uninteresting"),
    )
    return (
        per_feed.join(feeds.select("feed_uid"), "feed_uid", "left_semi")
        .groupBy("day")
        .agg(*[F.sum(c).alias(c) for c in ("interesting", "filtered", "uninteresting")])
        .orderBy("day")
    )


def _ratio(interesting: Column, uninteresting: Column) -> Column:
    total = interesting + uninteresting
    return F.when(total > 0, F.floor(interesting * 100 / F.nullif(total, F.lit(0))).cast("long"))


def top_feeds(items: DataFrame, feeds: DataFrame, n: int = 20) -> DataFrame:
    """Feeds by share of interesting articles among the rated ones, whole percent."""
    counts = items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(
        F.count_if(F.col("item_rating") == 1).alias("i"), F.count_if(F.col("item_rating") == -1).alias("u")
    )
    return (
        counts.join(feeds.select("feed_uid", "feed_title"), "feed_uid")
        .groupBy("feed_title")
        .agg(F.sum("i").alias("i"), F.sum("u").alias("u"))
        .select("feed_title", _ratio(F.col("i"), F.col("u")).alias("interest_ratio"))
        .orderBy(F.col("interest_ratio").desc_nulls_last(), "feed_title")
        .limit(n)
    )


def hit_ratio(feeds_snr: DataFrame) -> DataFrame:
    return feeds_snr.select(
        "feed_uid", F.coalesce(_ratio(F.col("interesting"), F.col("uninteresting")), F.lit(0)).alias("ratio")
    )


def feed_totals(feeds_snr: DataFrame) -> DataFrame:
    return feeds_snr.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unread", "filtered", "interesting", "total")]
    )


def rule_hits(rules: DataFrame, items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items joined to the rule that filtered them, with the feed a rule is limited to."""
    titles = feeds.select(F.col("feed_uid").alias("rule_feed_uid"), F.col("feed_title").alias("rule_feed_title"))
    scoped = rules.join(titles, "rule_feed_uid", "left")
    return items.join(scoped, items.item_rule_uid == scoped.rule_uid)


def _rule_label(counts: DataFrame, rules: DataFrame) -> DataFrame:
    return counts.join(rules, counts.item_rule_uid == rules.rule_uid)


def top_rules(items: DataFrame, rules: DataFrame, feed_uid: int, n: int = 25) -> DataFrame:
    """Rules that filtered most of a feed. Counted by rule before the join."""
    counts = (
        items.where((F.col("item_feed_uid") == feed_uid) & (F.col("item_rating") == -2))
        .where(F.col("item_rule_uid").isNotNull())
        .groupBy("item_rule_uid")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return (
        _rule_label(counts, rules)
        .select("item_rule_uid", "rule_type", "rule_text", "hits")
        .orderBy(F.desc("hits"), "rule_text", "item_rule_uid")
        .limit(n)
    )


def rule_stats(rules: DataFrame, items: DataFrame, feeds: DataFrame, as_of, n: int = 100) -> DataFrame:
    """Hits of each rule in the last week and the week before."""
    week, fortnight = days_before(as_of, 7), days_before(as_of, 14)
    created, uid = F.col("item_created"), F.col("item_uid")
    counts = (
        items.where((created > fortnight) & F.col("item_rule_uid").isNotNull())
        .groupBy("item_rule_uid")
        .agg(
            F.count_if(created > week).alias("last_7"),
            F.count_if(created < week).alias("prev_7"),
            # Without a recent item the reports show this number; it is no bound for ids.
            F.coalesce(F.min(F.when(created > week, uid)), F.lit(2000000000)).alias("first_item"),
            F.max(F.when(created > week, uid).otherwise(F.lit(0))).alias("last_item"),
        )
    )
    titles = feeds.select(F.col("feed_uid").alias("rule_feed_uid"), "feed_title")
    return (
        _rule_label(counts, rules)
        .join(titles, "rule_feed_uid", "left")
        .select(
            "rule_uid", "rule_type", "rule_text",
            F.coalesce("rule_feed_uid", F.lit(-1)).alias("rule_feed_uid"),
            "feed_title", "last_7", "prev_7", "first_item", "last_item",
        )
        .orderBy(F.desc("last_7"), "rule_uid")
        .limit(n)
    )


def tag_lists(tags: DataFrame) -> DataFrame:
    """Sorted distinct tag names of each item (one output row holds the list)."""
    return tags.groupBy(F.col("tag_item_uid").alias("item_uid")).agg(
        F.array_sort(F.collect_set("tag_name")).alias("tags")
    )


def ingest_counts(new_items: DataFrame) -> DataFrame:
    """Added and filtered articles per feed of an accepted batch."""
    return new_items.groupBy(F.col("item_feed_uid").alias("feed_uid")).agg(
        F.count_if(F.col("item_rating") == 0).alias("num_added"),
        F.count_if(F.col("item_rating") == -2).alias("num_filtered"),
    )


def link_set(items: DataFrame) -> DataFrame:
    return items.select("item_link").distinct().orderBy("item_link")
