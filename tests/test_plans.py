"""Physical plans: what is pushed down, what is shuffled, how a hot key is split."""

from pyspark.sql import functions as F

from feedloom.operators import rules as R
from feedloom.operators import stats as A
from feedloom.operators import view as V
from feedloom.plans.model import AS_OF
from feedloom.sources import tables as store


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_no_text(spark, m, tmp_path):
    store.save(str(tmp_path), feeds=m.feeds, items=m.items, rules=m.rules, tags=m.tags)
    t = store.load(spark, str(tmp_path))
    text = plan(A.feed_stats(t.items, AS_OF))
    assert "item_content" not in text and "partial_" in text
    chosen = plan(V.filter_feed(V.filter_rating(t.items), 3).select("item_uid"))
    assert "EqualTo(item_feed_uid,3)" in chosen and "item_content" not in chosen


def test_tokens_are_not_shuffled(m):
    scoped = R.scope_keys(m.items, m.feeds)
    assert "Exchange hashpartitioning" not in plan(R.item_words(scoped))


def test_a_page_is_a_top_k(m):
    assert "TakeOrderedAndProject" in plan(V.page(V.sort_view(m.items.select("item_uid"), "seen")))


def test_hot_feed_is_split(spark, m):
    """Two thirds of the rows in one feed: AQE cuts its partition in the feed join."""
    items = spark.range(300000).select(
        F.col("id").alias("item_uid"),
        F.when(F.col("id") % 3 < 2, F.lit(1)).otherwise(F.col("id") % 20).cast("long").alias("item_feed_uid"),
        F.sha2(F.col("id").cast("string"), 512).alias("item_title"),
    )
    feeds = spark.range(20).select(F.col("id").alias("feed_uid"), F.lit("t").alias("feed_title"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = V.items_with_feeds(items, feeds).select("item_uid", "item_title", "feed_title")
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
