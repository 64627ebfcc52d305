"""Structured Streaming jobs around the batch operators.

All tables they write are append-only Parquet, or one folder per batch, so a
batch replayed after a failure leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom import schema
from feedloom.functions.scalars import as_of_column
from feedloom.operators import token_index
from feedloom.operators.ingest import first_guid, ingest
from feedloom.operators.maintain import last_rating
from feedloom.operators.sizing import broadcast_if_small
from feedloom.session import TEXT, durable, remove, scratch
from feedloom.sources import tables as store
from feedloom.streaming.incremental import merge_stats
from feedloom.streaming.keyed import ERRORS, count_errors

REFRESH_INTERVAL = "1 hour"
SEEN_FOR = "24 hours"


SEEN = "feed_uid long, guid string, seen_at timestamp"


def unseen_entries(batch: DataFrame, seen: DataFrame, as_of, keep: str = SEEN_FOR) -> tuple[DataFrame, DataFrame]:
    """Entries of a batch with a GUID not seen within ``keep``, and the seen table after it.

    Of the copies in a batch the one nearest the end of its document counts, before any
    look at what was seen. Every sighting renews the time of a GUID, and what is
    older than ``keep`` is forgotten, so ``seen`` (feed_uid, guid, seen_at) is bounded by
    what the feeds list in that time. It only saves work: the ingest checks the stored items.
    """
    now = as_of_column(as_of)
    live = seen.where(F.col("seen_at") >= now - F.expr(f"INTERVAL {keep}"))
    once = first_guid(batch)
    known = live.select(F.col("feed_uid").alias("k_feed"), F.col("guid").alias("k_guid"))
    fresh = once.join(known, (F.col("feed_uid") == F.col("k_feed")) & F.col("guid").eqNullSafe(F.col("k_guid")), "left_anti")
    sighted = once.select("feed_uid", "guid", now.alias("seen_at"))
    return fresh, live.unionByName(sighted).groupBy("feed_uid", "guid").agg(F.max("seen_at").alias("seen_at"))


def _with_seen(batch: DataFrame, batch_id: int, path: str, as_of, keep: str = SEEN_FOR) -> DataFrame:
    """Fresh entries of a batch. Its sightings are added as ``seen/batch=n``; what is older than ``keep`` is removed.

    The batch has to be a written one, in which (feed, position) names an entry: it is read again for the entries. Only keys of the batch are written. A replayed batch looks at the batches before it only, so it finds the same again.
    """
    spark = batch.sparkSession
    seen = spark.createDataFrame([], SEEN)
    if _exists(spark, f"{path}/seen"):
        log = spark.read.schema(f"{SEEN}, batch long").parquet(f"{path}/seen").where(F.col("batch") < batch_id)
        # One row a batch that is still there.
        ages = log.groupBy("batch").agg((F.max("seen_at") < as_of_column(as_of) - F.expr(f"INTERVAL {keep}")).alias("old"))
        remove(spark, [f"{path}/seen/batch={r['batch']}" for r in ages.where("old").collect()])
        seen = spark.read.schema(f"{SEEN}, batch long").parquet(f"{path}/seen").where(F.col("batch") < batch_id).drop("batch")
    # Found and written by keys, so text is shuffled once at most, and only by whoever reads it.
    fresh, _ = unseen_entries(batch.select("feed_uid", "guid", "position"), seen, as_of, keep)
    places = broadcast_if_small(fresh.select("feed_uid", "position"))
    sighted = batch.select("feed_uid", "guid").distinct().withColumn("seen_at", as_of_column(as_of))
    sighted.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
    return batch.join(places, ["feed_uid", "position"], "left_semi")


def run_seen(entries: DataFrame, path: str, checkpoint: str, as_of, once: bool = True) -> StreamingQuery:
    """Write the fresh entries of each batch to ``fresh/batch=n``."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            fresh = _with_seen(durable(batch, **TEXT), batch_id, path, as_of)
            fresh.write.mode("overwrite").options(**TEXT).parquet(f"{path}/fresh/batch={batch_id}")

    writer = entries.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, REFRESH_INTERVAL).start()


def _trigger(writer, once: bool, interval: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)


def run_refresh(
    entries: DataFrame, path: str, checkpoint: str, as_of=None, once: bool = True, interval: str = REFRESH_INTERVAL
) -> StreamingQuery:
    """Ingest a stream of entries into the tables under ``path``.

    Tags go first: item ids follow from the stored items, so a replay after a
    crash between the two writes finds the same ids and adds the items only.
    The oldest listed item of each feed goes to ``feed_marks``. GUIDs seen in the last day
    are left out beforehand (:func:`unseen_entries`). A batch leaves nothing in the shared
    folder but what it stores.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            store_batch(batch, batch_id)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Read once: positions given by the reader must not change between uses.
        now = as_of if as_of is not None else F.current_timestamp()
        batch = _with_seen(durable(batch, **TEXT), batch_id, path, now)
        held = store.load(spark, path)
        done = ingest(batch, held.items, current_feeds(spark, path), held.rules, now)
        keys = ["tag_item_uid", "tag_name", "tag_by"]
        fresh_tags = done.new_tags.join(held.tags.select(*keys), keys, "left_anti")
        store.append(fresh_tags, path, "tags")
        store.append(done.new_items, path, "items")
        done.feeds.select("feed_uid", "feed_oldest", F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(
            f"{path}/feed_marks"
        )

    writer = entries.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, interval).start()


def current_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feeds with the latest mark of their oldest listed item."""
    feeds = store.load(spark, path).feeds
    marks = (
        spark.read.schema("feed_uid long, feed_oldest timestamp, batch_id long")
        .option("ignoreMissingFiles", True).parquet(f"{path}/feed_marks")
        if _exists(spark, f"{path}/feed_marks") else None
    )
    if marks is None:
        return feeds
    last = marks.groupBy("feed_uid").agg(F.max_by("feed_oldest", "batch_id").alias("mark"))
    return feeds.join(last, "feed_uid", "left").withColumn(
        "feed_oldest", F.coalesce("mark", "feed_oldest")
    ).select(*feeds.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def run_ratings(events: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str = "10 seconds"):
    """Keep the last rating per item of each batch in ``ratings``.

    Readers combine it with the items through :func:`rated_items`, so a click
    never rewrites article text.
    """
    def rate(batch: DataFrame, batch_id: int) -> None:
        last_rating(batch).write.mode("overwrite").parquet(f"{path}/ratings/batch={batch_id}")

    writer = events.writeStream.foreachBatch(rate).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, interval).start()


def rated_items(spark: SparkSession, path: str) -> DataFrame:
    """Stored items with the ratings received so far."""
    items = store.load(spark, path).items
    if not _exists(spark, f"{path}/ratings"):
        return items
    log = spark.read.schema("item_uid long, rating int, rated timestamp, batch long").parquet(f"{path}/ratings")
    last = log.groupBy("item_uid").agg(F.max(F.struct("rated", "batch", "rating")).alias("r")).select(
        "item_uid", F.col("r.rating").alias("rating"), F.col("r.rated").alias("rated")
    )
    return items.join(last, "item_uid", "left").withColumns({
        "item_rating": F.coalesce("rating", "item_rating"),
        "item_rated": F.coalesce("rated", "item_rated"),
        "updated": F.greatest("updated", "rated"),
    }).select(*items.columns)


def run_stats(changes: DataFrame, stats: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge a stream of item changes into per-feed statistics.

    Batch ``n`` writes ``feed_stats/batch=n`` from batch ``n - 1``; the first
    one starts from ``stats``.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = stats if batch_id == 0 else spark.read.parquet(f"{path}/feed_stats/batch={batch_id - 1}")
        merge_stats(before, batch).write.mode("overwrite").parquet(f"{path}/feed_stats/batch={batch_id}")
        remove(spark, [f"{path}/feed_stats/batch={batch_id - 2}"])

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, "10 seconds").start()


def run_errors(
    fetches: DataFrame, path: str, checkpoint: str, max_errors: int = schema.MAX_ERRORS, once: bool = True
) -> StreamingQuery:
    """Keep consecutive error counts per feed over a stream of fetch results.

    The counts are keyed state (:mod:`feedloom.streaming.keyed`), which a restart takes up from the checkpoint. Batch ``n``
    writes the feeds it touched to ``feed_errors/batch=n``; :func:`feed_errors` reads the latest of each.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/feed_errors/batch={batch_id}")

    writer = count_errors(fetches, max_errors).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, "10 seconds").start()


def feed_errors(spark: SparkSession, path: str) -> DataFrame:
    """feed_uid, feed_errors, longest and suspended as the last batch that touched a feed left them."""
    log = spark.read.schema(f"{ERRORS}, batch long").parquet(f"{path}/feed_errors")
    last = log.groupBy("feed_uid").agg(F.max_by(F.struct("feed_errors", "longest", "suspended"), "batch").alias("s"))
    return last.select("feed_uid", "s.feed_errors", "s.longest", "s.suspended")


def run_tokens(changes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the token index at ``path`` in step with a stream of item changes.

    Batch ``n`` is generation ``n + 1`` of the index: it writes its own items only. When more than a few
    generations have come together they are compacted; what the compaction before that replaced is removed then.
    """
    def index(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        token_index.update(batch, path, batch_id + 1)
        if len(token_index.spans(spark, path)) > token_index.MOST_SPANS + 1:
            token_index.drop_replaced(spark, path)
            token_index.compact(spark, path, first=False)

    writer = changes.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, "10 seconds").start()
