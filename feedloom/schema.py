"""Logical table schemas and the fixed value domains of the model."""

from __future__ import annotations

from pyspark.sql import types as T

FEEDS = T.StructType([
    T.StructField("feed_uid", T.LongType(), False),
    T.StructField("feed_xml", T.StringType(), False),
    T.StructField("feed_pubxml", T.StringType()),
    T.StructField("feed_html", T.StringType()),
    T.StructField("feed_title", T.StringType()),
    T.StructField("feed_desc", T.StringType()),
    T.StructField("feed_etag", T.StringType()),
    T.StructField("feed_modified", T.TimestampType()),
    T.StructField("feed_errors", T.IntegerType()),
    T.StructField("feed_status", T.IntegerType()),
    T.StructField("feed_private", T.BooleanType()),
    T.StructField("feed_dupcheck", T.BooleanType()),
    T.StructField("feed_exempt", T.BooleanType()),
    T.StructField("feed_oldest", T.TimestampType()),
    T.StructField("feed_filter", T.StringType()),
])

ITEMS = T.StructType([
    T.StructField("item_uid", T.LongType(), False),
    T.StructField("item_feed_uid", T.LongType()),
    T.StructField("item_guid", T.StringType()),
    T.StructField("item_link", T.StringType()),
    T.StructField("item_title", T.StringType()),
    T.StructField("item_content", T.StringType()),
    T.StructField("item_md5hex", T.StringType()),
    T.StructField("item_creator", T.StringType()),
    T.StructField("item_loaded", T.TimestampType()),
    T.StructField("item_created", T.TimestampType()),
    T.StructField("item_modified", T.TimestampType()),
    T.StructField("item_rated", T.TimestampType()),
    T.StructField("updated", T.TimestampType()),
    T.StructField("item_rating", T.IntegerType()),
    T.StructField("item_rule_uid", T.LongType()),
    T.StructField("item_rule_side", T.StringType()),
])

RULES = T.StructType([
    T.StructField("rule_uid", T.LongType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("rule_feed_uid", T.LongType()),
    T.StructField("rule_expires", T.TimestampType()),
    T.StructField("rule_text", T.StringType()),
])

TAGS = T.StructType([
    T.StructField("tag_item_uid", T.LongType(), False),
    T.StructField("tag_name", T.StringType(), False),
    T.StructField("tag_by", T.IntegerType()),
])

#: One normalised feed entry, as the ingest step expects it. ``position`` is
#: the place in the feed document (larger = nearer its end) and is unique
#: within a feed and batch.
ENTRIES = T.StructType([
    T.StructField("feed_uid", T.LongType(), False),
    T.StructField("position", T.LongType(), False),
    T.StructField("guid", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("runt", T.BooleanType()),
])

# --- fixed values -----------------------------------------------------------
INTERESTING, UNREAD, UNINTERESTING, FILTERED = 1, 0, -1, -2
RATING_OPS = {"promote": INTERESTING, "basic": UNREAD, "demote": UNINTERESTING}
STATUS_ACTIVE, STATUS_SUSPENDED = 0, 1
TAG_BY_FEED, TAG_BY_USER, TAG_BY_ALGORITHM = 0, 1, 2

PAGE_LIMIT = 200
SHARE_LIMIT = 50
DECAY_DAYS = 90
CLEAR_CONTENT_DAYS = 7
EXPIRE_DAYS = 180
OLDEST_MARGIN_DAYS = 7
STATS_DAYS = 30
MAX_ERRORS = 1000
UNKNOWN_AUTHOR = "Unknown"
