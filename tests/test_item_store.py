"""Articles with changes beside them against the same operations on whole rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from feedloom.operators import maintain as M
from feedloom.plans.model import AS_OF
from feedloom.sources import item_store as IS


@pytest.fixture
def store(spark, m, tmp_path):
    return IS.create(m.items, f"t{uuid.uuid4().hex}", str(tmp_path / "store"), buckets=4)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_changes_are_the_same_as_whole_rows(spark, m, store, tmp_path):
    want = M.apply_ratings(m.items, m.rating_events)
    IS.add_changes(M.rating_changes(m.rating_events), store, 1)
    assert rows(IS.merged(spark, store)) == rows(want)
    want = M.dedupe(want)
    IS.add_changes(M.dedupe_changes(IS.merged(spark, store)), store, 2)
    assert rows(IS.merged(spark, store)) == rows(want)
    want = M.expire_items(M.clear_old_content(want, AS_OF), m.feeds, AS_OF)
    IS.add_changes(M.clear_changes(IS.merged(spark, store), AS_OF), store, 3)
    IS.add_changes(M.expiry_changes(IS.merged(spark, store), m.feeds, AS_OF), store, 4)
    assert rows(IS.merged(spark, store)) == rows(want)
    new = IS.compact(spark, store, f"t{uuid.uuid4().hex}", str(tmp_path / "compacted"))
    assert rows(IS.merged(spark, new)) == rows(want) and spark.table(new.changes).isEmpty()


def test_dedupe_of_one_feed(spark, m, store):
    IS.add_changes(M.dedupe_changes(m.items, 3), store, 1)
    assert rows(IS.merged(spark, store)) == rows(M.dedupe(m.items, 3))


def test_text_is_not_shuffled(spark, m, store, tmp_path):
    IS.add_changes(M.rating_changes(m.rating_events), store, 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = IS.merged(spark, store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "item_content" in plan
    changes = M.dedupe_changes(IS.merged(spark, store), 3)._jdf.queryExecution().executedPlan().toString()
    assert "item_content" not in changes


def test_only_changed_rows_are_written(spark, store, tmp_path):
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}
    IS.add_changes(spark.createDataFrame([(5, 1), (7, -1)], "item_uid long, item_rating int"), store, 1)
    IS.add_changes(spark.createDataFrame([(5, True)], "item_uid long, cleared boolean"), store, 2)
    IS.add_changes(spark.createDataFrame([(5, -1)], "item_uid long, item_rating int"), store, 3)
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    assert spark.table(store.changes).count() == 4
    got = {r["item_uid"]: (r["item_rating"], r["item_content"]) for r in IS.merged(spark, store).where("item_uid IN (5, 7)").collect()}
    assert got[5] == (-1, "") and got[7][0] == -1 and got[7][1]


def test_attached_from_files(spark, store):
    IS.add_changes(spark.createDataFrame([(5, True)], "item_uid long, deleted boolean"), store, 1)
    want = rows(IS.merged(spark, store))
    for table in (store.items, store.changes):
        spark.sql(f"DROP TABLE {table}")
    again = IS.attach(spark, store.name, store.path, store.buckets)
    assert rows(IS.merged(spark, again)) == want
    assert IS.merged(spark, again).where(F.col("item_uid") == 5).isEmpty()


def test_verdicts_of_rules(spark, m, tmp_path):
    from feedloom.operators import rules as R

    unread = m.items.withColumns({"item_rating": F.lit(0), "item_rule_uid": F.lit(None).cast("long")})
    store = IS.create(unread, f"t{uuid.uuid4().hex}", str(tmp_path / "store"), buckets=4)
    first = R.first_rule(R.match_tag(R.scope_keys(unread, m.feeds), m.tags, m.rules).unionByName(
        R.match_exactword(R.item_words(R.scope_keys(unread, m.feeds)), m.rules)))
    IS.add_changes(R.verdict_changes(first), store, 1)
    want = R.rate(unread, first).drop("feed_filter_hit")
    assert rows(IS.merged(spark, store).select(*want.columns)) == rows(want)
