"""Ingest: from normalised feed entries to new items, tags and counters."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.html import md5_hex
from feedloom.functions.scalars import as_of_column
from feedloom.operators.links import rewrite_links
from feedloom.operators.ordered import number_rows
from feedloom.operators.rules import first_rule, match_rules, rate
from feedloom.operators.sizing import broadcast_if_small
from feedloom.operators.stats import ingest_counts
from feedloom.schema import TAG_BY_FEED, UNREAD
from feedloom.session import TEXT, durable


class Ingested(NamedTuple):
    new_items: DataFrame
    new_tags: DataFrame
    counters: DataFrame
    feeds: DataFrame


def first_guid(entries: DataFrame) -> DataFrame:
    """One entry per (feed, GUID): the one nearest the end of its document.

    The winner is found on (feed, guid, position) alone, with partial
    aggregation; the entries then join on all three, which spreads a GUID
    however often it is repeated.
    """
    last = entries.groupBy("feed_uid", "guid").agg(F.max("position").alias("position"))
    same = (
        (entries.feed_uid == last.feed_uid)
        & (entries.position == last.position)
        & entries.guid.eqNullSafe(last.guid)
    )
    return entries.join(last, same, "left_semi")


#: Kinds of keys by which an entry can be held already: its column and that of stored items.
KEY_KINDS = {"guid": "item_guid", "title": "item_title", "link": "item_link"}


def _key_rows(rows: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """(kept columns, kind, key): a row for each key that isn't null; ``columns`` maps kinds to columns."""
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key")) for kind, column in columns.items()])
    return rows.select(*keep, F.explode(keys).alias("k")).select(*keep, "k.kind", "k.key").where(F.col("key").isNotNull())


def held_entries(entries: DataFrame, items: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(feed_uid, position, kind): entries of which some item of the feed has the key of this kind. Nulls match nothing.

    One scan of the stored items for all kinds, reduced at once by the batch's keys: while these are small, and broadcast,
    nothing of the stored side is shuffled. Only keys move, no text.
    """
    own = durable(_key_rows(entries, {k: k for k in kinds}, "feed_uid", "position"))
    keys = ["feed_uid", "kind", "key"]
    stored = _key_rows(
        items.withColumn("feed_uid", F.col("item_feed_uid")), {k: KEY_KINDS[k] for k in kinds}, "feed_uid"
    )
    held = stored.join(broadcast_if_small(own.select(*keys).distinct()), keys, "left_semi").distinct()
    return own.join(broadcast_if_small(held), keys, "left_semi").select("feed_uid", "position", "kind")


def _without(entries: DataFrame, places: DataFrame) -> DataFrame:
    return entries.join(broadcast_if_small(places.select("feed_uid", "position").distinct()), ["feed_uid", "position"], "left_anti")


def unseen(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Entries whose (feed, GUID) is not stored yet. Stored items never change."""
    return _without(entries, held_entries(entries, items, ("guid",)))


def drop_stored_dups(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Drop entries that share title or link with a stored item of the feed."""
    return _without(entries, held_entries(entries, items, ("title", "link")))


#: Rounds by heads before the rest is taken for chains.
HEAD_ROUNDS = 3


def drop_batch_dups(entries: DataFrame) -> DataFrame:
    """Drop entries that share title or link with an *accepted* earlier entry of the feed.

    Later positions are processed first. Whether an entry is accepted depends on the entries before it, so the batch
    is decided in rounds: whoever has no undecided predecessor sharing its title or link is accepted, whoever
    shares with an accepted predecessor is rejected. A group of copies, of whatever size, is decided in one round, and no
    group is ever collected. What a few rounds leave are chains, in which each entry waits for the one before it; those are
    decided by pointer doubling (:func:`_mark_chains`), in as many rounds as the chain's length has binary digits.
    ``final_link`` (default: the link) is what an accepted entry is stored under.
    """
    final = F.col("final_link") if "final_link" in entries.columns else F.col("link")
    # Written, or the groupings below would run the checks before it again.
    state = durable(entries.select("feed_uid", (-F.col("position")).alias("ord"), "title", "link", final.alias("final")))
    # Only entries that can be rejected, or have others rejected, take part: those with a key that several have.
    keys = _key_rows(state, {"t": "title", "l": "link", "f": "final"}, "feed_uid", "ord").withColumn(
        "kind", F.when(F.col("kind") == "t", "t").otherwise("l")
    )
    shared = keys.groupBy("feed_uid", "kind", "key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi")
    contested = keys.join(broadcast_if_small(shared.select("feed_uid", "kind", "key")), ["feed_uid", "kind", "key"], "left_semi")
    undecided = durable(state.join(broadcast_if_small(contested.select("feed_uid", "ord").distinct()), ["feed_uid", "ord"], "left_semi"))
    firsts = _firsts(undecided)
    copies = undecided.join(broadcast_if_small(firsts.select("feed_uid", "ord")), ["feed_uid", "ord"], "left_anti")
    rejected = [copies.select("feed_uid", (-F.col("ord")).alias("position"))]
    undecided, turn = durable(firsts), 0
    while not undecided.isEmpty():
        turn += 1
        mark = _mark_chains if turn > HEAD_ROUNDS and turn % 2 == 0 else _mark_round
        marked = durable(mark(undecided))
        rejected.append(marked.where("verdict = 'rejected'").select("feed_uid", (-F.col("ord")).alias("position")))
        undecided = marked.where("verdict IS NULL").drop("verdict")
    return _without(entries, reduce(DataFrame.unionByName, rejected))


def _firsts(undecided: DataFrame) -> DataFrame:
    """The first of each group of entries alike in title, link and stored link, where the others are rejected in any case.

    If the first is accepted they share with it; if it is rejected, whatever it shares with is earlier than they are, too.
    """
    clash = F.col("title").isNotNull() | F.coalesce(F.col("link") == F.col("final"), F.lit(False))
    first = undecided.where(clash).groupBy("feed_uid", "title", "link", "final").agg(F.min("ord").alias("ord"))
    return first.select(*undecided.columns).unionByName(undecided.where(~clash))


def _earliest(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Lowest ``ord`` per (feed, title) and per (feed, stored link)."""
    titles = rows.where("title IS NOT NULL").groupBy("feed_uid", "title").agg(F.min("ord").alias(f"{name}_t"))
    links = rows.where("final IS NOT NULL").groupBy("feed_uid", F.col("final").alias("link")).agg(
        F.min("ord").alias(f"{name}_l")
    )
    return titles, links


def _with_earliest(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    titles, links = _earliest(others, name)
    return rows.join(titles, ["feed_uid", "title"], "left").join(links, ["feed_uid", "link"], "left")


def _beaten(name: str) -> Column:
    return F.coalesce(F.least(f"{name}_t", f"{name}_l") < F.col("ord"), F.lit(False))


def _mark_round(undecided: DataFrame) -> DataFrame:
    """Adds the ``verdict`` of entries at the head of both their groups, and of those that share with such a head."""
    # An entry at the head of both its groups has nobody before it.
    seen = _with_earliest(undecided, undecided, "u").select(*undecided.columns, (~_beaten("u")).alias("head"))
    return _with_earliest(seen, seen.where("head"), "a").select(
        *undecided.columns,
        F.when(F.col("head"), "accepted").when(_beaten("a"), "rejected").alias("verdict"),
    )


def _mark_chains(undecided: DataFrame) -> DataFrame:
    """Adds the ``verdict`` of entries on chains that begin with a head.

    An entry that waits for exactly one other is accepted if that one is rejected, and the other way round. It
    points to it; every round lets pointers skip as far again, counting steps, until they end at entries that wait for none or
    for several. Of a head's chain every other entry is accepted. The rest is left to the next round.
    """
    before = _predecessors(undecided)
    several = F.col("n") > 1
    nodes = durable(undecided.join(before, ["feed_uid", "ord"], "left").select(
        "feed_uid", "ord", F.when(several | F.col("n").isNull(), F.col("ord")).otherwise(F.col("only")).alias("to"),
        F.when(several | F.col("n").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"),
        F.col("n").isNull().alias("head"),
    ))
    while True:
        ends = nodes.select("feed_uid", F.col("ord").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("head").alias("end"))
        moved = durable(nodes.join(ends, ["feed_uid", "to"]).select(
            "feed_uid", "ord", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), "head",
            "end", (F.col("more") > 0).alias("moving"),
        ))
        nodes = moved.drop("end", "moving")
        if moved.where("moving").isEmpty():
            break
    verdicts = moved.select("feed_uid", "ord", F.when(F.col("end"), F.when(F.col("steps") % 2 == 0, "accepted").otherwise("rejected")).alias("verdict"))
    marked = undecided.join(verdicts, ["feed_uid", "ord"])
    # Entries off the chains that share with an accepted one before them.
    return _with_earliest(marked, marked.where("verdict = 'accepted'"), "a").select(
        *undecided.columns, F.coalesce("verdict", F.when(_beaten("a"), "rejected")).alias("verdict")
    )


def _predecessors(undecided: DataFrame) -> DataFrame:
    """(feed_uid, ord, n, only): how many earlier undecided entries one waits for, and which one if it is one.

    Of a group only the first and the second entry can wait for one other in it; whoever comes later has at least two before it.
    """
    def group(column: str, key: str, name: str) -> DataFrame:
        own = undecided.where(F.col(column).isNotNull())
        first = own.groupBy("feed_uid", F.col(column).alias(key)).agg(F.min("ord").alias(f"{name}1"))
        later = own.withColumn(key, F.col(column)).join(first, ["feed_uid", key]).where(F.col("ord") > F.col(f"{name}1"))
        second = later.groupBy("feed_uid", key).agg(F.min("ord").alias(f"{name}2"))
        return first.join(second, ["feed_uid", key], "left")

    def earlier(name: str) -> Column:
        ord_ = F.col("ord")
        return F.array_compact(F.array(*[F.when(F.col(f"{name}{i}") < ord_, F.col(f"{name}{i}")) for i in (1, 2)]))

    found = (
        undecided.select("feed_uid", "ord", "title", "link")
        .join(group("title", "title", "t"), ["feed_uid", "title"], "left")
        .join(group("final", "link", "l"), ["feed_uid", "link"], "left")
        .withColumn("all", F.array_distinct(F.concat(earlier("t"), earlier("l"))))
    )
    return found.where(F.size("all") > 0).select("feed_uid", "ord", F.size("all").alias("n"), F.array_min("all").alias("only"))


def drop_title_link_dups(entries: DataFrame, items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Title / link duplicate check, for the feeds that ask for it."""
    checked = _flagged(entries, feeds)
    inside, outside = checked.where("__checked").drop("__checked"), checked.where("NOT __checked").drop("__checked")
    return drop_batch_dups(drop_stored_dups(inside, items)).unionByName(outside)


def _flagged(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Adds ``__checked``: the feed asks for the title and link check."""
    asked = feeds.where(F.col("feed_dupcheck")).select("feed_uid", F.lit(True).alias("__checked"))
    return entries.join(asked, "feed_uid", "left").withColumn("__checked", F.coalesce("__checked", F.lit(False)))


def oldest(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Oldest item still in each feed document.

    A feed that dates none of its entries takes the oldest of those already
    stored; a feed without either is left out.
    """
    dated = entries.groupBy("feed_uid").agg(F.min("created").alias("oldest"))
    undated = dated.where(F.col("oldest").isNull()).select("feed_uid")
    stored = items.select(
        F.col("item_feed_uid").alias("feed_uid"), F.col("item_guid").alias("guid"), "item_created"
    ).join(undated, "feed_uid", "left_semi")
    listed = entries.join(undated, "feed_uid", "left_semi").select("feed_uid", "guid").distinct()
    fallback = stored.join(listed, ["feed_uid", "guid"], "left_semi").groupBy("feed_uid").agg(
        F.min("item_created").alias("stored_oldest")
    )
    return (
        dated.join(fallback, "feed_uid", "left")
        .select("feed_uid", F.coalesce("oldest", "stored_oldest").alias("oldest"))
        .where(F.col("oldest").isNotNull())
    )


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags plus the new ones; a tag an item already has is ignored."""
    keys = ["tag_item_uid", "tag_name", "tag_by"]
    return tags.unionByName(new.select(*keys).distinct().join(tags.select(*keys), keys, "left_anti"))


def accepted_entries(
    entries: DataFrame, items: DataFrame, feeds: DataFrame, redirects: DataFrame | None = None
) -> DataFrame:
    """The entries an ingest stores, ``final_link`` included.

    Runts never block a later entry, so they may go before the batch check.
    """
    once = _flagged(first_guid(entries).where(~F.coalesce("runt", F.lit(False))), feeds)
    once = durable(once.withColumn("final_link", F.col("link")))
    held = held_entries(once, items, ("guid", "title", "link")).join(
        once.select("feed_uid", "position", "__checked"), ["feed_uid", "position"]
    )
    fresh = _without(once, held.where("kind = 'guid' OR __checked"))
    if redirects is not None:
        fresh = rewrite_links(fresh, redirects, "final_link")
    # Written: the checked part is read several times.
    fresh = durable(fresh)
    inside, outside = (fresh.where(test).drop("__checked") for test in ("__checked", "NOT __checked"))
    return drop_batch_dups(inside).unionByName(outside)


def ingest(
    entries: DataFrame,
    items: DataFrame,
    feeds: DataFrame,
    rules: DataFrame,
    as_of,
    redirects: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> Ingested:
    """One refresh: what to append to items and tags, the counters, and the feeds.

    ``redirects`` (url, final_url) and ``pages`` (url, html) are optional.
    Item ids continue from the highest stored one in feed and processing
    order. Running the same batch again adds nothing.
    """
    now = as_of_column(as_of)
    # Everything up to acceptance works on keys and titles; the text joins the
    # accepted entries once, on a key that is unique.
    keys = ("feed_uid", "position", "guid", "link", "title", "runt")
    accepted = durable(
        accepted_entries(entries.select(*keys), items, feeds, redirects).select("feed_uid", "position", "final_link")
    )
    base = F.lit(items.agg(F.coalesce(F.max("item_uid"), F.lit(-1)).alias("m")).first()["m"])
    numbered = number_rows(
        accepted.select("feed_uid", (-F.col("position")).alias("ord"), "final_link"), "feed_uid", "ord"
    ).select(
        "feed_uid", (-F.col("ord")).alias("position"), "final_link", (base + F.col("row_number")).alias("item_uid")
    )
    keyed = durable(entries.join(numbered, ["feed_uid", "position"]), **TEXT)
    rows = keyed.select(
        "item_uid",
        F.col("feed_uid").alias("item_feed_uid"),
        F.col("guid").alias("item_guid"),
        F.col("final_link").alias("item_link"),
        F.col("link").alias("entry_link"),
        F.col("title").alias("item_title"),
        F.col("content").alias("item_content"),
        md5_hex(F.col("content")).alias("item_md5hex"),
        F.col("author").alias("item_creator"),
        now.alias("item_loaded"),
        F.coalesce("created", now).alias("item_created"),
        F.col("modified").alias("item_modified"),
        F.lit(None).cast("timestamp").alias("item_rated"),
        now.alias("updated"),
        F.lit(UNREAD).alias("item_rating"),
        F.lit(None).cast("long").alias("item_rule_uid"),
        F.lit(None).cast("string").alias("item_rule_side"),
    )
    new_tags = keyed.select(
        F.col("item_uid").alias("tag_item_uid"),
        F.explode(F.array_distinct("tags")).alias("tag_name"),
        F.lit(TAG_BY_FEED).alias("tag_by"),
    )
    # Rules see the link as the feed gave it.
    judged = rows.withColumn("item_link", F.col("entry_link")).drop("entry_link")
    links = items.select(F.col("item_link").alias("link"))
    verdicts = first_rule(match_rules(judged, feeds, rules, new_tags, as_of, links, pages))
    new_items = rate(rows.drop("entry_link"), verdicts)
    dates = oldest(entries, items)
    feeds2 = feeds.join(dates, "feed_uid", "left").withColumn(
        "feed_oldest", F.coalesce("oldest", "feed_oldest")
    ).select(*feeds.columns)
    return Ingested(new_items, new_tags, ingest_counts(new_items), feeds2)
