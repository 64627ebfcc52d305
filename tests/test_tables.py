"""Order-dependent and maintenance operators against brute force."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from feedloom.operators import ingest as G
from feedloom.operators import links as L
from feedloom.operators import maintain as M
from feedloom.operators import rules as R
from feedloom.operators import stats as A
from feedloom.operators.ordered import failure_runs, number_rows
from feedloom.operators.sizing import broadcast_if_small
from feedloom.plans.model import AS_OF
from feedloom.streaming import incremental as I


def greedy(rows):
    """Accepted positions, one entry after the other."""
    accepted, titles, links = set(), set(), set()
    for feed, position, title, link, final in sorted(rows, key=lambda r: (r[0], -r[1])):
        if (title is not None and (feed, title) in titles) or (link is not None and (feed, link) in links):
            continue
        accepted.add((feed, position))
        titles.add((feed, title))
        links.add((feed, final))
    return accepted


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_dups_match_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(400):
        # A third of all entries share one title in one feed.
        feed = 1 if rng.random() < 0.6 else rng.randrange(2, 5)
        title = "hot" if rng.random() < 0.33 else rng.choice([None] + [f"t{i}" for i in range(40)])
        link = rng.choice([None] + [f"l{i}" for i in range(60)])
        final = link if rng.random() < 0.7 else f"l{rng.randrange(60)}"
        rows.append((feed, p, title, link, final))
    df = spark.createDataFrame(rows, "feed_uid long, position long, title string, link string, final_link string")
    got = {(r["feed_uid"], r["position"]) for r in G.drop_batch_dups(df).collect()}
    assert got == greedy(rows)


def test_batch_dups_long_chain(spark):
    """Each entry shares with the one before it: accepted and rejected take turns."""
    rows = [(1, 100 - i, f"t{i // 2}", f"l{(i + 1) // 2}", f"l{(i + 1) // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "feed_uid long, position long, title string, link string, final_link string")
    assert {(r["feed_uid"], r["position"]) for r in G.drop_batch_dups(df).collect()} == greedy(rows)


def test_batch_dups_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000, some of it with copies and branches, is decided in at most 20 rounds."""
    rows = [(1, 100_000 - 3 * i, f"t{i // 2}", f"l{(i + 1) // 2}", f"l{(i + 1) // 2}") for i in range(10_000)]
    rows += [(f, p - 1, t, link, final) for f, p, t, link, final in rows[::7]]
    rows += [(1, -i, f"t{i * 50}", f"own{i}", f"own{i}") for i in range(100)]
    rounds = []
    for name in ("_mark_round", "_predecessors"):
        monkeypatch.setattr(G, name, lambda x, f=getattr(G, name): (rounds.append(1), f(x))[1])
    kept = G.durable
    monkeypatch.setattr(G, "durable", lambda df: (rounds.append("moving" in df.columns), kept(df))[1])
    df = spark.createDataFrame(rows, "feed_uid long, position long, title string, link string, final_link string")
    assert {(r["feed_uid"], r["position"]) for r in G.drop_batch_dups(df).collect()} == greedy(rows)
    assert sum(rounds) <= 20


def test_batch_without_dups(spark):
    rows = [(1, i, f"t{i}", None, f"l{i}") for i in range(5)] + [(2, 1, None, None, None), (2, 2, None, None, None)]
    df = spark.createDataFrame(rows, "feed_uid long, position long, title string, link string, final_link string")
    assert G.drop_batch_dups(df).count() == 7


def test_stored_keys_in_one_scan(spark):
    entries = spark.createDataFrame([(1, 1, "g", "a", "x"), (1, 2, "h", "b", "y"), (1, 3, "i", None, None), (2, 4, "g", "a", "x")],
                                    "feed_uid long, position long, guid string, title string, link string")
    items = spark.createDataFrame([(1, "g", "b", "z"), (1, None, None, None), (3, "g", "a", "x"), (2, "q", "q", "x")],
                                  "item_feed_uid long, item_guid string, item_title string, item_link string")
    held = G.held_entries(entries, items, ("guid", "title", "link"))
    assert sorted(map(tuple, held.collect())) == [(1, 1, "guid"), (1, 2, "title"), (2, 4, "link")]
    assert sorted(r["position"] for r in G.unseen(entries, items).collect()) == [2, 3, 4]
    assert sorted(r["position"] for r in G.drop_stored_dups(entries, items).collect()) == [1, 3]


@pytest.mark.parametrize("seed", [5, 6])
def test_link_seen_is_bisect(spark, seed):
    rng = random.Random(seed)
    url = lambda: "http://h/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(0, 6)))
    stored = sorted({url() for _ in range(60)} | {"zz?u=http://h/q"})
    probes = {url() for _ in range(80)} | {"http://h/q", "zzz"}
    expected = {p for p in probes if (i := bisect.bisect_left(stored, p)) < len(stored) and p in stored[i]}
    got = L.link_seen(spark.createDataFrame([(p,) for p in probes], "url string"),
                      spark.createDataFrame([(s,) for s in stored], "link string"))
    assert {r["url"] for r in got.collect()} == expected


def test_failure_runs_with_a_hot_feed(spark):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 6), i // 3, i, rng.random() < 0.2) for i in range(900)]
    expected, run = {}, {}
    for feed, ts, seq, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        run[feed] = 0 if ok else run.get(feed, 0) + 1
        expected[feed, seq] = run[feed]
    df = spark.createDataFrame(rows, "feed_uid long, ts long, seq long, ok boolean")
    assert {(r["feed_uid"], r["seq"]): r["failures"] for r in failure_runs(df).collect()} == expected


def test_number_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = [(r["k"], r["v"], r["row_number"]) for r in number_rows(df, "k", F.desc("v")).orderBy("row_number").collect()]
    want = sorted(((i % 3, i) for i in range(500)), key=lambda r: (r[0], -r[1]))
    assert got == [(k, v, n + 1) for n, (k, v) in enumerate(want)]


def test_resolve_guid(spark):
    rows = [  # uid, feed, guid, link
        (1, 1, "a", "a"), (2, 1, "b", "a"),               # the second goes, its GUID moves
        (3, 1, "x", "p"), (4, 1, "y", "p"),               # both differ: the first goes
        (5, 2, "q", "q"), (6, 2, "q2", "q2"),             # no pair
        (7, 3, "m", "z"), (8, 3, "n", "z"), (9, 3, "o", "z"),  # three: reported
        (10, 4, "a", "a"), (11, 4, "r", None),
    ]
    items, report = L.resolve_guid(spark.createDataFrame(rows, "item_uid long, item_feed_uid long, item_guid string, item_link string"))
    assert {r["item_uid"]: r["item_guid"] for r in items.collect()} == {
        1: "b", 4: "x", 5: "q", 6: "q2", 7: "m", 8: "n", 9: "o", 10: "a", 11: "r"}
    assert [(r["item_feed_uid"], r["item_link"], r["n"]) for r in report.collect()] == [(3, "z", 3)]


def test_ingest_twice_adds_nothing(spark, m):
    first = G.ingest(m.entries, m.stored, m.feeds, m.rules, AS_OF)
    assert first.new_items.count() > 0
    items = m.stored.unionByName(first.new_items.select(*m.stored.columns))
    # Entries rejected as duplicates stay rejected: what blocked them is stored now.
    assert G.accepted_entries(m.entries, items, m.feeds).count() == 0
    uids = [r["item_uid"] for r in first.new_items.select("item_uid").collect()]
    assert len(uids) == len(set(uids)) and min(uids) > m.stored.agg(F.max("item_uid").alias("x")).first()["x"]
    totals = first.counters.agg(F.sum("num_added").alias("a"), F.sum("num_filtered").alias("f")).first()
    assert totals["a"] + totals["f"] == len(uids)


def test_ingest_links_and_oldest(spark, m):
    redirects = spark.createDataFrame([("http://l/1", "http://final/1")], "url string, final_url string")
    entries = spark.createDataFrame(
        [(1, 5, "g1", "http://l/1", "one", "c", "Unknown", "2024-01-01 00:00:00", None, ["x", "x", "y"], False),
         (1, 4, "g2", "http://final/1", "two", "c", "Unknown", "2024-01-02 00:00:00", None, [], False),
         (1, 3, "g3", "http://l/3", "three", "", "Unknown", "2023-12-02 00:00:00", None, [], True)],
        "feed_uid long, position long, guid string, link string, title string, content string, author string, "
        "created string, modified timestamp, tags array<string>, runt boolean",
    ).withColumn("created", F.col("created").cast("timestamp"))
    done = G.ingest(entries, m.items.limit(0), m.feeds, m.rules.limit(0), AS_OF, redirects)
    # The second entry's link is what the first one was stored under; the third is a runt.
    assert [(r["item_guid"], r["item_link"]) for r in done.new_items.collect()] == [("g1", "http://final/1")]
    assert sorted(r["tag_name"] for r in done.new_tags.collect()) == ["x", "y"]
    oldest = {r["feed_uid"]: r["feed_oldest"] for r in done.feeds.collect()}
    assert str(oldest[1]) == "2023-12-02 00:00:00"


def test_statistics_kept_equal_statistics_rebuilt(m):
    new = M.dedupe(M.apply_ratings(m.items, m.rating_events)).where("item_uid % 10 <> 3")
    kept = I.merge_stats(A.feed_stats(m.items.where("item_uid % 7 <> 2"), AS_OF), I.item_changes(m.items.where("item_uid % 7 <> 2"), new))
    columns = ["feed_uid", "interesting", "unread", "uninteresting", "filtered", "total"]
    rebuilt = A.rating_counts(new).select(*columns)
    # Feeds that lost all their articles stay, with zeros.
    assert kept.where("total > 0").select(*columns).exceptAll(rebuilt).count() == 0
    assert rebuilt.count() == kept.where("total > 0").count() == kept.count() - 2


def test_new_and_gone_feeds(spark, m):
    stats = A.feed_stats(m.items, AS_OF)
    none = I.item_changes(m.items, m.items)
    new = spark.createDataFrame([(999,)], "feed_uid long")
    out = I.merge_stats(stats, none, new_feeds=new, gone_feeds=m.feeds.where("feed_uid = 3"))
    ids = {r["feed_uid"]: r["total"] for r in out.collect()}
    assert ids[999] == 0 and 3 not in ids


def test_dedupe_and_cleanup_properties(m):
    once = M.dedupe(m.items)
    assert M.dedupe(once).exceptAll(once).count() == 0
    left, tags = M.cleanup(m.items, m.feeds, m.tags, AS_OF)
    lost = m.items.join(left, "item_uid", "left_anti")
    assert lost.where("item_rating >= 0").count() == 0 and lost.count() > 0
    assert M.orphan_tags(tags, left).count() == 0


def test_null_titles_are_no_duplicates(spark):
    items = spark.createDataFrame([(1, 1, None, 0), (2, 1, None, 0), (3, 1, "a", 0), (4, 1, "a", 1)],
                                  "item_uid long, item_feed_uid long, item_title string, item_rating int")
    assert {r["item_uid"]: r["item_rating"] for r in M.dedupe(items).collect()} == {1: 0, 2: 0, 3: -1, 4: 1}
    assert M.dedupe_count(items).first()["modified"] == 1
    assert {r["item_uid"]: r["copies"] for r in M.title_dup_count(items).collect()} == {1: 0, 2: 0, 3: 2, 4: 2}


def test_change_feed_url(m):
    other = m.feeds.where("feed_uid = 2").first()["feed_xml"]
    with pytest.raises(ValueError):
        M.change_feed_url(m.feeds, m.items, m.rules, m.entries, 11, other, AS_OF)
    moved, done = M.change_feed_url(m.feeds, m.items, m.rules, m.entries, 11, "http://new/feed", AS_OF)
    row = moved.where("feed_uid = 11").first()
    assert (row["feed_xml"], row["feed_status"], row["feed_errors"]) == ("http://new/feed", 0, 0)
    assert done.new_items.count() == 0  # all of its articles are stored


def test_apply_fetch_log(m):
    after = {r["feed_uid"]: r for r in M.apply_fetch_log(m.feeds, m.fetch_log, 5).collect()}
    runs = {r["feed_uid"]: r for r in M.error_runs(m.fetch_log, m.feeds, 5).collect()}
    assert any(r["suspended"] for r in runs.values())
    for uid, run in runs.items():
        if uid in after:
            assert after[uid]["feed_errors"] == run["feed_errors"]
            assert not run["suspended"] or after[uid]["feed_status"] == 1


def test_large_tables_are_not_broadcast(spark):
    df = spark.range(1000).withColumn("s", F.lit("x" * 50))
    small = broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    large = broadcast_if_small(df, limit=1000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in small and "ResolvedHint" not in large


# ------------------------------------------------------------------ rules

RULE_SCHEMA = "rule_uid long, rule_type string, rule_feed_uid long, rule_expires timestamp, rule_text string"


@pytest.fixture(scope="module")
def small(spark, m):
    items = spark.createDataFrame(
        [(1, 1, "Clouds over Oracle", "The runner was running", "Unknown", "http://a/1"),
         (2, 1, "Café notes", "nothing here", "Jane", "http://a/2"),
         (3, 5, "Clouds again", "exempt feed", "Jane", "http://a/3")],
        "item_uid long, item_feed_uid long, item_title string, item_content string, item_creator string, item_link string")
    items = items.withColumns({"item_guid": F.col("item_link"), "item_rating": F.lit(0), "item_rule_uid": F.lit(None).cast("long"),
                               "item_rule_side": F.lit(None).cast("string")})
    tags = spark.createDataFrame([(1, "it", 0), (3, "it", 0)], "tag_item_uid long, tag_name string, tag_by int")
    return items, m.feeds.withColumn("feed_filter", F.lit(None).cast("string")), tags


def verdict(spark, small, rules):
    items, feeds, tags = small
    df = spark.createDataFrame(rules, RULE_SCHEMA)
    matches = R.match_rules(items, feeds, df, tags, AS_OF)
    return {r["item_uid"]: (r["rule_uid"], r["side"]) for r in R.first_rule(matches).collect()}


@pytest.mark.parametrize("rules,expected", [
    ([(1, "title_word", None, None, "cloud")], {1: (1, "title")}),
    ([(1, "title_exactword", None, None, "cloud")], {}),
    ([(1, "title_exactword", None, None, "CAFE")], {2: (1, "title")}),
    ([(1, "content_all", None, None, "run the")], {1: (1, "content")}),
    ([(1, "content_all", None, None, "run missing")], {}),
    ([(1, "title_all", None, None, "")], {1: (1, "title"), 2: (1, "title")}),
    ([(1, "title_all", 5, None, "")], {3: (1, "title")}),
    ([(1, "union_word", None, None, "oracle nothing")], {1: (1, "title"), 2: (1, "content")}),
    ([(1, "title_phrase", None, None, "uds ov")], {1: (1, "title")}),
    ([(1, "title_phrase", None, None, "cafe")], {}),
    ([(1, "title_phrase_lc", None, None, "café n")], {2: (1, "title")}),
    ([(1, "tag", None, None, "IT")], {1: (1, None)}),
    ([(1, "author", None, None, "jane")], {2: (1, None)}),
    ([(1, "author", 5, None, "jane")], {3: (1, None)}),
    ([(1, "python", None, None, "length(title) = 10")], {2: (1, None)}),
    ([(1, "python", None, None, "1 / 0 > 0"), (2, "python", None, None, "syntax error here (")], {}),
    ([(3, "title_word", None, None, "cloud"), (2, "title_word", 1, None, "cloud")], {1: (3, "title")}),
    ([(7, "title_word", None, None, "cloud"), (4, "tag", None, None, "it")], {1: (4, None)}),
])
def test_rules(spark, small, rules, expected):
    assert verdict(spark, small, rules) == expected


def test_expired_rules(spark, small):
    past = [(1, "title_word", None, "2020-01-01 00:00:00", "cloud"), (2, "title_word", None, "2030-01-01 00:00:00", "oracle")]
    df = spark.createDataFrame(past, RULE_SCHEMA.replace("rule_expires timestamp", "rule_expires string")).withColumn(
        "rule_expires", F.col("rule_expires").cast("timestamp"))
    items, feeds, tags = small
    assert [r["rule_uid"] for r in R.first_rule(R.match_rules(items, feeds, df, tags, AS_OF)).collect()] == [2]


def test_several_phrases(spark, small):
    rules = [(i, "union_phrase", None, None, t) for i, t in enumerate(("Oracle", "Café", "nothing", "absent", "runn"), 1)]
    assert verdict(spark, small, rules) == {1: (1, "title"), 2: (2, "title")}


def test_feed_filter_comes_last(spark, small):
    items, feeds, tags = small
    feeds = feeds.withColumn("feed_filter", F.when(F.col("feed_uid") == 1, F.lit("length(content) > 0")))
    rules = spark.createDataFrame([(9, "author", 1, None, "jane")], RULE_SCHEMA)
    got = {r["item_uid"]: (r["rule_uid"], r["feed_filter_hit"])
           for r in R.first_rule(R.match_rules(items, feeds, rules, tags, AS_OF)).collect()}
    assert got == {1: (0, True), 2: (9, False)}


def test_highlight(spark, small):
    items, feeds, tags = small
    rules = spark.createDataFrame([
        (1, "union_word", None, None, "oracle nothing"), (2, "author", None, None, "jane"), (3, "title_phrase", None, None, "$&")], RULE_SCHEMA)
    rated = R.rate(items, R.first_rule(R.match_rules(items, feeds, rules, tags, AS_OF)))
    rows = {r["item_uid"]: r for r in R.highlight(rated, rules).collect()}
    span = '<span class="filter-highlight">'
    assert rows[1]["item_title"] == f"Clouds over {span}Oracle</span>"
    assert rows[2]["item_content"] == f"{span}nothing</span> here"
    assert rows[3]["item_content"] == "exempt feed"


def expression(spark, text, title="He runs home", tags=("it", "net")):
    items = spark.createDataFrame(
        [(1, 7, title, "some content", "http://a/", "g", "me")],
        "item_uid long, item_feed_uid long, item_title string, item_content string, item_link string, item_guid string, item_creator string")
    feeds = spark.createDataFrame([(7, False, "A feed")], "feed_uid long, feed_exempt boolean, feed_title string")
    rules = spark.createDataFrame(
        [(1, "python", None, text), (2, "python", None, "length(title) > 3")], "rule_uid long, rule_type string, rule_feed_uid long, rule_text string")
    owned = spark.createDataFrame([(1, t) for t in tags], "tag_item_uid long, tag_name string")
    found = {r["rule_uid"] for r in R.match_expr(R.scope_keys(items, feeds), feeds, rules, tags=owned).collect()}
    assert 2 in found  # a bad rule hurts no other
    return 1 in found


@pytest.mark.parametrize("text", [
    "title rlike '('", "raise_error('x') is null", "count(1) > 0", "explode(array(1, 2)) = 1", "row_number() over (order by title) > 0",
    "title rlike author", "(select max(1)) = 1", "assert_true(false) is null", "rand() < 2", "cast(title as int) > 0", "nothing = 1", "title >",
])
def test_rules_that_never_match(spark, text):
    assert not expression(spark, text)


@pytest.mark.parametrize("text", [
    "array_contains(category, 'it')", "item_tags = array('it', 'net')", "any_word(title_words, array('run'))",
    "any_word(title_words_exact, array('runs')) and not any_word(title_words_exact, array('run'))",
    "any_word(union_words, array('content'))", "title rlike '^He r.ns'", "feed_title = 'A feed'",
])
def test_rules_that_match(spark, text):
    assert expression(spark, text)


def test_check_of_rules_before_storing(spark):
    items = spark.createDataFrame([], "item_uid long, item_title string, item_content string, item_link string, item_guid string, item_creator string")
    rules = spark.createDataFrame(
        [(1, "python", "title rlike '('"), (2, "python", "# a note\ntitle = 'x'"), (3, "title_word", "(")], "rule_uid long, rule_type string, rule_text string")
    assert [r["rule_uid"] for r in R.check_rules(rules, R.with_rule_fields(items)).collect()] == [1]


@pytest.mark.parametrize("kind, text, html, want", [
    ("content_word", "running", "<p>He runs home</p>", "<p>He [runs] home</p>"),
    ("content_word", "cloud", '<a href="http://cloud.com/">The Clouds</a>', '<a href="http://cloud.com/">The [Clouds]</a>'),
    ("content_exactword", "art", "smart artful art", "smart artful [art]"),
    ("content_all", "happy class", "Classes of happiness", "[Classes] of [happiness]"),
    ("content_word", "span", "a span of spanning", "a [span] of spanning"),
    ("content_phrase", "a b", '<i title="a b">a b</i>', '<i title="a b">[a b]</i>'),
    ("content_exactword", "cafe", "Le CAFÉ noir", "Le [CAFÉ] noir"),
])
def test_highlight_outside_tags_on_words(spark, kind, text, html, want):
    view = spark.createDataFrame(
        [(1, "t", html, -2, 9, "content")],
        "item_uid long, item_title string, item_content string, item_rating int, item_rule_uid long, item_rule_side string")
    rules = spark.createDataFrame([(9, kind, text)], "rule_uid long, rule_type string, rule_text string")
    (row,) = R.highlight(view, rules).collect()
    assert row["item_content"] == want.replace("[", '<span class="filter-highlight">').replace("]", "</span>")


def test_report_of_a_rule_with_large_ids(spark):
    items = spark.createDataFrame(
        [(3_000_000_000 + i, 5, "2024-01-30 00:00:00") for i in range(3)], "item_uid long, item_rule_uid long, item_created string"
    ).withColumn("item_created", F.col("item_created").cast("timestamp"))
    rules = spark.createDataFrame([(5, "tag", "x", None)], "rule_uid long, rule_type string, rule_text string, rule_feed_uid long")
    feeds = spark.createDataFrame([(1, "f")], "feed_uid long, feed_title string")
    (row,) = A.rule_stats(rules, items, feeds, "2024-01-31 00:00:00").collect()
    assert (row["first_item"], row["last_item"]) == (3_000_000_000, 3_000_000_002)


def test_measured_bytes_counts_what_values_hold(spark):
    from pyspark.sql import functions as F

    from feedloom.llm.common import by_size
    from feedloom.operators.sizing import measured_bytes

    long = spark.range(100).select(F.repeat(F.lit("x"), 3000).cast("binary").alias("b"))
    assert measured_bytes(long) == 100 * 3016
    assert measured_bytes(long.select(F.array("b", "b").alias("a"))) == 100 * (16 + 2 * 3016)
    assert measured_bytes(long.select(F.struct("b").alias("s"))) == 100 * (16 + 3016)
    assert measured_bytes(long.select(F.lit(None).cast("array<binary>").alias("n"))) == 1600
    assert measured_bytes(long.select(F.create_map(F.lit("k"), "b").alias("m"))) == 100 * (16 + 17 + 3016)
    plans = [by_size(long, limit)._jdf.queryExecution().analyzed().toString() for limit in (100 * 3016, 100 * 3015)]
    assert ["strategy=broadcast" in p for p in plans] == [True, False]


RAISING = [
    "element_at(split(title,' '), length(title)-5) = 'x'", "size(sequence(1, length(title), -1)) > 0", "to_date(title, author) is null",
    "1 / (length(title) - 8) > 5", "cast(title as int) = 1", "length(title) * 9223372036854775807 > 0", "title > 3", "title rlike '(a|b)*'",
    "split(title, ' ')[length(title)] = 'x'", "array(1, 2)[-1] = 1", "abs(-9223372036854775808) > 0", "year(title) = 1", "title rlike author",
    "regexp_extract(title, 'a', 3) = 'x'", "regexp_replace(title, 'a', '$3') = 'x'", "title like '%\\\\'", "map('a', 1, 'a', 2)['a'] = 1",
    "exists(split(title, ' '), w -> cast(w as int) / 0 > 1)", "cast(content as timestamp) > '2020'", "date_format(updated, title) = 'x'",
    "left(title, title) = 'x'", "repeat(title, 2000000000) = 'x'", "(select max(title)) = 'x'", "java_method('java.lang.System', 'exit', 1) = 'x'",
    "(SELECT 1 = 1)", "title in (select 1)", "sum(1) over () > 0", "rand() >= 0", "content.x = 1", "length(title, 2) = 1", "named_struct('a', 1).a = 1",
]


def rule_items(spark):
    rows = [(i, 1, t, c, "a", True) for i, (t, c) in enumerate([
        ("He runs home", "more content"), ("12 ab", "9"), ("", ""), (None, None), ("a b c d e f", "x" * 40), ("short", "100%"), ("abababab", "ü")])]
    items = spark.createDataFrame(
        [(i, f, t, c, "http://x/", "g", a) for i, f, t, c, a, _ in rows],
        "item_uid long, item_feed_uid long, item_title string, item_content string, item_link string, item_guid string, item_creator string")
    return items.withColumn("updated", F.lit("2024-01-01").cast("timestamp"))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_rules_that_would_raise_hurt_no_other(spark, ansi):
    feeds = spark.createDataFrame([(1, "http://f", "A feed", False)], "feed_uid long, feed_xml string, feed_title string, feed_exempt boolean")
    rules = [(i, "python", None, text) for i, text in enumerate(RAISING)] + [(1000, "python", None, "title ilike 'he%' and length(content) > 3")]
    rules = spark.createDataFrame(rules, "rule_uid long, rule_type string, rule_feed_uid long, rule_text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = R.match_expr(R.scope_keys(rule_items(spark), feeds), feeds, rules).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert {(r["item_uid"], r["rule_uid"]) for r in found if r["rule_uid"] == 1000} == {(0, 1000)}
    assert {r["rule_uid"] for r in found} <= {1000}


@pytest.mark.parametrize("text, want", [
    ("title = 'short' or title = '12 ab'", {1, 5}), ("length(title) between 5 and 8", {1, 5, 6}), ("title in ('short', 'x')", {5}),
    ("title not in ('short') and title <> ''", {0, 1, 4, 6}), ("title is null", {3}), ("title <=> null", {3}), ("coalesce(title, 'z') = 'z'", {3}),
    ("content like '100\\\\%'", {5}), ("content ilike 'X%'", {4}), ("title rlike '^[a-f ]+$'", {4, 6}), ("not title rlike 'h'", {1, 2, 4, 6}),
    ("case when length(title) > 10 then 'long' when length(title) > 6 then 'mid' else 'small' end = 'mid'", {6}), ("if(content > 50, false, content > 5)", {1}),
    ("substring(title, 1, 2) = 12", {1}), ("substring(title from 1 for 2) = 12", {1}), ("instr(title, 'runs') = 4", {0}), ("position('b' in title) = 2", {6}),
    ("regexp_extract(title, '([0-9]+) ', 1) * 2 = 24", {1}), ("regexp_count(title, 'ab') = 4", {6}), ("size(split(title, ' ')) = 6", {4}),
    ("exists(split(title, ' '), w -> w = 'runs' or w = 'f')", {0, 4}), ("array_contains(split(title, ' '), 'ab')", {1}),
    ("size(filter(split(title, ' '), w -> length(w) = 1)) > 2", {4}), ("split(title, ' ')[1] = 'runs'", {0}), ("element_at(split(title, ' '), -1) = 'home'", {0}),
    ("concat(title, '!', content) = 'short!100%' or title || content = '12 ab9'", {1, 5}), ("trim(both 'a' from title) = 'bababab'", {6}),
    ("updated < timestamp'2024-01-02 00:00:00' and updated + interval 1 day > '2024-01-01' and title = 'short'", {5}), ("year(updated) = 2024 and title = ''", {2}),
    ("length(title) % 5 = 0 and length(title) > 0", {1, 5}), ("length(title) div 4 = 3", {0}), ("-length(title) + 8 = 0", {6}), ("feed_title = 'A feed' and title = ''", {2}),
    ("any_in(title, array('run', 'zz'))", {0}), ("any_word(title_words_exact, array('runs'))", {0}), ("TITLE = 'short'", {5}), ("try_cast(content as int) = 9", {1}),
    ("nullif(title, '') is null", {2, 3}), ("greatest(length(title), 9) = 9", {1, 2, 3, 5, 6}), ("'true' and title = ''", {2}),
])
def test_what_rules_can_say(spark, text, want):
    feeds = spark.createDataFrame([(1, "http://f", "A feed", False)], "feed_uid long, feed_xml string, feed_title string, feed_exempt boolean")
    rules = spark.createDataFrame([(1, "python", None, text)], "rule_uid long, rule_type string, rule_feed_uid long, rule_text string")
    assert {r["item_uid"] for r in R.match_expr(R.scope_keys(rule_items(spark), feeds), feeds, rules).collect()} == want


def test_refused_texts_are_not_saved(spark):
    rules = spark.createDataFrame([(1, "python", None, "title = 'a'", None), (2, "title_word", None, "x", None), (3, "python", None, "title = 'b'", None)],
                                  "rule_uid long, rule_type string, rule_feed_uid long, rule_text string, rule_expires timestamp")
    changes = spark.createDataFrame([(1, "rand() > 0", None), (2, "rand() > 0", None), (3, "title = 'c'", None)], "rule_uid long, rule_text string, rule_expires timestamp")
    assert {r["rule_uid"]: r["rule_text"] for r in M.update_rules(rules, changes).collect()} == {1: "title = 'a'", 2: "rand() > 0", 3: "title = 'c'"}
    assert [(r["rule_uid"], r["reason"]) for r in M.refused_changes(rules, changes).collect()] == [(1, "function rand can't be used")]
    feeds = spark.createDataFrame([(i, "t", "title = 'a'") for i in range(4)], "feed_uid long, feed_title string, feed_filter string")
    patches = spark.createDataFrame([(0, "T", "nonsense ("), (1, None, " "), (2, None, "length(content) > 3"), (3, "U", None)],
                                    "feed_uid long, feed_title string, feed_filter string")
    assert {r["feed_uid"]: (r["feed_title"], r["feed_filter"]) for r in M.patch_feeds(feeds, patches).collect()} == {
        0: ("T", "title = 'a'"), 1: ("t", None), 2: ("t", "length(content) > 3"), 3: ("U", "title = 'a'")}


def test_any_word_stems_few_words(spark):
    """A list of literals is compared with the stems of the words that begin like it; all words of a text were stemmed."""
    assert expression(spark, "any_word(title_words, array('absent', 'run'))", title="Running home")
    assert expression(spark, "NOT any_word(title_words, array('running'))", title="Running home")
    assert not expression(spark, "any_word(title_words, array('run', null)) IS NULL", title="Running home")
    fields = R.rule_fields(spark)
    plan = fields.select(R.expr_rule(fields, "any_word(title_words, array('run'))"))._jdf.queryExecution().analyzed().toString()
    assert "arrays_overlap" not in plan


def test_rules_reach_words_by_their_beginning(spark, small):
    """Words are narrowed by two letters before they are kept: exceptions, stems of a letter and short words stay in reach."""
    _, feeds, tags = small
    titles = ["Dying skies", "a's aing", "x", "it's ties", "zebra", "Running"]
    items = spark.createDataFrame(
        [(i, 1, t, "none", "Unknown", "http://a") for i, t in enumerate(titles)],
        "item_uid long, item_feed_uid long, item_title string, item_content string, item_creator string, item_link string")
    rules = spark.createDataFrame([
        (1, "title_word", None, None, "die"), (2, "title_word", None, None, "a"), (3, "title_exactword", None, None, "x"),
        (4, "title_all", None, None, "it tie"), (5, "title_word", None, None, "runs")], RULE_SCHEMA)
    tokens = R.item_words(R.scope_keys(items, feeds))
    kept = R._beginning(tokens, rules, R.KEYWORD_KINDS)
    assert {r["word"] for r in kept.collect()} == {"dying", "a's", "aing", "x", "it's", "ties", "running"}
    narrowed, whole = (sorted(map(tuple, R.match_keywords(tokens, rules, v).collect())) for v in (None, R.vocabulary(tokens)))
    assert narrowed == whole and {(r[0], r[2]) for r in narrowed} == {(0, 1), (1, 2), (2, 3), (3, 4), (5, 5)}
