"""Feed documents, subscription lists, exports and streaming jobs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from feedloom.operators import maintain as M
from feedloom.operators import search as Q
from feedloom.operators import token_index as TI
from feedloom.operators import stats as A
from feedloom.plans import io_queries
from feedloom.plans.io_queries import _stream
from feedloom.plans.model import AS_OF, model
from feedloom.session import durable, shared_folder
from feedloom.sources import exports as X
from feedloom.sources import feeds as S
from feedloom.sources import opml as O
from feedloom.sources import tables as store
from feedloom.streaming import incremental as I
from feedloom.streaming import jobs as J

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" version="2.0">
<channel><title>Daily</title><link>http://d.example.com/</link><description>News</description>
<item><title>A &gt; B</title><link>http://d.example.com/1</link><guid isPermaLink="false">g1</guid>
<category>Tech</category><category domain="x">tech</category><category>Art</category><dc:creator>Ann</dc:creator>
<pubDate>Sat, 01 Feb 2020 21:00:30 +0000</pubDate><description>short</description>
<content:encoded><![CDATA[<p>long</p><script>alert(1)</script>]]></content:encoded></item>
<item><title></title><guid>http://d.example.com/2</guid><category>one</category><pubDate>Sat, 01 Feb 2020 22:00:30 PST</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Wood</title><subtitle>Sub</subtitle>
<link rel="self" href="http://w/atom"/><link rel="alternate" href="http://w/"/>
<entry><title type="html">First</title><link rel="edit" href="http://w/e"/><link rel="alternate" type="text/html" href="http://w/1"/>
<id>urn:1</id><updated>2010-03-18T22:47:23Z</updated><published>2010-03-17T22:47:23Z</published>
<author><name>tych</name></author><category term="PHP"/><category term="Web"/>
<summary>sum</summary><content type="html">&lt;b&gt;body&lt;/b&gt;</content></entry></feed>"""


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="feedloom-io-")


@pytest.fixture(scope="module")
def landing(folder):
    import os

    os.makedirs(f"{folder}/docs")
    for name, text in (("a.xml", RSS), ("b.xml", ATOM)):
        with open(f"{folder}/docs/{name}", "w") as f:
            f.write(text)
    return f"{folder}/docs"


def test_read_feeds(spark, landing):
    feeds, entries = S.read_feeds(spark, landing)
    got = {r["feed_title"]: (r["feed_html"], r["feed_desc"]) for r in feeds.collect()}
    assert got == {"Daily": ("http://d.example.com/", "News"), "Wood": ("http://w/", "Sub")}
    rows = {r["guid"]: r for r in entries.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert set(rows) == {"g1", "http://d.example.com/2", "urn:1"}
    one = rows["g1"]
    assert one["title"] == "A &gt; B" and one["content"] == "<p>long</p>" and one["author"] == "Ann"
    assert one["tags"] == ["tech", "art"] and one["created"] == "2020-02-01 21:00:30" and not one["runt"]
    two = rows["http://d.example.com/2"]
    assert two["title"] == "Untitled" and two["author"] == "Unknown" and two["runt"] and two["link"] == two["guid"]
    assert two["created"] == "2020-02-02 06:00:30" and two["tags"] == ["one"] and two["position"] > one["position"]
    atom = rows["urn:1"]
    assert (atom["link"], atom["content"], atom["author"]) == ("http://w/1", "<b>body</b>", "tych")
    assert atom["tags"] == ["php", "web"] and atom["created"] == "2010-03-17 22:47:23"
    keyed = S.entries_for_ingest(entries, feeds.withColumn("feed_uid", F.length("feed_title")))
    assert keyed.count() == 3


OPML = """<?xml version="1.0" encoding="{}"?><opml version="2.0"><body>
<outline text="folder"><outline text="x" title="Café &amp; Co" description="a &lt;b&gt; &quot;q&quot; > c" xmlUrl="http://a/f?x=1&amp;y=2" htmlUrl="http://a/"/></outline>
<outline title="lower" xmlurl="http://b/f" htmlurl="http://b/"></outline><outline text="no feed" url="http://c/"/></body></opml>"""


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_read_opml(spark, folder, encoding):
    path = f"{folder}/{encoding}.opml"
    with open(path, "wb") as f:
        f.write(OPML.format(encoding).replace("\n", "\r").encode(encoding))
    rows = [tuple(r) for r in O.read_opml(spark, path).collect()]
    assert rows[0][:3] == ("http://a/f?x=1&y=2", "http://a/", "Café & Co") and rows[1][:3] == ("http://b/f", "http://b/", "lower")


def test_import_counts(spark, m):
    new = spark.createDataFrame([("feed://n/1", "h", "t", "d"), ("http://n/1", "h", "t", "d"),
                                 (m.feeds.first()["feed_xml"], "h", "t", "d")], "xml_url string, html_url string, title string, desc string")
    added, counts = O.import_feeds(new, m.feeds)
    assert [r["feed_xml"] for r in added.collect()] == ["http://n/1"]
    assert tuple(counts.first()) == (1, 2)


def test_exports_round_trip(spark, m, folder):
    O.write_opml(m.feeds_snr, f"{folder}/opml")
    back = {r["xml_url"] for r in O.read_opml(spark, f"{folder}/opml/part-*").collect()}
    assert back == {r["_xmlUrl"] for r in O.opml_export(m.feeds_snr).collect()} and back
    X.write_share(m.items, m.feeds, f"{folder}/share")
    entries = S.read_entries(spark.read, f"{folder}/share/part-*")
    assert {r["guid"] for r in entries.collect()} == {r["item_guid"] for r in X.share(m.items, m.feeds).collect()}
    X.write_stats_csv(m.items, AS_OF, f"{folder}/csv")
    table = spark.read.csv(f"{folder}/csv", header=True)
    assert table.columns == ["Date", "Articles", "Interesting", "Unread", "Filtered"] and table.count() > 0
    assert X.share_xml(X.share(m.items, m.feeds)).where("entry LIKE '<entry><id>doc:%'").count() == entries.count()
    assert X.blogroll_json(m.feeds_snr).count() == len(back)


@pytest.fixture
def lake(m):
    path = tempfile.mkdtemp(prefix="feedloom-lake-")
    store.save(path, feeds=m.feeds, items=m.stored, rules=m.rules, tags=m.tags)
    return path


def stream(spark, df, path, files=2):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_refresh_stream(spark, m, lake):
    entries = stream(spark, m.entries.where("feed_uid < 6"), f"{lake}/landing")
    shared = os.path.dirname(shared_folder(spark).removeprefix("file:"))
    folders = set(os.listdir(shared))
    J.run_refresh(entries, lake, f"{lake}/cp", AS_OF).awaitTermination()
    assert set(os.listdir(shared)) == folders
    held = store.load(spark, lake)
    guids = held.items.groupBy("item_feed_uid", "item_guid").count()
    assert guids.where("count > 1").count() == 0 and held.items.count() > m.stored.count()
    assert held.items.groupBy("item_uid").count().where("count > 1").count() == 0
    before = held.items.count()
    J.run_refresh(m_entries(spark, m, lake), lake, f"{lake}/cp2", AS_OF).awaitTermination()
    assert store.load(spark, lake).items.count() == before
    assert J.current_feeds(spark, lake).count() == m.feeds.count()


@pytest.mark.parametrize("partitions,files", [(7, [4, 3]), (1, [1, 1])])
def test_stream_of_many_files(spark, m, lake, partitions, files):
    """A table becomes two batches in the files it comes in: only one of too few is dealt to two tasks."""
    found = []

    def read(batch, _):
        found.append([r["f"] for r in batch.select("id", F.input_file_name().alias("f")).collect()])

    stream = _stream(m, spark.range(0, 1000, 1, partitions))
    stream.writeStream.foreachBatch(read).option("checkpointLocation", f"{lake}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [len(set(b)) for b in found] == files and sum(len(b) for b in found) == 1000


def test_unseen_entries(spark):
    """The last copy of a batch counts, sightings renew the time, a day later a GUID is forgotten."""
    def batch(*rows):
        return spark.createDataFrame([(1, g, p, t) for g, p, t in rows], "feed_uid long, guid string, position long, title string")

    seen = spark.createDataFrame([], J.SEEN)
    days = ["2024-01-01 00:00:00", "2024-01-01 20:00:00", "2024-01-02 19:00:00", "2024-01-03 19:30:00"]
    batches = [
        batch(("a", 1, "first"), ("a", 5, "last"), ("b", 2, "b")), batch(("a", 1, "again")),
        batch(("a", 1, "renewed"), ("b", 1, "b is back")), batch(("a", 9, "forgotten")),
    ]
    found = []
    for now, rows in zip(days, batches, strict=True):
        fresh, seen = J.unseen_entries(rows, seen, now)
        found.append(sorted(r["title"] for r in fresh.collect()))
        seen = durable(seen)
    assert found == [["b", "last"], [], ["b is back"], ["forgotten"]]


def m_entries(spark, m, lake):
    return spark.readStream.schema(m.entries.schema).parquet(f"{lake}/landing")


def test_rating_stream(spark, m, lake):
    events = m.rating_events
    J.run_ratings(stream(spark, events, f"{lake}/clicks", 3), lake, f"{lake}/cp").awaitTermination()
    got = {r["item_uid"]: r["item_rating"] for r in J.rated_items(spark, lake).collect()}
    want = {r["item_uid"]: r["item_rating"] for r in M.apply_ratings(m.stored, events).collect()}
    # Clicks are spread over batches by chance, but each has its time.
    assert got == want


def test_statistics_stream(spark, m, lake):
    old = m.items
    new = M.apply_ratings(old, m.rating_events)
    changes = I.item_changes(old, new)
    J.run_stats(stream(spark, changes, f"{lake}/changes", 2), A.feed_stats(old, AS_OF), lake, f"{lake}/cp").awaitTermination()
    got = spark.read.parquet(f"{lake}/feed_stats/batch=1").drop("snr", "last_modified", "batch")
    assert got.exceptAll(A.rating_counts(new).select(*got.columns)).count() == 0


def test_error_stream(spark, m, lake):
    log = m.fetch_log.select("feed_uid", "ts", "seq", "ok")
    half = log.agg(F.expr("percentile_approx(seq, 0.5)").alias("h")).first()["h"]
    for i, part in enumerate((log.where(F.col("seq") <= half), log.where(F.col("seq") > half))):
        part.coalesce(1).write.mode("append").parquet(f"{lake}/log")
        reader = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{lake}/log")
        J.run_errors(reader, lake, f"{lake}/cp", max_errors=6).awaitTermination()
    got = {r["feed_uid"]: (r["feed_errors"], r["longest"], r["suspended"])
           for r in J.feed_errors(spark, lake).collect()}
    want = {r["feed_uid"]: (r["feed_errors"], r["longest"], r["suspended"]) for r in M.error_runs(log, None, 6).collect()}
    assert got == want


def test_error_stream_writes_touched_feeds_only(spark, lake):
    columns = "feed_uid long, ts timestamp, seq long, ok boolean"
    batches = [[(1, 1, False), (2, 2, False), (1, 3, False)], [(1, 4, True), (1, 5, False)], [(3, 6, True)], [(2, 8, False), (2, 7, False)]]
    touched = []
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame([(f, None, s, ok) for f, s, ok in batch], columns).withColumn("ts", F.timestamp_seconds("seq"))
        rows.coalesce(1).write.mode("append").parquet(f"{lake}/log")
        J.run_errors(spark.readStream.schema(columns).parquet(f"{lake}/log"), lake, f"{lake}/cp", max_errors=2).awaitTermination()
        touched.append({r["feed_uid"] for r in spark.read.parquet(f"{lake}/feed_errors/batch={n}").collect()})
    assert touched == [{1, 2}, {1}, {3}, {2}]
    got = {tuple(r) for r in J.feed_errors(spark, lake).collect()}
    assert got == {(1, 1, 2, False), (2, 3, 3, True), (3, 0, 0, False)}


def test_seen_step_writes_no_text(spark, lake):
    """What was seen is found by keys: beside the batch itself no copy of its text is written."""
    rows = durable(spark.range(2000).select(
        F.lit(1).cast("long").alias("feed_uid"), F.col("id").alias("position"), F.col("id").cast("string").alias("guid"),
        F.concat(*[F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")), 512) for i in range(20)]).alias("content")))
    shared = os.path.dirname(shared_folder(spark).removeprefix("file:"))
    before = set(os.listdir(shared))
    fresh = J._with_seen(rows, 0, lake, AS_OF)
    written = sum(os.path.getsize(os.path.join(at, f)) for d in set(os.listdir(shared)) - before for at, _, names in os.walk(f"{shared}/{d}") for f in names)
    assert written < 500_000 and fresh.count() == 2000


def test_entries_need_one_exchange_of_text(m):
    """Articles and their tags come from one scan: labels are all that is joined."""
    plan = m.entries.select("content", "tags")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # one for each half of the batch


def test_seen_batches_write_their_own_keys(spark, lake):
    columns = "feed_uid long, position long, guid string, title string"
    for n, (day, rows) in enumerate([
        ("2024-01-01 00:00:00", [(1, 1, "a", "t"), (1, 2, "a", "last"), (1, 3, "b", "t")]), ("2024-01-01 20:00:00", [(1, 1, "a", "again"), (2, 1, "b", "t")]),
        ("2024-01-02 10:00:00", [(1, 1, "a", "renewed"), (1, 2, "b", "forgotten")]),
    ]):
        batch = spark.createDataFrame(rows, columns)
        for _ in range(2):  # the second time as after a crash
            fresh = J._with_seen(batch, n, lake, day)
            assert {r["title"] for r in fresh.collect()} == [{"last", "t"}, {"t"}, {"forgotten"}][n]
        assert {(r["feed_uid"], r["guid"]) for r in spark.read.parquet(f"{lake}/seen/batch={n}").collect()} == {(r[0], r[2]) for r in rows}
    assert not J._exists(spark, f"{lake}/seen/batch=0") and J._exists(spark, f"{lake}/seen/batch=1")


def test_token_stream(spark, m, lake):
    items = m.texts.select("item_uid", "item_title", "item_content")
    changes = items.where("item_uid < 20").withColumns({
        "item_title": F.lit("changed words"), "deleted": F.col("item_uid") % 2 == 0})
    TI.build(items, f"{lake}/index", buckets=8)
    J.run_tokens(stream(spark, changes, f"{lake}/ch", 3), f"{lake}/index", f"{lake}/cp").awaitTermination()
    got = TI.token_rows(spark, f"{lake}/index")
    assert len(TI.spans(spark, f"{lake}/index")) == 4
    want = Q.token_table(items.where("item_uid >= 20").unionByName(changes.where(~F.col("deleted")).drop("deleted")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_client_sync(m):
    client = m.items.where("item_uid % 2 = 0").select("item_uid", "item_rating", "item_title", "updated")
    newer = m.items.withColumn("updated", F.when(F.col("item_uid") % 5 == 0, F.lit("2025-01-01").cast("timestamp")).otherwise(F.col("updated")))
    after = I.sync(client, newer)
    mark = I.high_water(client).first()["since"]
    ids = {r["item_uid"] for r in after.collect()}
    assert {r["item_uid"] for r in client.collect()} <= ids and {i for i in ids if i % 2} == {
        r["item_uid"] for r in newer.where("item_uid % 2 = 1").where(F.col("updated") > F.lit(mark)).collect()}
    assert I.client_unread(after).where("item_rating <> 0").count() == 0


def test_traits_of_real_documents(spark, tmp_path):
    """Bases at every level, several CDATA blocks, a feed's author, a named zone, RDF, and a document that breaks off."""
    docs = {
        "rss.xml": """<?xml version="1.0" encoding="utf-8"?>\n<rss version="2.0" xml:base="http://r.example.com/x/"><channel xml:base="sub/">\n<title>R</title>
          <link>http://page.example.com/blog/</link><item xml:base="/deep/"><guid isPermaLink="false">r1</guid><link>a.html</link><title>one</title>
          <description><![CDATA[<img src='p.png'>]]> and <![CDATA[<a href="#top" class=x>t</a> <a HREF="http://full/">f</a>]]></description>
          <pubDate>Tue, 02 Jan 2024 03:04:05 EST</pubDate></item><item><guid isPermaLink="false">r2</guid><link>b.html</link><title>two</title></item></channel></rss>""",
        "page.xml": """<rss><channel><title>P</title><link>http://page.example.com/blog/</link><item><link>../c?x=1</link><title>three</title>
          <description>no link</description></item><item><link>//other.example.com/d</link><title>four</title></item></channel></rss>""",
        "atom.xml": """<feed xmlns="http://www.w3.org/2005/Atom" xml:base="http://a.example.com/"><title>A</title><author><name>All of us</name></author><link href="/me"/>
          <entry><id>a1</id><link href="e"/><title>five</title></entry><entry xml:base="y/"><id>a2</id><link href="e"/><title>six</title><author><name>Me</name></author></entry></feed>""",
        "rdf.xml": """<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>D</title><link>http://d.example.com/</link></channel><item><title>seven</title><link>s</link>
          <dc:creator>Dee</dc:creator><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>""",
        "none.xml": """<rss><channel><item><title>eight</title><link>stays/relative</link></item></channel></rss>""",
        "cut.xml": """<rss><channel><item><title>nine</title></item><item><title>cut""",
    }
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    feeds, entries = S.read_feeds(spark, str(tmp_path))
    rows = {r["title"]: r for r in entries.withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss")).collect()}
    assert {t: r["link"] for t, r in rows.items()} == {
        "one": "http://r.example.com/deep/a.html", "two": "http://r.example.com/x/sub/b.html", "three": "http://page.example.com/c?x=1",
        "four": "http://other.example.com/d", "five": "http://a.example.com/e", "six": "http://a.example.com/y/e", "seven": "http://d.example.com/s",
        "eight": "stays/relative"}
    assert rows["one"]["content"] == """<img src='http://r.example.com/deep/p.png'> and <a href="http://r.example.com/deep/#top" class=x>t</a> <a HREF="http://full/">f</a>"""
    assert rows["one"]["created"] == "2024-01-02 08:04:05" and rows["seven"]["created"] == "2024-01-02 03:04:05"
    assert [rows[t]["author"] for t in ("five", "six", "seven", "two")] == ["All of us", "Me", "Dee", "Unknown"]
    assert rows["one"]["position"] < rows["two"]["position"] and rows["three"]["guid"] == "../c?x=1"
    assert {r["feed_title"]: r["feed_html"] for r in feeds.collect()} == {
        "R": "http://page.example.com/blog/", "P": "http://page.example.com/blog/", "A": "http://a.example.com/me", "D": "http://d.example.com/"}
    assert {r["document"].rsplit("/", 1)[1] for r in S.rejected_documents(spark, str(tmp_path)).collect()} == {"cut.xml"}


def test_entries_without_guid_link_or_title(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><title>t</title><item><description>only this</description></item>"
        "<item><title>only a title</title></item><item/></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>cut off</channel>")
    (tmp_path / "c.xml").write_text("<html><body>no feed</body></html>")
    rows = {r["content"]: r for r in S.read_entries(spark.read, f"{tmp_path}/a.xml").collect()}
    assert set(rows) == {"only this", ""} and all(r["guid"] for r in rows.values())
    assert len({r["guid"] for r in rows.values()}) == 2
    found = {r["document"].rsplit("/", 1)[1]: r["reason"] for r in S.rejected_documents(spark, str(tmp_path)).collect()}
    assert found == {"b.xml": "malformed", "c.xml": "no feed"}


def test_declared_encoding_far_into_the_file(spark, tmp_path):
    outline = '<opml><body><outline xmlUrl="http://a/" title="{}"/></body></opml>'
    head = '<?xml version="1.0" ' + " " * 300 + 'encoding="ISO-8859-1"?>'
    (tmp_path / "far.opml").write_bytes((head + outline.format("Ã©")).encode("latin-1"))
    (tmp_path / "text.opml").write_bytes(('<?xml version="1.0"?><!-- encoding="ISO-8859-1" -->' + outline.format("é")).encode())
    assert {r["title"] for r in O.read_opml(spark, str(tmp_path)).collect()} == {"Ã©", "é"}


def test_written_documents_are_listed_as_one_path(spark):
    """However many files there are, Spark lists their folder and starts no job with a task for each."""
    key, context = "spark.sql.sources.parallelPartitionDiscovery.threshold", spark.sparkContext
    path = io_queries._as_rss(model(spark, "/root/testdata/sf0.01"))
    spark.conf.set(key, "2")
    context.setJobGroup("listing", "listing")
    try:
        documents = S.parsed_documents(spark.read, path)
        assert len(documents.inputFiles()) > 10
        assert not context.statusTracker().getJobIdsForGroup("listing")
    finally:
        spark.conf.unset(key)
        context.setLocalProperty("spark.jobGroup.id", None)
