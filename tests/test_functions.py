"""Scalar, text, HTML and query-parsing functions on small fixtures."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions import rule_helpers as RH
from feedloom.functions import scalars as S
from feedloom.functions import text as T
from feedloom.functions.stemming import any_stem, stem_start, with_stem
from feedloom.operators import rules as R
from feedloom.operators import search as Q
from feedloom.operators.stats import decay_weight

AS_OF = "2024-01-31 00:00:00"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("age,expected", [
    (0.05, "72 minutes ago"), (0.5, "12 hours ago"), (1.5, "one day ago"), (2.5, "2 days ago"),
    (10.0, "2024-01-21"), (0.0, "never"),
])
def test_since(spark, age, expected):
    assert one(spark, S.since(F.lit(age), AS_OF)) == expected


def test_since_null(spark):
    assert one(spark, S.since(F.lit(None).cast("double"), AS_OF)) == "never"


@pytest.mark.parametrize("age,weight", [
    (0, 1.0), (89.9, 1.0), (90, 0.5), (179, 0.5), (181, 0.25), (5580, 2.0 ** -62), (9000, 2.0 ** -62),
    (-45, 1.0), (-90, None), (-400, None),
])
def test_decay_weight(spark, age, weight):
    created = F.timestamp_micros(F.unix_micros(S.as_of_column(AS_OF)) - F.lit(int(age * S.MICROS_PER_DAY)))
    assert one(spark, decay_weight(created, AS_OF)) == weight


def test_decay_weight_null(spark):
    assert one(spark, decay_weight(F.lit(None).cast("timestamp"), AS_OF)) is None


@pytest.mark.parametrize("text,expected", [
    ("Sat, 01 Feb 2020 21:00:30 +0000", "2020-02-01 21:00:30"),
    ("Mon, 01 Nov 2010 09:22:35 -0800", "2010-11-01 17:22:35"),
    ("Thu, 20 Mar 2008 15:12:16 PDT", "2008-03-20 22:12:16"),
    ("Thu, 29 Oct 2020 20:08:43 GMT", "2020-10-29 20:08:43"),
    ("2010-03-24T13:32:48Z", "2010-03-24 13:32:48"),
    ("2007-10-09T10:28:36-07:00", "2007-10-09 17:28:36"),
    ("not a date", None),
])
def test_feed_date(spark, text, expected):
    assert one(spark, S.datetime_text(S.feed_date(F.lit(text)))) == expected


def test_xml_text(spark):
    assert one(spark, S.xml_text(F.lit("<a href=\"x\">é & 'ł'</a>"))) == (
        "&lt;a href=&quot;x&quot;&gt;&#233; &amp; &apos;ł&apos;&lt;/a&gt;"
    )


def test_labels(spark):
    tags = F.array(F.lit("b"), F.lit("a"))
    assert one(spark, S.tag_label(tags, F.lit('J "X" Y'))) == "a b J 'X' Y"
    assert one(spark, S.tag_label(tags, F.lit("Unknown"))) == "a b"
    assert one(spark, S.tag_label(F.array().cast("array<string>"), F.lit("Unknown"))) == "(no tags)"
    assert one(spark, S.clean_desc(F.lit(' <b>"A"</b> & B © '))) == "&quot;A&quot; &amp; B &copy;"
    assert one(spark, S.fix_scheme(F.lit("feed://a/b"))) == "http://a/b"
    assert one(spark, S.error_level(F.lit(11))) == "error"
    assert one(spark, S.snr_percent(F.lit(0.4999))) == 49


def test_words(spark):
    text = "<p>L'Été à Zürich</p> bill's <b>straße</b> 42 été"
    assert sorted(one(spark, T.words(F.lit(text)))) == sorted(["l'ete", "a", "zurich", "bill's", "strasse", "42", "ete"])


# Pairs published with the Snowball English stemmer, and the exceptions it lists.
STEMS = {
    "bill's": "bill", "y's": "y", "skies": "sky", "dying": "die", "news": "news", "by": "by",
    "consigned": "consign", "consigning": "consign", "consistency": "consist", "consolations": "consol",
    "conspicuously": "conspicu", "knightly": "knight", "knots": "knot", "kneeling": "kneel",
    "hopping": "hop", "hoping": "hope", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas",
    "gaps": "gap", "succeed": "succeed", "proceeding": "proceed", "generously": "generous", "communism": "communism",
    "relational": "relat", "rationally": "ration", "happiness": "happi", "fully": "fulli", "enjoying": "enjoy",
    "youth": "youth", "controllable": "control", "luxuriated": "luxuri", "inning": "inning", "sky": "sky",
}


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "word string")
    got = {r["word"]: r["stem"] for r in with_stem(df).collect()}
    assert got == STEMS


def test_stem_start_never_misses(spark, m):
    """The two-letter filter before stemming keeps every word of the tables."""
    vocab = m.texts.select(F.explode(T.words(F.col("item_content"))).alias("word")).distinct()
    extra = spark.createDataFrame([(w,) for w in [*STEMS, "aing", "a's", "ied", "yed", "'tis", "ying"]], "word string")
    stems = with_stem(vocab.unionByName(extra))
    start, key = stem_start(F.col("word")), F.substring("stem", 1, 2)
    assert stems.where((start != key) & (F.substring(start, 1, 1) != key)).count() == 0


@pytest.mark.parametrize("query,quoted", [
    ("foo", '"foo"'), ("foo bar", '"foo" "bar"'), ('"foo"', '"foo"'), ('"foo bar"', '"foo bar"'),
    ("foo AND bar", '"foo" AND "bar"'), ("(foo AND bar) OR baz", '("foo" AND "bar") OR "baz"'),
    ("foo AN bar", '"foo" "AN" "bar"'), ('"foo AN bar"', '"foo AN bar"'), ("ACME", '"ACME"'), ("Acme", '"Acme"'),
    ("OpenBSD", '"OpenBSD"'), ("ANAN", '"ANAN"'), ("ANAND", '"ANAND"'), ('AN"D"', '"AND"'), ("NOTAM", '"NOTAM"'),
    ("ANDROS", '"ANDROS"'),
])
def test_quote_query(query, quoted):
    assert Q.quote_query(query) == quoted


@pytest.mark.parametrize("query,scope,rows", [
    ('"cafe"', "both", [1, 2]), ('"cloud" "nine"', "both", [2, 3]), ('"cloud nine"', "both", [2]),
    ('"cloud" NOT "nine"', "both", []), ('"noir" OR "cloud" "nine"', "both", [1, 2, 3]),
    ('"clouds" OR "cloud" NOT "nine"', "both", [1]), ('"two"', "title", []), ('"two"', "both", [2]),
    ('nine NOT cloud two', "both", [3]), ("", "both", []), ('""', "both", []),
])
def test_search(spark, query, scope, rows):
    items = spark.createDataFrame(
        [(1, "Café Noir clouds", "body one"), (2, "cloud nine", "café two"), (3, "nine cloud", "x")],
        "item_uid long, item_title string, item_content string")
    assert sorted(r["item_uid"] for r in Q.search_tokens(items, query, scope).collect()) == rows
    assert sorted(r["item_uid"] for r in Q.search_many(items, [(query, scope)]).collect()) == rows


@pytest.mark.parametrize("query", ["(foo", "foo AND", "NOT foo", "foo)"])
def test_malformed_search(query):
    with pytest.raises(ValueError):
        Q.parse_search(query)


@pytest.mark.parametrize("label,expected", [("Read", "http://b.com"), ("read", "NOT MATCHED")])
def test_link_extract(spark, label, expected):
    html = F.lit('<a name="x">No</a> <a class="y" href="http://b.com"><b>Re</b>ad</a><a href="/c">Read</a>')
    assert one(spark, H.link_extract(label, html)) == expected
    RH.register_helpers(spark)
    got = spark.createDataFrame(
        [('<a name="x">No</a> <a href="http://b.com"><b>Re</b>ad</a>',)], "h string"
    ).selectExpr(f"link_extract('{label}', h) AS r").first()["r"]
    assert got == expected


@pytest.mark.parametrize("base,href,expected", [
    ("http://a.com/x/y.html", "z", "http://a.com/x/z"), ("http://a.com/x/y.html", "/z", "http://a.com/z"),
    ("http://a.com", "feed", "http://a.com/feed"), ("http://a.com/x?q=1", "?r=2", "http://a.com/x?r=2"),
    ("http://a.com/x/", "https://b.org/c", "https://b.org/c"), ("https://a.com/x", "//b.org/c", "https://b.org/c"),
    ("http://a.com/x#f", "#g", "http://a.com/x#g"), ("http://a.com/x/y", "./z", "http://a.com/x/z"),
])
def test_resolve_url(spark, base, href, expected):
    assert one(spark, H.resolve_url(F.lit(base), F.lit(href))) == expected


def test_truncate_and_scripts(spark):
    long = " ".join(f"w{i}" for i in range(60))
    first = " ".join(f"w{i}" for i in range(50))
    assert one(spark, H.truncate_html(F.lit(f"<p>{long}</p>"))) == f"<p>{first}...</p>"
    assert one(spark, H.truncate_html(F.lit(f"<p><b>{long}"))) == f"<p><b>{first}...</b></p>"
    assert one(spark, H.truncate_html(F.lit("<p>short <b>text</b></p>"))) == "<p>short <b>text</b></p>"
    for html, want in [
        ("a<br>b <img src='x>y'> c", "a<br>b <img src='x>y'> c"), ("<div><p>one <i>two</div> three</p>", "<div><p>one <i>two</i></p></div> three"),
        ("</b>a < b <!-- <p> --> c", "a &lt; b  c"), ("<UL><li>x</LI></ul>", "<UL><li>x</li></ul>"), ("<hr/><x-y a=\"1\"/>", "<hr/><x-y a=\"1\"/>"),
        ("", ""), ("  ", "  "), ("<p>", "<p></p>"),
    ]:
        assert one(spark, H.truncate_html(F.lit(html))) == want
    assert one(spark, H.truncate_html(F.lit("<p><a href='u'>a b</a> <b>c <br>d e</b> f</p>"), 3)) == "<p><a href='u'>a b</a> <b>c <br>...</b></p>"
    assert one(spark, H.truncate_html(F.lit(None).cast("string"))) == ""
    assert one(spark, H.remove_scripts(F.lit("a<script>x('</p>')</script >b<SCRIPT src=1>c"))) == "ab"


@pytest.mark.parametrize("word", ["cloud", "gb", "cafe"])
def test_highlight_first(spark, word):
    title = "Sopra gets £££££££s to manage cops' cloud in Oracle's cloud, UK Café"
    start = time.time()
    got = one(spark, H.highlight_first(F.lit(title), H.highlight_pattern(word)))
    assert got.count("<span") == 1 and time.time() - start < 5
    assert got.replace('<span class="filter-highlight">', "").replace("</span>", "") == title


def test_rule_text(spark):
    assert one(spark, RH.clean_rule(F.lit("# note\na > 1\r\nAND b\n#x"))) == "a > 1  AND b"


def test_sql_helpers(spark):
    RH.register_helpers(spark)
    row = spark.sql("SELECT any_in('a bc', array('x', 'bc')) AS a, any_word(array('a', 'b'), array('c')) AS b").first()
    assert row["a"] is True and row["b"] is False


def test_age_is_exact(spark):
    then = dt.datetime(2024, 1, 30, 12)
    assert one(spark, S.age_days(F.lit(str(then)).cast("timestamp"), AS_OF)) == 0.5


@pytest.mark.parametrize("base", ["http://a.com/x/y", "http://a.com/x/y/", "http://a.com", "http://a.com/x/y?q=1/2#f"])
def test_resolve_url_as_urljoin(spark, base):
    from urllib.parse import urljoin

    refs = [
        "../rss.xml", "./rss.xml", "../../rss.xml", "../../../rss.xml", "a/../b", "a/./b/", "..", ".", "../", "/a/../b?x=../y", "/../a",
        "rss.xml?u=a/../b", "//b.com/x/../y", "http://b.com/x/../y", "?q=2", "#top", "", "...", "a..b/c",
    ]
    rows = spark.createDataFrame([(r,) for r in refs], "r string").select("r", H.resolve_url(F.lit(base), F.col("r")).alias("u")).collect()
    for row in rows:
        if row["r"] not in ("", "//b.com/x/../y"):
            assert row["u"] == urljoin(base, row["r"]), row


def test_any_stem_stems_few_words(spark):
    """The same as the overlap of all stems; the words that are stemmed begin like a stem that is wanted."""
    words = [*STEMS, "aing", "a's", "ied", "yed", "'tis", "ying", "dying", "skies", "x", "'s", "it's", "ünder", "a"]
    stems = {**STEMS, **{r["word"]: r["stem"] for r in with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()}}
    df = spark.createDataFrame([(w, [w, "zzz"]) for w in words], "word string, ws array<string>")
    for wanted in (["sky", "die", "hop"], ["a", "ti", "tis", "'s"], ["x", "The", "ünder", ".", "(?"], [""], []):
        got = {r["word"]: r["hit"] for r in df.select("word", any_stem(F.col("ws"), wanted).alias("hit")).collect()}
        assert got == {w: stems[w] in wanted for w in words}


def test_membership_helpers_leave_most_words_unstemmed(m):
    """Stemming all words of all texts was most of the work: the words are taken as they are and only near ones stemmed."""
    df = R.with_rule_fields(m.texts).select(RH.any_of("union", "words", ["tion", "er"]).alias("hit"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(filter(" in plan and "transform(array_distinct(" not in plan
