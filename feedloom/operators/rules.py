"""Filtering rules: which rule, if any, takes an article out of the unread list.

A rule is a row; matching is relational. Word rules are equi-joins of a
narrow (item, word) table with the rule words. Stems are computed for the
distinct vocabulary only, and rules are expanded to the surface words they
reach, so the running text never meets the stemmer. Matches are reduced to
the first rule per item with a mergeable ``min``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import schema
from feedloom.functions.html import highlight_pattern, java_quote
from feedloom.functions.rule_helpers import clean_rule, register_helpers, rule_kind
from feedloom.functions.scalars import as_of_column
from feedloom.functions.stemming import EXCEPTIONS, stem, stem_start, with_stem
from feedloom.functions.text import WORD, fold, fold_text, words
from feedloom.operators.expressions import Compiler, Refused
from feedloom.operators.links import link_seen
from feedloom.operators.phrases import phrase_matches
from feedloom.operators.sizing import broadcast_if_small
from feedloom.schema import FILTERED, UNREAD
from feedloom.session import durable, together

SCOPE_GLOBAL, SCOPE_FEED, SCOPE_FEED_FILTER = 0, 1, 2

MATCH_COLUMNS = ("item_uid", "scope", "rule_uid", "side")


def active_rules(rules: DataFrame, as_of) -> DataFrame:
    return rules.where(F.col("rule_expires").isNull() | (F.col("rule_expires") > as_of_column(as_of)))


def expand_targets(rules: DataFrame) -> DataFrame:
    """Adds ``side`` (title / content) and ``match``; a union rule becomes two rows."""
    target, match = rule_kind(F.col("rule_type"))
    sides = F.when(target == "union", F.array(F.lit("title"), F.lit("content"))).otherwise(F.array(target))
    return rules.withColumn("match", match).withColumn("side", F.explode(sides))


def with_rule_fields(items: DataFrame, texts: list[str] | None = None) -> DataFrame:
    """The names expression rules see: title, content, author, link, ``_lc``, ``_words`` and ``_words_exact``.

    ``_words`` are stems, ``_words_exact`` the words themselves. Word sets are added if one of the
    rule ``texts`` names them (all are without ``texts``); stemming running text is dear.
    """
    fields = items.withColumns({
        "title": F.col("item_title"), "content": F.col("item_content"),
        "link": F.col("item_link"), "guid": F.col("item_guid"), "author": F.col("item_creator"),
        "title_lc": F.lower("item_title"), "content_lc": F.lower("item_content"),
    }).withColumn("union_lc", F.concat_ws("\n", "title_lc", "content_lc"))

    def named(side: str) -> bool:
        return texts is None or any(f"{side}_words" in t or "union_words" in t for t in texts)

    for side in ("title", "content"):
        if named(side):
            fields = fields.withColumn(f"{side}_words_exact", words(F.col(side)))
            fields = fields.withColumn(f"{side}_words", F.array_distinct(F.transform(f"{side}_words_exact", stem)))
    if named("title") and named("content"):
        fields = fields.withColumns({
            f"union_words{form}": F.array_union(f"title_words{form}", f"content_words{form}") for form in ("", "_exact")
        })
    return fields


def scope_keys(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """(item_uid, item_feed_uid, exempt). An exempt feed is spared the global rules."""
    flags = feeds.select(F.col("feed_uid").alias("item_feed_uid"), F.coalesce("feed_exempt", F.lit(False)).alias("exempt"))
    return items.join(flags, "item_feed_uid", "left").withColumn("exempt", F.coalesce("exempt", F.lit(False)))


def in_scope() -> Column:
    """Join residual: the rule is global and the feed not exempt, or it is the feed's own."""
    return F.when(F.col("rule_feed_uid").isNull(), ~F.col("exempt")).otherwise(
        F.col("rule_feed_uid") == F.col("item_feed_uid")
    )


def scope_rank() -> Column:
    return F.when(F.col("rule_feed_uid").isNull(), SCOPE_GLOBAL).otherwise(SCOPE_FEED)


def _matches(df: DataFrame) -> DataFrame:
    return df.where(in_scope()).select("item_uid", scope_rank().alias("scope"), "rule_uid", "side")


def item_words(scoped: DataFrame) -> DataFrame:
    """One row per item, side and distinct word. Narrow: no text is carried."""
    sides = F.array(
        F.struct(F.lit("title").alias("side"), words(F.col("item_title")).alias("ws")),
        F.struct(F.lit("content").alias("side"), words(F.col("item_content")).alias("ws")),
    )
    return (
        # explode_outer: a plain explode is guarded by a size filter that tokenises once more.
        scoped.select("item_uid", "item_feed_uid", "exempt", F.explode_outer(sides).alias("s"))
        .select("item_uid", "item_feed_uid", "exempt", F.col("s.side").alias("side"), F.explode("s.ws").alias("word"))
    )


def rule_words(rules: DataFrame, match: str) -> DataFrame:
    """(rule_uid, rule_feed_uid, side, word) of the rules of one kind."""
    return (
        expand_targets(rules).where(F.col("match") == match)
        .select("rule_uid", "rule_feed_uid", "side", F.explode(words(F.col("rule_text"))).alias("word"))
    )


def vocabulary(tokens: DataFrame) -> DataFrame:
    """Distinct words. Each task emits a word at most once before the shuffle."""
    return tokens.select("word").distinct()


KEYWORD_KINDS = ("word", "exactword", "all")


def keyword_reach(rules: DataFrame, vocab: DataFrame, kinds: tuple[str, ...] = KEYWORD_KINDS) -> DataFrame:
    """(side, word) -> rule: every surface word that counts towards a rule.

    ``part`` tells the rule's words apart and ``needed`` says how many parts
    must be found: one for word and exactword, all stems for ``all``.
    """
    columns = ("rule_uid", "rule_feed_uid", "side", "word", "part", "needed")
    one = F.lit(1).cast("long")
    parts = []
    if "exactword" in kinds:
        parts.append(rule_words(rules, "exactword").withColumns({"part": F.lit(""), "needed": one}))
    stemmed = [k for k in kinds if k != "exactword"]
    if stemmed:
        keyed = reduce(DataFrame.unionByName, [rule_words(rules, k).withColumn("kind", F.lit(k)) for k in stemmed])
        wanted = durable(with_stem(keyed).drop("word").distinct())
        needed = wanted.groupBy("rule_uid", "side", "kind").agg(F.count(F.lit(1)).alias("stems"))
        # Kept, or the join would stem every word again to look for nulls.
        reached = durable(with_stem(_near(vocab, wanted)))
        in_all = F.col("kind") == "all"
        parts.append(
            wanted.join(needed, ["rule_uid", "side", "kind"]).join(reached, "stem").withColumns({
                "part": F.when(in_all, F.col("stem")).otherwise(F.lit("")),
                "needed": F.when(in_all, F.col("stems")).otherwise(one),
            })
        )
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).distinct()


def _near(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words that can have one of the wanted stems, to spare stemming the others.

    A stem keeps the first two letters of its word, the listed exceptions and
    stems of a single letter apart; those are compared by what they map to and
    by one letter.
    """
    keys = wanted.select(F.substring("stem", 1, 2).alias("key")).distinct()
    start = stem_start(F.col("word"))
    keyed = vocab.select("word", F.explode(F.array_distinct(F.array(start, F.substring(start, 1, 1)))).alias("key"))
    # Stemming is the costly part, so the few words left are spread out again.
    partitions = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.join(keys, "key", "left_semi").select("word").distinct().repartition(partitions, "word")


def _start(word: Column) -> Column:
    """Two letters that a word begins with, a leading apostrophe left out."""
    return F.substring(word, F.when(F.startswith(word, F.lit("'")), 2).otherwise(1), F.lit(2))


#: Where the listed exceptions begin, by the start of their stems.
_EXCEPTION_STARTS = {
    start: sorted({word[:2] for word, stem_ in EXCEPTIONS.items() if stem_[:2] == start}) for start in {s[:2] for s in EXCEPTIONS.values()}
}


def _beginning(tokens: DataFrame, rules: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``tokens`` that begin like a word of a rule of their side or like what can have its stem (see :func:`_near`): all that rules can reach."""
    keyed = with_stem(reduce(DataFrame.unionByName, [rule_words(rules, k) for k in kinds]).select("side", "word").distinct())
    start = F.col("start")
    listed = F.create_map(*[x for key, starts in sorted(_EXCEPTION_STARTS.items()) for x in (F.lit(key), F.array(*[F.lit(s) for s in starts]))])
    starts = durable(
        keyed.select("side", F.explode(F.array("word", "stem")).alias("word")).select("side", _start(F.col("word")).alias("start"))
        .select("side", F.explode(F.concat(F.array(start), F.coalesce(F.try_element_at(listed, start), F.array().cast("array<string>")))).alias("start"))
        .distinct()
    )
    out = tokens.withColumn("__two", _start(F.col("word"))).withColumn("__one", F.substring("__two", 1, 1))
    for name, size in (("__two", 2), ("__one", 1)):
        # Stems of one letter reach whatever begins with it.
        own = starts.where(F.length("start") == size).select("side", F.col("start").alias(name), F.lit(True).alias(f"{name}_near"))
        out = out.join(broadcast_if_small(own), ["side", name], "left")
    return out.where(F.col("__two_near") | F.col("__one_near")).select(*tokens.columns)


def match_keywords(
    tokens: DataFrame, rules: DataFrame, vocab: DataFrame | None = None, kinds: tuple[str, ...] = KEYWORD_KINDS
) -> DataFrame:
    """Word, exact-word and all-words rules in one join of the token table.

    Without a ``vocab``, the tokens that begin like a rule's word are kept
    first, so that texts are taken apart once for the vocabulary and the join.
    The reach table is built and measured. While it is small the token join
    needs no shuffle; only the matching rows are then grouped.
    """
    if vocab is None:
        tokens = durable(_beginning(tokens, rules, kinds))
        vocab = vocabulary(tokens)
    reach = broadcast_if_small(keyword_reach(rules, vocab, kinds))
    hits = tokens.join(reach, ["side", "word"]).where(in_scope())
    return (
        hits.groupBy("item_uid", scope_rank().alias("scope"), "rule_uid", "side", "needed")
        .agg(F.count_distinct("part").alias("found"))
        .where(F.col("found") == F.col("needed"))
        .select(*MATCH_COLUMNS)
    )


def match_word(tokens: DataFrame, rules: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    return match_keywords(tokens, rules, vocab, ("word",))


def match_exactword(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    return match_keywords(tokens, rules, None, ("exactword",))


def match_all(tokens: DataFrame, rules: DataFrame, scoped: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    return match_keywords(tokens, rules, vocab, ("all",)).unionByName(match_wordless(scoped, rules))


def match_wordless(scoped: DataFrame, rules: DataFrame) -> DataFrame:
    """An ``all`` rule without words matches every item in its scope.

    Since the first rule of a scope decides, only the lowest such rule of a
    scope is emitted.
    """
    lowest = (
        expand_targets(rules).where((F.col("match") == "all") & (F.size(words(F.col("rule_text"))) == 0))
        .groupBy(F.coalesce("rule_feed_uid", F.lit(-1)).alias("scope_key"))
        .agg(F.min(F.struct("rule_uid", F.when(F.col("side") == "title", 0).otherwise(1).alias("o"), "side")).alias("r"))
    )
    own = F.array("item_feed_uid")
    keys = F.when(F.col("exempt"), own).otherwise(F.array(F.lit(-1).cast("long"), "item_feed_uid"))
    return (
        scoped.select("item_uid", F.explode(keys).alias("scope_key"))
        # A row a feed with such a rule, and one for the global ones, which all articles would meet in one task otherwise.
        .join(broadcast_if_small(lowest), "scope_key")
        .select("item_uid", F.when(F.col("scope_key") == -1, SCOPE_GLOBAL).otherwise(SCOPE_FEED).alias("scope"),
                F.col("r.rule_uid").alias("rule_uid"), F.col("r.side").alias("side"))
    )


def match_phrases(scoped: DataFrame, rules: DataFrame, kinds: tuple[str, ...] = ("phrase", "phrase_lc")) -> DataFrame:
    """Substring rules (``phrase_lc`` in the lower-cased text): candidates by the phrases' runs, confirmed in the text.

    See :mod:`feedloom.operators.phrases`. An empty phrase is in every text there is.
    """
    wanted = expand_targets(rules).where(F.col("match").isin(*kinds) & F.col("rule_text").isNotNull()).select(
        "rule_uid", "rule_feed_uid", "side", (F.col("match") == "phrase_lc").alias("lower"), F.col("rule_text").alias("phrase"),
        F.monotonically_increasing_id().alias("phrase_id"),
    )
    rows = scoped.select(F.col("item_uid").alias("id"), "item_feed_uid", "exempt", "item_title", "item_content")
    texts = {side: F.col(f"item_{side}") for side in ("title", "content")}
    hits = phrase_matches(rows, texts, wanted, ("item_feed_uid", "exempt"), in_scope())
    return hits.select(F.col("id").alias("item_uid"), scope_rank().alias("scope"), "rule_uid", "side")


def match_phrase(scoped: DataFrame, rules: DataFrame) -> DataFrame:
    """Case-sensitive substring."""
    return match_phrases(scoped, rules, ("phrase",))


def match_phrase_lc(scoped: DataFrame, rules: DataFrame) -> DataFrame:
    """Substring of the lower-cased text."""
    return match_phrases(scoped, rules, ("phrase_lc",))


def match_tag(scoped: DataFrame, tags: DataFrame, rules: DataFrame) -> DataFrame:
    wanted = rules.where(F.col("rule_type") == "tag").select(
        "rule_uid", "rule_feed_uid", F.lit(None).cast("string").alias("side"), F.lower("rule_text").alias("tag_name")
    )
    # Reduce the tags to those some rule names before meeting the items.
    hits = tags.select(F.col("tag_item_uid").alias("item_uid"), "tag_name").join(wanted, "tag_name")
    keys = scoped.select("item_uid", "item_feed_uid", "exempt")
    return _matches(hits.join(keys, "item_uid")).distinct()


def match_author(scoped: DataFrame, rules: DataFrame) -> DataFrame:
    wanted = rules.where(F.col("rule_type") == "author").select(
        "rule_uid", "rule_feed_uid", F.lit(None).cast("string").alias("side"), F.col("rule_text").alias("author_lc")
    )
    keys = scoped.select("item_uid", "item_feed_uid", "exempt", F.lower("item_creator").alias("author_lc"))
    return _matches(keys.join(wanted, "author_lc"))


def expr_rule(df: DataFrame, text: str) -> Column | None:
    """A user's boolean expression as a column that never raises, or None if it can't be a rule.

    See :mod:`feedloom.operators.expressions` for what a rule may use.
    """
    return _compiled(Compiler(df), text)


def _compiled(compiler: Compiler, text: str) -> Column | None:
    try:
        return compiler.compile(text)
    except Refused:
        return None


def check_rules(rules: DataFrame, fields: DataFrame) -> DataFrame:
    """(rule_uid, rule_text, reason) of the expression rules among ``rules`` that can't be stored: they would never match.

    ``fields`` has the columns rules see (:func:`expression_fields`, :func:`rule_fields`). Rules are code and are read by the driver.
    """
    rows = rules.where(F.col("rule_type") == "python").select("rule_uid", "rule_text", clean_rule(F.col("rule_text")).alias("text"))
    return rules.sparkSession.createDataFrame(
        refused_texts([(r["text"], (r["rule_uid"], r["rule_text"])) for r in rows.collect()], fields),
        "rule_uid long, rule_text string, reason string",
    )


def refused_texts(texts: list[tuple[str, tuple]], fields: DataFrame) -> list[tuple]:
    """Of (text, key values) those that can't be a rule: the key values and the reason."""
    register_helpers(fields.sparkSession)
    compiler, out = Compiler(fields), []
    for text, key in texts:
        try:
            compiler.compile(text)
        except Refused as reason:
            out.append((*key, str(reason)))
    return out


def rule_fields(spark: SparkSession) -> DataFrame:
    """An empty table of all fields that rules may see, to check texts without any articles."""
    items = spark.createDataFrame([], T.StructType([*schema.ITEMS.fields, T.StructField("exempt", T.BooleanType())]))
    fields = expression_fields(items, spark.createDataFrame([], schema.FEEDS))
    return fields.withColumns({
        "link_already": F.lit(False), "page_text": F.lit(""), "item_tags": F.array().cast("array<string>"),
        "category": F.array().cast("array<string>"),
    })


def _expression_hits(fields: DataFrame, conditions: list[tuple[int, int, Column]]) -> DataFrame:
    """Evaluate (scope, rule_uid, condition) triples in one projection."""
    spark = fields.sparkSession
    if not conditions:
        schema = "item_uid long, scope int, rule_uid long, side string"
        return spark.createDataFrame([], schema)
    hits = F.array(*[
        F.when(test, F.struct(F.lit(scope).alias("scope"), F.lit(uid).cast("long").alias("rule_uid")))
        for scope, uid, test in conditions
    ])
    found = fields.select("item_uid", F.array_compact(hits).alias("hs")).select(
        "item_uid", F.explode_outer("hs").alias("h")
    ).where(F.col("h").isNotNull())
    return found.select("item_uid", "h.scope", "h.rule_uid", F.lit(None).cast("string").alias("side"))


def expression_fields(scoped: DataFrame, feeds: DataFrame, texts: list[str] | None = None) -> DataFrame:
    """Item fields plus every ``feed_*`` field, as expression rules see them."""
    named = [F.col(c) for c in feeds.columns if c not in ("feed_uid", "feed_exempt")]
    feed_fields = feeds.select(F.col("feed_uid").alias("item_feed_uid"), *named)
    return with_rule_fields(scoped, texts).join(feed_fields, "item_feed_uid", "left")


def with_lookups(
    fields: DataFrame, texts: list[str], links: DataFrame | None = None, pages: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """The rule fields that need other tables, where some rule names them.

    ``link_already``: the article's link is known among ``links``;
    ``page_text``: what ``pages`` (url, html) holds for the link, or nothing;
    ``item_tags``, also called ``category``: the article's tags in order. What is looked up by link is found on (item_uid, link) and
    brought to the articles by their id, measured for broadcast.
    """
    def named(*names: str) -> bool:
        return any(name in text for text in texts for name in names)

    narrow = fields.select("item_uid", "link")
    if tags is not None and named("item_tags", "category"):
        own = tags.groupBy(F.col("tag_item_uid").alias("item_uid")).agg(F.array_sort(F.collect_set("tag_name")).alias("item_tags"))
        none = F.array().cast("array<string>")
        fields = fields.join(broadcast_if_small(own), "item_uid", "left").withColumn("item_tags", F.coalesce("item_tags", none))
        fields = fields.withColumn("category", F.col("item_tags"))
    if links is not None and named("link_already"):
        seen = link_seen(narrow.select(F.col("link").alias("url")), links).select(F.col("url").alias("link"))
        known = narrow.join(broadcast_if_small(seen), "link", "left_semi").select("item_uid", F.lit(True).alias("link_already"))
        fields = fields.join(broadcast_if_small(known), "item_uid", "left")
        fields = fields.withColumn("link_already", F.coalesce("link_already", F.lit(False)))
    if pages is not None and named("page_text"):
        wanted = pages.join(broadcast_if_small(narrow.select(F.col("link").alias("url")).distinct()), "url", "left_semi")
        held = wanted.groupBy(F.col("url").alias("link")).agg(F.max("html").alias("page_text"))
        texts_of = narrow.join(held, "link").select("item_uid", "page_text")
        fields = fields.join(broadcast_if_small(texts_of), "item_uid", "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    return fields


def match_expr(
    scoped: DataFrame, feeds: DataFrame, rules: DataFrame, links: DataFrame | None = None, pages: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Expression rules. The rule texts are code, so they are read by the driver."""
    register_helpers(scoped.sparkSession)
    rows = (
        rules.where(F.col("rule_type") == "python")
        .select("rule_uid", "rule_feed_uid", clean_rule(F.col("rule_text")).alias("text")).orderBy("rule_uid").collect()
    )
    texts = [r["text"] for r in rows]
    fields = with_lookups(expression_fields(scoped, feeds, texts), texts, links, pages, tags)
    conditions, compiler = [], Compiler(fields)
    for row in rows:
        test = _compiled(compiler, row["text"])
        if test is not None:
            own = row["rule_feed_uid"]
            gate = ~F.col("exempt") if own is None else F.col("item_feed_uid") == own
            conditions.append((SCOPE_GLOBAL if own is None else SCOPE_FEED, row["rule_uid"], gate & test))
    return _expression_hits(fields, conditions)


def match_feed_filter(
    scoped: DataFrame, feeds: DataFrame, links: DataFrame | None = None, pages: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Each feed's own filter expression, evaluated after all rules (rule_uid 0).

    Feeds with the same filter share one test: the different texts are numbered, and a feed has
    the number of its own. Only texts come to the driver.
    """
    register_helpers(scoped.sparkSession)
    filters = durable(feeds.where(F.col("feed_filter").isNotNull()).select(
        F.col("feed_uid").alias("item_feed_uid"), clean_rule(F.col("feed_filter")).alias("text")
    ))
    texts = sorted(r["text"] for r in filters.select("text").distinct().collect())
    table = scoped.sparkSession.createDataFrame(list(enumerate(texts)), "filter_number int, text string")
    numbers = broadcast_if_small(filters.join(table, "text").select("item_feed_uid", "filter_number"))
    fields = with_lookups(expression_fields(scoped, feeds, texts), texts, links, pages, tags)
    fields = fields.join(numbers, "item_feed_uid")
    conditions, compiler = [], Compiler(fields)
    for number, text in enumerate(texts):
        test = _compiled(compiler, text)
        if test is not None:
            conditions.append((SCOPE_FEED_FILTER, 0, (F.col("filter_number") == number) & test))
    return _expression_hits(fields, conditions)


def match_rules(
    items: DataFrame, feeds: DataFrame, rules: DataFrame, tags: DataFrame, as_of,
    links: DataFrame | None = None, pages: DataFrame | None = None,
) -> DataFrame:
    """All (item, rule) matches: item_uid, scope, rule_uid, side."""
    live = active_rules(rules, as_of)
    scoped = scope_keys(items, feeds)
    tokens = item_words(scoped)
    parts = together([
        lambda: match_keywords(tokens, live),
        lambda: match_wordless(scoped, live),
        lambda: match_phrases(scoped, live),
        lambda: match_tag(scoped, tags, live),
        lambda: match_author(scoped, live),
        lambda: match_expr(scoped, feeds, live, links, pages, tags),
        lambda: match_feed_filter(scoped, feeds, links, pages, tags),
    ])
    return reduce(DataFrame.unionByName, parts)


def first_rule(matches: DataFrame) -> DataFrame:
    """The deciding match: global before feed before feed filter, then rule order."""
    side_order = F.when(F.col("side") == "content", 1).otherwise(0)
    return (
        matches.groupBy("item_uid")
        .agg(F.min(F.struct("scope", "rule_uid", side_order.alias("o"), "side")).alias("m"))
        .select(
            "item_uid", "m.rule_uid", "m.side", (F.col("m.scope") == SCOPE_FEED_FILTER).alias("feed_filter_hit"),
        )
    )


def rate(items: DataFrame, first: DataFrame) -> DataFrame:
    """Filtered items get rating -2 and their rule; the others are unread.

    The verdicts are a narrow table; while its measured size allows, they go to the items, whose
    text then doesn't move.
    """
    verdicts = broadcast_if_small(first)
    joined = items.drop("item_rating", "item_rule_uid", "item_rule_side").join(verdicts, "item_uid", "left")
    hit = F.col("rule_uid").isNotNull()
    return joined.select(
        *[c for c in items.columns if c not in ("item_rating", "item_rule_uid", "item_rule_side")],
        F.when(hit, FILTERED).otherwise(UNREAD).alias("item_rating"),
        F.col("rule_uid").alias("item_rule_uid"),
        F.col("side").alias("item_rule_side"),
        F.coalesce("feed_filter_hit", F.lit(False)).alias("feed_filter_hit"),
    )


def verdict_changes(first: DataFrame) -> DataFrame:
    """The same as changes for a store (:mod:`feedloom.sources.item_store`): the filtered articles with their rules.

    At any number of verdicts no text moves: the store merges them in equal buckets.
    """
    return first.select(
        "item_uid", F.lit(FILTERED).alias("item_rating"), F.col("rule_uid").alias("item_rule_uid"), F.col("side").alias("item_rule_side")
    )


def make_rules(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Rules from what a reader typed.

    ``requests``: ``kw``, ``match``, ``target``, ``item_uid``, ``feed_only``.
    Words give one rule each, ``all`` one rule of the joined words; author,
    tag and phrase_lc are lower-cased; phrase stays as typed.
    """
    match, kw = F.col("match"), F.col("kw")
    typed = F.regexp_extract_all(fold(kw), F.lit(WORD), F.lit(0))
    texts = (
        F.when(match.isin("author", "tag", "phrase_lc"), F.array(F.lower(kw)))
        .when(match.isin("word", "exactword"), F.array_distinct(typed))
        .when(match == "all", F.array(F.array_join(F.array_sort(F.array_distinct(typed)), " ")))
        .when(match == "phrase", F.array(kw))
    )
    rule_type = F.when(match.isin("author", "tag"), match).otherwise(F.concat_ws("_", "target", match))
    feed_of = items.select("item_uid", F.col("item_feed_uid").alias("rule_feed_uid"))
    scoped = requests.where(F.coalesce(kw, F.lit("")) != "").withColumn(
        "item_uid", F.when(F.col("feed_only"), F.col("item_uid"))
    )
    return (
        scoped.join(feed_of, "item_uid", "left")
        .select(rule_type.alias("rule_type"), "rule_feed_uid", F.explode(texts).alias("rule_text"))
    )


def feed_of(item_uid: int, items: DataFrame) -> DataFrame:
    return items.where(F.col("item_uid") == item_uid).select("item_feed_uid")


def filtered_by_global(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items whose deciding rule is a global one."""
    glob = rules.where(F.col("rule_feed_uid").isNull()).select(F.col("rule_uid").alias("item_rule_uid"))
    return items.join(glob, "item_rule_uid", "left_semi")


#: What follows a place in running text: no end of a tag before the next tag begins.
OUTSIDE_TAGS = "(?![^<>]*>)"


def _word_pattern(word: str, stemmed: bool) -> str:
    """A regex for a whole word outside tags; for a stem, any word that begins with it (a final i may be a y)."""
    begins = r"(?<![\p{L}\p{N}])"
    if not stemmed:
        return f"{begins}{highlight_pattern(word)}(?![\\p{{L}}\\p{{N}}]){OUTSIDE_TAGS}"
    stem_form = highlight_pattern(word[:-1]) + "[iIyY]" if len(word) > 2 and word.endswith("i") else highlight_pattern(word)
    return rf"{begins}{stem_form}[\p{{L}}\p{{N}}]*+{OUTSIDE_TAGS}"


def highlight(view: DataFrame, rules: DataFrame) -> DataFrame:
    """Mark in each filtered article what its rule matched.

    Word and phrase rules wrap their first hit outside tags: words as a whole,
    stems with the rest of their word. Tag, author and expression rules add a footnote. A union rule marks the side that matched. The word
    patterns are built per rule, so rules come to the driver once.
    """
    spark = view.sparkSession
    rows = []
    texts = rules.select("rule_uid", "rule_type", "rule_text")
    keyed = texts.where(F.element_at(F.split("rule_type", "_", 2), -1).isin("word", "all")).select(F.explode(words(F.col("rule_text"))).alias("word"))
    stems = {r["word"]: r["stem"] for r in with_stem(keyed.distinct()).collect()}
    for rule in texts.collect():
        kind = rule["rule_type"].split("_", 1)
        text = rule["rule_text"] or ""
        if len(kind) == 2 and kind[1] in ("word", "exactword", "all"):
            found = _rule_word_list(text)
            if kind[1] != "exactword":
                patterns = [_word_pattern(s, True) for s in sorted({stems.get(w, w) for w in found})]
            else:
                patterns = [_word_pattern(w, False) for w in found]
        elif len(kind) == 2:
            patterns = [(java_quote(text) if kind[1] == "phrase" else "(?iu:" + java_quote(text) + ")") + OUTSIDE_TAGS]
        else:
            patterns = []
        side = kind[0] if len(kind) == 2 else None
        rows.append((rule["rule_uid"], side, patterns, rule["rule_type"], text.lower() if side is None else text))
    table = spark.createDataFrame(
        rows, "h_uid long, h_side string, h_patterns array<string>, h_type string, h_text string"
    )
    joined = view.join(table, view.item_rule_uid == F.col("h_uid"), "left")
    shown = F.col("item_rating") == FILTERED

    def marked(column: str, side: str) -> Column:
        here = shown & (
            (F.col("h_side") == side)
            | ((F.col("h_side") == "union") & (F.coalesce("item_rule_side", F.lit(side)) == side))
        )
        once = F.aggregate("h_patterns", F.col(column), _wrap_first)
        return F.when(here, once).otherwise(F.col(column))

    note = (
        F.when(F.col("h_type") == "tag", F.concat(
            F.lit('<br><p>Filtered for tag <span class="item tag highlighted">'), "h_text", F.lit("</span></p>")))
        .when(F.col("h_type") == "author", F.concat(
            F.lit('<br><p>Filtered for author <span class="author tag highlighted">'), "h_text", F.lit("</span></p>")))
        .when(F.col("h_type") == "python", F.concat(
            F.lit("<br><p>Filtered by rule "), F.col("h_uid").cast("string"), F.lit("</p>")))
        .when(F.col("item_rule_uid") == 0, F.lit("<br><p>Filtered by feed-specific rule</p>"))
    )
    content = marked("item_content", "content")
    content = F.when(shown & note.isNotNull(), F.concat(content, note)).otherwise(content)
    return joined.withColumns({"item_title": marked("item_title", "title"), "item_content": content}).select(
        *view.columns
    )


def _wrap_first(html: Column, pattern: Column) -> Column:
    return F.regexp_replace(
        html, F.concat(F.lit("(?s)^(.*?)("), pattern, F.lit(")")),
        F.lit('$1<span class="filter-highlight">$2</span>'),
    )


def _rule_word_list(text: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+(?:'[^\W_]+)*", fold_text(text))))
