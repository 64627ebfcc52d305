"""Filtering rules: each kind of match, the verdict, and rule upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import html as H
from feedloom.functions import rule_helpers as RH
from feedloom.operators import links as L
from feedloom.operators import maintain as M
from feedloom.operators import rules as R
from feedloom.plans.model import AS_OF, NOW, sql_text, with_model, words_sql
from feedloom.plans.stem_sql import stem_ctes


def _scoped(m):
    return R.scope_keys(m.texts, m.feeds)


def _live(m):
    return R.active_rules(m.rules, AS_OF)


def _tokens(m):
    return R.item_words(_scoped(m))


LIVE_SQL = f"""
live AS (SELECT * FROM rules WHERE rule_expires IS NULL OR rule_expires > {NOW}),
parts AS (
  SELECT rule_uid, rule_feed_uid, rule_text,
    CASE WHEN contains(rule_type, '_') THEN substr(rule_type, strpos(rule_type, '_') + 1) ELSE rule_type END AS match,
    unnest(CASE WHEN prefix(rule_type, 'union_') THEN ['title', 'content']
      WHEN contains(rule_type, '_') THEN [left(rule_type, strpos(rule_type, '_') - 1)] ELSE [NULL] END) AS side
  FROM live
),
scoped AS (SELECT i.*, coalesce(feed_exempt, FALSE) AS exempt FROM items i LEFT JOIN feeds ON item_feed_uid = feed_uid),
words AS (
  SELECT item_uid, item_feed_uid, exempt, 'title' AS side, unnest({words_sql('item_title')}) AS word FROM scoped
  UNION ALL
  SELECT item_uid, item_feed_uid, exempt, 'content', unnest({words_sql('item_content')}) FROM scoped
)"""
SCOPE = "(CASE WHEN rule_feed_uid IS NULL THEN NOT exempt ELSE rule_feed_uid = item_feed_uid END)"
RANK = "CASE WHEN rule_feed_uid IS NULL THEN 0 ELSE 1 END"
STEMS_SQL = f"""
keyed AS (SELECT rule_uid, rule_feed_uid, side, match, unnest({words_sql('rule_text')}) AS word FROM parts
  WHERE match IN ('word', 'exactword', 'all')),
vocab AS (SELECT DISTINCT word FROM words UNION SELECT word FROM keyed),
{stem_ctes('vocab', 'stems')},
stemmed AS (SELECT w.*, stem FROM words w JOIN stems USING (word)),
keyed_stems AS (SELECT DISTINCT k.rule_uid, rule_feed_uid, side, match, stem FROM keyed k JOIN stems USING (word))"""
MATCHES = {
    "exactword": f"""SELECT DISTINCT item_uid, {RANK} AS scope, rule_uid, w.side FROM words w JOIN keyed k
      ON w.word = k.word AND w.side = k.side AND k.match = 'exactword' WHERE {SCOPE}""",
    "word": f"""SELECT DISTINCT item_uid, {RANK} AS scope, rule_uid, w.side FROM stemmed w JOIN keyed_stems k
      ON w.stem = k.stem AND w.side = k.side AND k.match = 'word' WHERE {SCOPE}""",
    "all": f"""SELECT item_uid, {RANK} AS scope, rule_uid, k.side FROM stemmed w JOIN keyed_stems k
      ON w.stem = k.stem AND w.side = k.side AND k.match = 'all' WHERE {SCOPE}
      GROUP BY item_uid, rule_feed_uid, rule_uid, k.side HAVING count(DISTINCT k.stem) =
        (SELECT count(*) FROM keyed_stems n WHERE n.rule_uid = k.rule_uid AND n.side = k.side AND n.match = 'all')""",
    "wordless": f"""SELECT item_uid, {RANK} AS scope, min(rule_uid) AS rule_uid, min(side) AS side FROM scoped JOIN parts
      ON match = 'all' AND len({words_sql('rule_text')}) = 0 AND {SCOPE} GROUP BY item_uid, {RANK}""",
    "phrase": f"""SELECT item_uid, {RANK} AS scope, rule_uid, side FROM scoped JOIN parts ON match = 'phrase'
      AND contains(CASE side WHEN 'title' THEN item_title ELSE item_content END, rule_text) WHERE {SCOPE}""",
    "phrase_lc": f"""SELECT item_uid, {RANK} AS scope, rule_uid, side FROM scoped JOIN parts ON match = 'phrase_lc'
      AND contains(lower(CASE side WHEN 'title' THEN item_title ELSE item_content END), rule_text) WHERE {SCOPE}""",
    "tag": f"""SELECT DISTINCT item_uid, {RANK} AS scope, rule_uid, CAST(NULL AS VARCHAR) AS side FROM scoped
      JOIN tags ON tag_item_uid = item_uid JOIN live ON rule_type = 'tag' AND lower(rule_text) = tag_name WHERE {SCOPE}""",
    "author": f"""SELECT item_uid, {RANK} AS scope, rule_uid, CAST(NULL AS VARCHAR) AS side FROM scoped
      JOIN live ON rule_type = 'author' AND rule_text = lower(item_creator) WHERE {SCOPE}""",
    # The texts of rules 22, 23, 34 and 38; rule 24 names an unknown field, rule 25 casts text that is no number, rule 35 takes
    # the element number zero of some title, and rules 27 to 33, 36 and 37 are refused.
    "expr": f"""SELECT item_uid, 0 AS scope, 22 AS rule_uid, CAST(NULL AS VARCHAR) AS side FROM scoped
      WHERE NOT exempt AND length(item_content) > 20000
        AND item_uid IN (SELECT item_uid FROM stemmed WHERE side = 'title' AND stem IN ('the', 'of'))
      UNION ALL SELECT item_uid, 1, 34, NULL FROM scoped
      WHERE item_feed_uid = 12 AND item_uid IN (SELECT item_uid FROM stemmed WHERE side = 'title' AND stem IN ('the', 'ere'))
        AND item_uid IN (SELECT tag_item_uid FROM tags WHERE tag_name = 'en')
      UNION ALL SELECT item_uid, 1, 38, NULL FROM scoped
      WHERE item_feed_uid = 18 AND prefix(lower(split_part(item_title, ' ', 1)), 'th')
      UNION ALL SELECT item_uid, 1, 23, NULL FROM scoped
      WHERE item_feed_uid = 16 AND (contains(lower(item_title), 'ous') OR contains(lower(item_title), 'ent'))""",
    "feed_filter": """SELECT item_uid, 2 AS scope, 0 AS rule_uid, CAST(NULL AS VARCHAR) AS side
      FROM items JOIN feeds ON item_feed_uid = feed_uid WHERE feed_filter IS NOT NULL AND length(item_title) > 200""",
}
NEEDS = ("rules", "items", "feeds", "tags")


def matches_sql(kind: str) -> str:
    return with_model(MATCHES[kind], *NEEDS, extra=LIVE_SQL + "," + STEMS_SQL)


ALL_MATCHES_SQL = "matches AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({q})" for q in MATCHES.values()) + ")"
FIRST_SQL = """first AS (
  SELECT item_uid, scope, rule_uid, side FROM (
    SELECT *, row_number() OVER (PARTITION BY item_uid ORDER BY scope, rule_uid, CASE side WHEN 'content' THEN 1 ELSE 0 END) AS n
    FROM matches) WHERE n = 1)"""
VERDICT_CTES = ",".join((LIVE_SQL, STEMS_SQL, ALL_MATCHES_SQL, FIRST_SQL))


def _match_all_rules(m):
    return R.match_rules(m.texts, m.feeds, m.rules, m.tags, AS_OF)


def _requests(m):
    """Rule requests as readers would make them: each passage's words, for each kind."""
    b = m.table("benchmark")
    kinds = F.array(*[F.lit(k) for k in ("word", "exactword", "all", "phrase", "phrase_lc", "tag", "author", "bogus")])
    return b.select(
        F.col("text").alias("kw"), F.explode(kinds).alias("match"), F.lit("title").alias("target"),
        F.col("item_id").alias("item_uid"), (F.col("item_id") % 2 == 0).alias("feed_only"))


LOOKUP_RULES = [
    (31, "python", None, None, "link_already AND length(title) > 5"),
    (32, "python", 2, None, "contains(page_text, 'tion') AND NOT link_already"),
]


def _lookups(m):
    """Rules on known links and on stored pages; half of the articles have a page: their own text."""
    rules = m.spark.createDataFrame(
        LOOKUP_RULES, "rule_uid long, rule_type string, rule_feed_uid long, rule_expires timestamp, rule_text string")
    pages = m.items.where("item_rating <> 1").select(F.col("item_link").alias("url"), F.col("item_title").alias("html"))
    return R.match_expr(_scoped(m), m.feeds, rules, m.stored.select(F.col("item_link").alias("link")), pages)


def _probes(m):
    """Page addresses without query and fragment: seen if a stored address starts so."""
    return m.table("pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).unionByName(
        m.items.select(F.substring_index("item_link", "/", 3).alias("url")))


def _marked(text: str, word: str, begins: bool = False) -> str:
    """The first whole ``word`` outside tags wrapped, or one that ``begins`` so: whatever comes before it is tags and other characters."""
    before = r"(?:(?:<[^>]*>|[^<])*?(?:<[^>]*>|[^\p{L}\p{N}<]))?"
    rest = r"[\p{L}\p{N}]*" if begins else ""
    pattern = f"(?s)^({before})({H.highlight_pattern(word)}{rest})([^\\p{{L}}\\p{{N}}]|$)"
    return f"regexp_replace({text}, {sql_text(pattern)}, '\\1<span class=\"filter-highlight\">\\2</span>\\3')"


def _marked_all(text: str, *stems: str) -> str:
    for stem in stems:
        text = _marked(text, stem, True)
    return text


def _sides(target: str) -> tuple[str, ...]:
    return ("title", "content") if target == "union" else (target,)


def _helper_sql(side: str, form: str) -> str:
    if form == "words":
        return f"item_uid IN (SELECT item_uid FROM stemmed WHERE side = '{side}' AND stem IN ('tion', 'für', 'The', 'er'))"
    text = f"lower(item_{side})" if form == "lc" else f"item_{side}"
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in ("tion", "für", "The")) + ")"


QUERIES = {
    "match_exactword": (lambda m: R.match_exactword(_tokens(m), _live(m)), matches_sql("exactword")),
    "match_word": (lambda m: R.match_word(_tokens(m), _live(m)), matches_sql("word")),
    "match_all": (
        lambda m: R.match_all(_tokens(m), _live(m), _scoped(m)),
        with_model(f"SELECT * FROM ({MATCHES['all']}) UNION ALL SELECT * FROM ({MATCHES['wordless']})", *NEEDS,
                   extra=LIVE_SQL + "," + STEMS_SQL)),
    "match_phrase": (lambda m: R.match_phrase(_scoped(m), _live(m)), matches_sql("phrase")),
    "match_phrase_lc": (lambda m: R.match_phrase_lc(_scoped(m), _live(m)), matches_sql("phrase_lc")),
    "match_tag": (lambda m: R.match_tag(_scoped(m), m.tags, _live(m)), matches_sql("tag")),
    "match_author": (lambda m: R.match_author(_scoped(m), _live(m)), matches_sql("author")),
    "match_expression": (lambda m: R.match_expr(_scoped(m), m.feeds, _live(m), tags=m.tags), matches_sql("expr")),
    "rule_lookups": (
        _lookups,
        with_model("""SELECT item_uid, 0 AS scope, 31 AS rule_uid, CAST(NULL AS VARCHAR) AS side FROM looked
          WHERE NOT exempt AND seen AND length(item_title) > 5
        UNION ALL SELECT item_uid, 1, 32, NULL FROM looked
          LEFT JOIN (SELECT item_link, max(item_title) AS html FROM items WHERE item_rating <> 1 GROUP BY 1) p USING (item_link)
          WHERE item_feed_uid = 2 AND contains(coalesce(html, ''), 'tion') AND NOT seen""", *NEEDS,
                   extra=LIVE_SQL + """,
          looked AS (SELECT *, coalesce(contains((SELECT min(j.item_link) FROM items j WHERE j.item_rating IN (1, -1)
            AND j.item_link >= s.item_link), s.item_link), FALSE) AS seen FROM scoped s)""")),
    "match_feed_filter": (lambda m: R.match_feed_filter(_scoped(m), m.feeds), matches_sql("feed_filter")),
    "expand_targets": (
        lambda m: R.expand_targets(_live(m)).where("side IS NOT NULL").select("rule_uid", "side", "match", RH.clean_rule(F.col("rule_text")).alias("rule_text")),
        with_model("""SELECT rule_uid, side, match, trim(translate(regexp_replace(rule_text, '(?m)^#.*$', '', 'g'), chr(10) || chr(13), '  ')) AS rule_text
        FROM parts WHERE side IS NOT NULL""", *NEEDS, extra=LIVE_SQL)),
    "match_rules": (
        _match_all_rules,
        with_model("SELECT * FROM matches", *NEEDS, extra=",".join((LIVE_SQL, STEMS_SQL, ALL_MATCHES_SQL)))),
    "first_rule": (
        lambda m: R.first_rule(_match_all_rules(m)),
        with_model("SELECT item_uid, rule_uid, side, scope = 2 AS feed_filter_hit FROM first", *NEEDS, extra=VERDICT_CTES)),
    "rate": (
        lambda m: R.rate(m.texts, R.first_rule(_match_all_rules(m))).select(
            "item_uid", "item_title", "item_rating", "item_rule_uid", "item_rule_side", "feed_filter_hit"),
        with_model("""SELECT item_uid, item_title, CASE WHEN rule_uid IS NULL THEN 0 ELSE -2 END AS item_rating,
          rule_uid AS item_rule_uid, side AS item_rule_side, coalesce(scope = 2, FALSE) AS feed_filter_hit
        FROM items LEFT JOIN first USING (item_uid)""", *NEEDS, extra=VERDICT_CTES)),
    "highlight": (
        # Every kind of rule that filters an article.
        lambda m: R.highlight(R.rate(m.texts, R.first_rule(_match_all_rules(m))), m.rules).where("item_rating = -2").select(
            "item_uid", F.coalesce("item_rule_uid", F.lit(0)).alias("item_rule_uid"), F.col("item_content").alias("content"),
            F.contains("item_title", F.lit('<span class="filter-highlight">')).alias("in_title")),
        with_model(f"""SELECT item_uid, f.rule_uid AS item_rule_uid,
          CASE WHEN scope = 2 THEN item_content || '<br><p>Filtered by feed-specific rule</p>'
            WHEN rule_type = 'python' THEN item_content || '<br><p>Filtered by rule ' || f.rule_uid || '</p>'
            WHEN rule_type = 'tag' THEN item_content || '<br><p>Filtered for tag <span class="item tag highlighted">' || lower(rule_text) || '</span></p>'
            WHEN rule_type = 'author' THEN item_content || '<br><p>Filtered for author <span class="author tag highlighted">' || lower(rule_text) || '</span></p>'
            WHEN contains(rule_type, 'phrase') AND side = 'content' THEN
              left(item_content, place - 1) || '<span class="filter-highlight">' || substr(item_content, place, length(rule_text)) || '</span>'
                || substr(item_content, place + length(rule_text))
            WHEN f.rule_uid = 2 THEN {_marked_all('item_content', 'disgust', 'ering')}
            WHEN f.rule_uid = 5 THEN {_marked(_marked('item_content', 'elle'), 'para')}
            WHEN f.rule_uid = 6 AND side = 'content' THEN {_marked('item_content', 'nicht')}
            WHEN f.rule_uid = 8 THEN {_marked_all('item_content', 'ere', 'one', 'thes')}
            WHEN f.rule_uid = 9 AND side = 'content' THEN {_marked_all('item_content', 'sich', 'und')}
            ELSE item_content END AS content,
          CASE WHEN f.rule_uid = 1 THEN item_title <> {_marked('item_title', 'one', True)} ELSE coalesce(side = 'title', FALSE) END AS in_title
        FROM (SELECT f.*, i.*, r.rule_type, r.rule_text, CASE WHEN rule_type LIKE '%phrase' THEN strpos(item_content, rule_text)
            WHEN rule_type LIKE '%phrase_lc' THEN strpos(lower(item_content), rule_text) END AS place
          FROM first f JOIN items i USING (item_uid) LEFT JOIN rules r ON r.rule_uid = f.rule_uid) f""", *NEEDS, extra=VERDICT_CTES)),
    "make_rules": (
        lambda m: R.make_rules(_requests(m), m.items),
        with_model(f"""SELECT CASE WHEN match IN ('tag', 'author') THEN match ELSE 'title_' || match END AS rule_type,
          item_feed_uid AS rule_feed_uid, unnest(CASE WHEN match IN ('author', 'tag', 'phrase_lc') THEN [lower(kw)]
            WHEN match IN ('word', 'exactword') THEN {words_sql('kw')}
            WHEN match = 'all' THEN [array_to_string(list_sort({words_sql('kw')}), ' ')]
            WHEN match = 'phrase' THEN [kw] ELSE [] END) AS rule_text
        FROM (SELECT text AS kw, item_id, unnest(['word', 'exactword', 'all', 'phrase', 'phrase_lc', 'tag', 'author', 'bogus']) AS match
          FROM benchmark) LEFT JOIN items ON item_uid = item_id AND item_id % 2 = 0""", "items")),
    "feed_of_item": (lambda m: R.feed_of(42, m.items), with_model("SELECT item_feed_uid FROM items WHERE item_uid = 42", "items")),
    "filtered_by_global": (
        lambda m: R.filtered_by_global(m.items, m.rules.where("rule_uid <> 12")).select("item_uid", "item_rule_uid"),
        with_model("""SELECT item_uid, item_rule_uid FROM items WHERE EXISTS (SELECT 1 FROM rules
          WHERE rule_feed_uid IS NULL AND rule_uid = item_rule_uid AND rule_uid <> 12)""", "items", "rules")),
    "exempt_feed": (
        lambda m: M.exempt_feed(m.items, m.rules, 3).select("item_uid", "item_rating", "item_rule_uid"),
        with_model("""SELECT item_uid, CASE WHEN freed THEN 0 ELSE item_rating END AS item_rating,
          CASE WHEN NOT freed THEN item_rule_uid END AS item_rule_uid FROM (SELECT *, item_feed_uid = 3 AND item_content <> '' AND
            coalesce(item_rule_uid IN (SELECT rule_uid FROM rules WHERE rule_feed_uid IS NULL), FALSE) AS freed FROM items)""",
                   "items", "rules")),
    "delete_rule": (
        lambda m: M.delete_rule(M.clear_old_content(m.items, AS_OF, 200), m.rules, 12)[0].select(
            "item_uid", "item_rating", "item_rule_uid", "item_content"),
        with_model("""SELECT item_uid, CASE WHEN item_rule_uid = 12 THEN 0 ELSE item_rating END AS item_rating,
          CASE WHEN item_rule_uid <> 12 THEN item_rule_uid END AS item_rule_uid, content AS item_content
        FROM (SELECT *, CASE WHEN item_rating < 0 AND item_created < TIMESTAMP '2023-07-15 00:00:00' THEN '' ELSE item_content END AS content
          FROM items) WHERE NOT (coalesce(item_rule_uid = 12, FALSE) AND content = '')""", "items")),
    "delete_rule_rules": (
        lambda m: M.delete_rule(m.items, m.rules, 1002)[1].select("rule_uid", "rule_text"),
        with_model("SELECT rule_uid, rule_text FROM rules WHERE rule_uid <> 1002", "rules")),
    "update_rules": (
        lambda m: M.update_rules(m.rules, m.table("benchmark").select(
            (F.col("item_id") + 1000).alias("rule_uid"), F.concat("text", F.lit("!")).alias("rule_text"),
            F.lit("2024-06-01 00:00:00").cast("timestamp").alias("rule_expires"))).select(
            "rule_uid", "rule_text", F.date_format("rule_expires", "yyyy-MM-dd").alias("rule_expires")),
        with_model("""SELECT rule_uid, coalesce(text || '!', rule_text) AS rule_text,
          strftime(CASE WHEN text IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE rule_expires END, '%Y-%m-%d') AS rule_expires
        FROM rules LEFT JOIN benchmark ON rule_uid = item_id + 1000""", "rules")),
    "check_rules": (
        lambda m: R.check_rules(m.rules, R.rule_fields(m.spark)).select("rule_uid", "rule_text"),
        with_model("""SELECT rule_uid, rule_text FROM rules WHERE rule_type = 'python' AND regexp_matches(rule_text,
          'no_such_field|rlike .[(]|(raise_error|count|explode|row_number|sequence)[(]|to_date[(][^()]*,')""", "rules")),
    "active_rules": (
        lambda m: R.active_rules(m.rules, AS_OF).select("rule_uid", "rule_type"),
        with_model(f"SELECT rule_uid, rule_type FROM rules WHERE rule_expires IS NULL OR rule_expires > {NOW}", "rules")),
    "link_seen": (
        lambda m: L.link_seen(_probes(m), m.table("pages").select(F.col("url").alias("link")).unionByName(
            m.items.where("item_rating <> 0").select(F.col("item_link").alias("link")))),
        with_model("""SELECT DISTINCT p.url FROM
          (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages UNION
           SELECT array_to_string(list_slice(string_split(item_link, '/'), 1, 3), '/') FROM items) p
        WHERE contains((SELECT min(link) FROM (SELECT url AS link FROM pages UNION SELECT item_link FROM items WHERE item_rating <> 0)
          WHERE link >= p.url), p.url)""", "items")),
    "link_extract": (
        lambda m: m.pages.select("page_id", H.link_extract("the", F.col("html")).alias("the"),
                                 H.link_extract("The", F.col("html")).alias("cased")),
        with_model("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<a [^>]*href="([^"]*)"[^>]*>the</a>', 1), ''), 'NOT MATCHED') AS the,
          coalesce(nullif(regexp_extract(html, '<a [^>]*href="([^"]*)"[^>]*>The</a>', 1), ''), 'NOT MATCHED') AS cased FROM web""", "pages")),
    "membership_helpers": (
        lambda m: R.with_rule_fields(m.texts).select(
            "item_uid", *[RH.any_of(t, f, ["tion", "für", "The"] + ["er"] * (f == "words")).alias(f"{t}_any" + (f"_{f}" if f else ""))
                          for t in ("title", "content", "union") for f in ("", "lc", "words")]),
        with_model("SELECT item_uid, " + ", ".join(
            f"({' OR '.join(_helper_sql(s, f) for s in _sides(t))}) AS {t}_any{'_' + f if f else ''}"
            for t in ("title", "content", "union") for f in ("", "lc", "words")) + " FROM items", *NEEDS, extra=LIVE_SQL + "," + STEMS_SQL)),
}
