"""Content cleaning: an ordered list of filters folded into one column.

A filter list becomes an array literal that Spark's ``aggregate`` folds over
each article, so the plan stays the same size whatever the number of filters
and nothing leaves the JVM. Before a pattern is tried the text is tested for
a literal the pattern cannot match without; most filters end there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import let
from feedloom.functions.html import first_link
from feedloom.operators.filter_list import DEFAULT_FILTERS

UNTITLED = "Untitled"


def java_regex(pattern: str, flags: str = "") -> str:
    """Python pattern as a Java one: newline-only line ends, inline flags.

    A repeated group of varying length recurses once per round in Java, which
    a long run of breaks would overflow; where nothing after the group can use
    what it gives back, it is made possessive and loops instead.
    """
    looping = re.sub(r"\((<br>\\s\*|-\\s\+)\)\+", r"(?:\1)++", pattern)
    return f"(?d{flags})" + looping


def java_template(template: str) -> str:
    """``\\1`` templates as ``$1`` ones."""
    return re.sub(r"\\(\d)", r"$\1", template.replace("$", r"\$"))


def required_literal(pattern: str, flags: str = "") -> str | None:
    """A text every match must contain, or None when none is certain.

    Plain runs outside groups, classes and optional parts qualify. Runs
    without markup are preferred, since they are the rarer ones.
    """
    if "i" in flags:
        return None
    outside = re.sub(r"\[\^?\]?[^\]]*\][*+?]*\??|\\.[*+?]*|\([^()]*\)[*+?]*", "\0", pattern)
    outside = re.sub(r".[*?]\??|\.[+]\??|[.^$|]", "\0", outside)
    runs = [r for r in outside.split("\0") if len(r) >= 3 and not re.search(r"[()\[\]{}+\\]", r)]
    if "|" in pattern or not runs:
        return None
    return max(runs, key=lambda r: ("<" not in r, len(r)))


def re_sub(text: Column, pattern: str, flags: str = "", sub: str = "", repeat: bool = False) -> Column:
    """Strip or rewrite by regex; ``repeat`` goes on until nothing matches.

    Each round of a repeated filter shortens the text, so its length bounds the rounds. A pattern that begins with a tag and leaves
    fewer of it than it takes has no more rounds than there are of these tags. Only rounds that change something look at the
    text; the others are skipped by the square root of their number at a time.
    """
    regex = java_regex(pattern, flags)
    template = java_template(sub)
    literal = required_literal(pattern, flags)

    def once(t: Column) -> Column:
        return F.regexp_replace(t, regex, template)

    def turn(state: Column) -> Column:
        old = state["text"]
        return let(once(old), lambda new: F.struct(new.alias("text"), (new != old).alias("going")))

    def all_rounds(t: Column) -> Column:
        opening = required_opening(pattern)
        fewer = opening.startswith("<") and pattern.count(opening) > sub.count(opening)
        rounds = F.regexp_count(t, F.lit(opening)) if fewer else F.length(t)
        side = F.sequence(F.lit(1), F.ceil(F.sqrt(F.greatest(rounds, F.lit(1)))).cast("int"))

        def while_going(state: Column, step) -> Column:
            return F.aggregate(side, state, lambda s, _: F.when(s["going"], step(s)).otherwise(s))

        start = F.struct(t.alias("text"), F.lit(True).alias("going"))
        return while_going(start, lambda s: while_going(s, turn))["text"]

    def guarded(t: Column) -> Column:
        done = all_rounds(t) if repeat else once(t)
        return F.when(F.contains(t, F.lit(literal)), done).otherwise(t) if literal else done

    return let(text, guarded)


def required_opening(pattern: str) -> str:
    """The plain text a pattern starts with."""
    return re.match(r"[^\[\](){}.*+?\\|^$]*", pattern).group()


def limit_to(link_part: str, link: Column, content: Column, apply) -> Column:
    """``apply(content)`` only where the item link contains a text."""
    inside = F.contains(F.coalesce(link, F.lit("")), F.lit(link_part))
    return let(content, lambda c: F.when(inside, apply(c)).otherwise(c))


def _expand(text: Column, pattern: str, template: str, flags: str = "") -> Column:
    """The template filled from the first match, null when there is none."""
    regex = java_regex(pattern, flags)
    parts: list[Column] = []
    for piece in re.split(r"(\\\d)", template):
        if re.fullmatch(r"\\\d", piece):
            parts.append(F.regexp_extract(text, regex, int(piece[1])))
        elif piece:
            parts.append(F.lit(piece))
    return F.when(text.rlike(regex), F.concat(*parts))


def re_url(
    link: Column, content: Column, template: str, regex_url: str | None = None, regex_content: str | None = None,
    flags: str = "",
) -> Column:
    """New link: from the link's own match, else from the content's, else unchanged."""
    options = []
    if regex_url:
        options.append(lambda known: _expand(known, regex_url, template, flags))
    if regex_content:
        options.append(lambda _: let(content, lambda c: _expand(c, regex_content, template, flags)))
    return let(link, lambda known: F.coalesce(*[option(known) for option in options], known))


def re_title(title: Column, content: Column, template: str, pattern: str, flags: str = "") -> Column:
    """Title taken from the content where it is empty or ``Untitled``."""
    def replaced(old: Column) -> Column:
        found = F.trim(let(content, lambda c: _expand(c, pattern, template, flags)))
        return F.when(old.isNull() | old.isin("", UNTITLED), F.coalesce(F.nullif(found, F.lit("")), old)).otherwise(old)

    return let(title, replaced)


def use_first_link(prefix: str, link: Column, content: Column) -> Column:
    return let(link, lambda old: F.when(old.startswith(prefix), F.coalesce(first_link(content), old)).otherwise(old))


def dereference(
    df: DataFrame, link_part: str, pattern: str, items: DataFrame | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Better link from the linked page, or the stored one of an article known by GUID.

    ``df`` has ``guid`` and ``link``; ``pages`` has ``url`` and ``html``. Only
    rows whose link contains ``link_part`` carry a join key, so the others
    are not drawn to one task by either join.
    """
    concerned = F.contains(F.coalesce("link", F.lit("")), F.lit(link_part))
    out = df.withColumns({"__guid": F.when(concerned, F.col("guid")), "__url": F.when(concerned, F.col("link"))})
    new = []
    if items is not None:
        known = items.groupBy(F.col("item_guid").alias("__guid")).agg(F.min("item_link").alias("__known"))
        out = out.join(known, "__guid", "left")
        new.append(F.col("__known"))
    if pages is not None:
        better = pages.where(F.contains("url", F.lit(link_part))).select(
            F.col("url").alias("__url"), F.nullif(F.regexp_extract("html", java_regex(pattern), 1), F.lit("")).alias("__better")
        ).groupBy("__url").agg(F.min("__better").alias("__better"))
        out = out.join(better, "__url", "left")
        new.append(F.col("__better"))
    return out.withColumn("link", F.coalesce(*new, "link")).select(*df.columns)


def _strips(filters: list[tuple]) -> Column:
    """Array literal of the strip filters: literal, regex, replacement."""
    rows = []
    for _, pattern, flags, sub, _ in filters:
        rows.append(F.struct(
            F.lit(required_literal(pattern, flags)).cast("string").alias("literal"),
            F.lit(java_regex(pattern, flags)).alias("regex"),
            F.lit(java_template(sub)).alias("sub"),
        ))
    return F.array(*rows)


def _fold(content: Column, filters: list[tuple]) -> Column:
    def step(text: Column, f: Column) -> Column:
        tried = F.regexp_replace(text, f["regex"], f["sub"])
        return F.when(f["literal"].isNull() | F.contains(text, f["literal"]), tried).otherwise(text)

    return F.aggregate(_strips(filters), content, step)


def clean(
    df: DataFrame,
    filters: list[tuple] | None = None,
    items: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Apply a filter list to columns ``content``, ``link`` and ``title``.

    Runs of plain strip filters become one fold; the filters that look at or
    change the link or title sit between them, so the order is kept. Filters
    that need other articles or pages are joins (``guid`` is then needed).
    """
    out = df
    run: list[tuple] = []

    def flush():
        nonlocal out, run
        if run:
            out = out.withColumn("content", _fold(F.col("content"), run))
            run = []

    for spec in DEFAULT_FILTERS if filters is None else filters:
        kind = spec[0]
        if kind == "strip" and not spec[4]:
            run.append(spec)
            continue
        flush()
        content, link, title = F.col("content"), F.col("link"), F.col("title")
        if kind == "strip":
            out = out.withColumn("content", re_sub(content, *spec[1:]))
        elif kind == "limit":
            inner = spec[2][1:]
            out = out.withColumn("content", limit_to(spec[1], link, content, lambda c: re_sub(c, *inner)))
        elif kind == "link":
            out = out.withColumn("link", re_url(link, content, *spec[1:]))
        elif kind == "title":
            out = out.withColumn("title", re_title(title, content, *spec[1:]))
        elif kind == "first_link":
            out = out.withColumn("link", use_first_link(spec[1], link, content))
        elif kind == "dereference":
            out = dereference(out, spec[1], spec[2], items, pages) if items is not None or pages is not None else out
        else:
            raise ValueError(f"unknown filter kind {kind!r}")
    flush()
    return out
