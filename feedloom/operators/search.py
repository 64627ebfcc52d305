"""Token search: a web-style query becomes one boolean column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import TOKEN, fold, query_tokens, token_text

_PIECE = re.compile(r'(?:AND|OR|NOT)(?=[\s("]|$)|[()]|"[^"]*"?|[^\s()"]+(?:"[^"]*"?)?')
_OPERATORS = ("AND", "OR", "NOT")


def _pieces(query: str) -> list[tuple[str, str, str]]:
    """(kind, value, text before) of each operator, parenthesis and phrase."""
    out, end = [], 0
    for match in _PIECE.finditer(query):
        text = match.group()
        kind = "op" if text in _OPERATORS or text in "()" else "phrase"
        value = text if kind == "op" else text.replace('"', "")
        out.append((kind, value, query[end:match.start()]))
        end = match.end()
    return out


def quote_query(query: str) -> str:
    """The query with every word and phrase in double quotes."""
    return "".join(gap + (value if kind == "op" else f'"{value}"') for kind, value, gap in _pieces(query))


def parse_search(query: str):
    """Query as nested tuples: ``("phrase", tokens)``, ``("AND"|"OR"|"NOT", left, right)``.

    Phrases side by side bind tightest, then NOT (binary), then AND, then OR.
    Returns None for a query without any token; raises ValueError if malformed.
    """
    pieces = [(kind, value) for kind, value, _ in _pieces(query)]
    levels = ("OR", "AND", "NOT")

    def operand(i):
        kind, value = pieces[i] if i < len(pieces) else ("op", "end")
        if (kind, value) == ("op", "("):
            tree, i = chain(i + 1, 0)
            if i >= len(pieces) or pieces[i] != ("op", ")"):
                raise ValueError(f"unbalanced parenthesis in {query!r}")
            return tree, i + 1
        if kind == "op":
            raise ValueError(f"phrase expected at {value!r} in {query!r}")
        tokens = query_tokens(value)
        return (("phrase", tokens) if tokens else None), i + 1

    def side_by_side(i):
        tree, i = operand(i)
        while i < len(pieces) and (pieces[i][0] == "phrase" or pieces[i] == ("op", "(")):
            right, i = operand(i)
            tree = right if tree is None else tree if right is None else ("AND", tree, right)
        return tree, i

    def chain(i, level):
        if level == len(levels):
            return side_by_side(i)
        tree, i = chain(i, level + 1)
        while i < len(pieces) and pieces[i] == ("op", levels[level]):
            right, i = chain(i + 1, level + 1)
            tree = (levels[level], tree, right)
        return tree, i

    if not pieces:
        return None
    tree, i = chain(0, 0)
    if i != len(pieces):
        raise ValueError(f"unbalanced parenthesis in {query!r}")
    return tree


def search_column(tree, texts: list[Column]) -> Column:
    """Boolean column of a query tree; a phrase must lie within one of the texts."""
    if tree is None:
        return F.lit(False)
    if tree[0] == "phrase":
        needle = F.lit(" " + " ".join(tree[1]) + " ")
        out = F.lit(False)
        for text in texts:
            out = out | F.contains(text, needle)
        return out
    left, right = search_column(tree[1], texts), search_column(tree[2], texts)
    return left & right if tree[0] == "AND" else left | right if tree[0] == "OR" else left & ~right


def search_tokens(items: DataFrame, query: str, search_in: str = "title") -> DataFrame:
    """Items matching a query; ``search_in="title"`` leaves the content out.

    Each text is tokenised once per row, whatever the size of the query.
    """
    tree = parse_search(query)
    columns = {"__title": token_text(F.col("item_title"))}
    if search_in != "title":
        columns["__content"] = token_text(F.col("item_content"))
    tokenised = items.withColumns(columns)
    return tokenised.where(search_column(tree, [F.col(c) for c in columns])).drop(*columns)


def search_many(items: DataFrame, searches: list[tuple[str, str]]) -> DataFrame:
    """(search, item_uid) for a list of (query, search_in), in one pass over the text.

    A malformed query matches nothing.
    """
    texts = {"__title": token_text(F.col("item_title")), "__content": token_text(F.col("item_content"))}
    title, content = F.col("__title"), F.col("__content")
    tests = []
    for i, (query, search_in) in enumerate(searches):
        try:
            tree = parse_search(query)
        except ValueError:
            continue
        test = search_column(tree, [title] if search_in == "title" else [title, content])
        tests.append(F.when(test, F.lit(i)))
    return items.withColumns(texts).select(
        F.explode_outer(F.array_compact(F.array(*tests))).alias("search"), "item_uid"
    ).where(F.col("search").isNotNull())


def token_table(items: DataFrame) -> DataFrame:
    """(item_uid, field, token): the distinct search tokens of each item.

    Duplicates go inside the row, so nothing is shuffled.
    """
    def tokens(text: str) -> Column:
        return F.array_distinct(
            F.regexp_extract_all(fold(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
        )

    fields = F.array(
        F.struct(F.lit("title").alias("field"), tokens("item_title").alias("ts")),
        F.struct(F.lit("content").alias("field"), tokens("item_content").alias("ts")),
    )
    return items.select("item_uid", F.explode_outer(fields).alias("f")).select(
        "item_uid", "f.field", F.explode("f.ts").alias("token")
    )


def update_tokens(tokens: DataFrame, changes: DataFrame) -> DataFrame:
    """Token table after inserts, updates and deletes.

    ``changes`` has one row per changed item: ``item_uid``, the new
    ``item_title`` and ``item_content``, and ``deleted``. Only changed items
    are tokenised again.
    """
    kept = tokens.join(changes.select("item_uid"), "item_uid", "left_anti")
    return kept.unionByName(token_table(changes.where(~F.col("deleted"))))
