"""Helpers offered to expression rules, as columns and as SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.stemming import any_stem


def _any_in(text: Column, wanted: Column) -> Column:
    return F.exists(wanted, lambda w: F.contains(text, w))


def any_of(target: str, form: str, wanted: list[str] | Column) -> Column:
    """``{title,content,union}_any{,_lc,_words}`` as a column.

    ``form`` is ``""`` (as written), ``"lc"`` (lower case) or ``"words"``
    (word set). The item must carry ``title``/``content`` plus the ``_lc`` or
    ``_words`` columns (``_words_exact`` where ``wanted`` is a list) that
    :func:`feedloom.operators.rules.with_rule_fields` adds.
    """
    if form == "words" and not isinstance(wanted, Column):
        return _any_side(target, "_words_exact", lambda words: any_stem(words, wanted))
    words = wanted if isinstance(wanted, Column) else F.array(*[F.lit(w) for w in wanted])
    suffix = f"_{form}" if form else ""
    test = F.arrays_overlap if form == "words" else _any_in
    return _any_side(target, suffix, lambda field: test(field, words))


def _any_side(target: str, suffix: str, test: Callable[[Column], Column]) -> Column:
    sides = ("title", "content") if target == "union" else (target,)
    out = F.lit(False)
    for side in sides:
        out = out | test(F.col(side + suffix))
    return out


def register_helpers(spark: SparkSession) -> None:
    """Create the helpers as temporary SQL functions for use in rule text.

    ``any_in(text, words)`` and ``any_word(word_set, words)`` cover the nine
    membership helpers; ``link_extract(text, content)`` finds a link by its
    anchor. ``link_already`` and ``page_text`` are columns joined in
    beforehand, see :mod:`feedloom.operators.rules`.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION any_in(t STRING, w ARRAY<STRING>) RETURNS BOOLEAN "
        "RETURN exists(w, x -> contains(t, x))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION any_word(s ARRAY<STRING>, w ARRAY<STRING>) RETURNS BOOLEAN "
        "RETURN arrays_overlap(s, w)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION link_extract(label STRING, html STRING) RETURNS STRING RETURN "
        "coalesce(nullif(regexp_extract(try_element_at(filter("
        "regexp_extract_all(coalesce(html, ''), '(?is)<a\\\\b[^>]*>.*?</a\\\\s*>', 0), "
        "a -> regexp_replace(a, '<[^>]*>', '') = label), 1), "
        "'(?is)^<a\\\\b[^>]*?\\\\shref\\\\s*=\\\\s*[\"\\']?([^\"\\'>\\\\s]*)', 1), ''), 'NOT MATCHED')"
    )


def clean_rule(text: Column) -> Column:
    """Drop comment lines, join the rest into one line."""
    bare = F.regexp_replace(text, "(?m)^#.*$", "")
    return F.trim(F.translate(bare, "\n\r", "  "))


def rule_kind(rule_type: Column) -> tuple[Column, Column]:
    """(target, match) of a rule type; a type without a target gives null."""
    parts = F.split(rule_type, "_", 2)
    keyed = F.size(parts) == 2
    return F.when(keyed, parts[0]), F.when(keyed, F.try_element_at(parts, F.lit(2))).otherwise(rule_type)
