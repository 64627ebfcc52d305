"""Word sets and search tokens, built from JVM-side string functions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.binding import let

# Letters that have no canonical decomposition.
LIGATURES = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i",
}
#: A word is a run of letters and digits; apostrophes may join two runs.
WORD = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
#: A search token never holds an apostrophe.
TOKEN = r"[\p{L}\p{N}]+"
TAG = "<[^>]*>"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(from, to) for ``translate``: accented lower-case Latin to its base letter.

    Derived from canonical decompositions. Combining marks come last and have
    no counterpart, so ``translate`` deletes them.
    """
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        if char != char.lower():
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1 and base.isascii():
            source.append(char)
            target.append(base)
    for char, base in LIGATURES.items():
        if len(base) == 1:
            source.append(char)
            target.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower-case and strip diacritics."""
    def folded(known: Column) -> Column:
        out = F.translate(F.lower(known), *fold_table())
        for char, base in LIGATURES.items():
            if len(base) > 1:
                out = F.replace(out, F.lit(char), F.lit(base))
        # A text of as many bytes as characters has nothing to strip.
        return F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(out)

    return let(text, folded)


def fold_text(text: str) -> str:
    """Driver-side twin of :func:`fold` for queries and rule texts."""
    source, target = fold_table()
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    out = text.lower().translate(table)
    for char, base in LIGATURES.items():
        out = out.replace(char, base)
    return out


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def words(text: Column) -> Column:
    """Distinct lower-cased, diacritic-free words of a text, tags left out."""
    return F.array_distinct(
        F.regexp_extract_all(fold(strip_tags(F.coalesce(text, F.lit("")))), F.lit(WORD), F.lit(0))
    )


def token_text(text: Column) -> Column:
    """Search tokens in order as one string, each with a space on both sides.

    A phrase test is then a substring test: `` a b `` in `` x a b y ``.
    """
    tokens = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def query_tokens(phrase: str) -> list[str]:
    """Driver-side tokens of a query phrase."""
    return re.findall(r"[^\W_]+", fold_text(phrase))
