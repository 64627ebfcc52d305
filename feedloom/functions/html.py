"""Functions over HTML fragments and URLs."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import fold_table

NOT_MATCHED = "NOT MATCHED"
HIGHLIGHT_OPEN = '<span class="filter-highlight">'
HIGHLIGHT_CLOSE = "</span>"
HREF_OR_SRC = '(?:href|src)="([^"]*)"'


def link_extract(text: str | Column, content: Column) -> Column:
    """Target of the first link whose anchor text equals ``text``.

    Anchors are compared with their tags removed. A first matching anchor
    without a target counts as not matched.
    """
    label = F.lit(text) if isinstance(text, str) else text
    anchors = F.regexp_extract_all(
        F.coalesce(content, F.lit("")), F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0)
    )
    first = F.try_element_at(
        F.filter(anchors, lambda a: F.regexp_replace(a, "<[^>]*>", "") == label), F.lit(1)
    )
    href = F.regexp_extract(first, r"""(?is)^<a\b[^>]*?\shref\s*=\s*["']?([^"'>\s]*)""", 1)
    return F.when(first.isNull() | (href == ""), F.lit(NOT_MATCHED)).otherwise(href)


def first_link(content: Column) -> Column:
    """First ``href`` or ``src`` value in the content, null if there is none."""
    return F.try_element_at(
        F.regexp_extract_all(content, F.lit("(?i)" + HREF_OR_SRC), F.lit(1)), F.lit(1)
    )


def _without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments; ``..`` stops at the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts) - 1), F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    # A path that ends in a dot segment names a folder.
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def _undotted(reference: Column) -> Column:
    """The same for a path that a query or fragment may follow."""
    path = F.regexp_extract(reference, "^([^?#]*)", 1)
    return F.concat(_without_dots(path), F.substring(reference, F.length(path) + 1, F.length(reference)))


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a reference against a base URL (RFC 3986)."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    path = F.substring(no_query, F.length(site) + 1, F.length(no_query))
    folder = F.regexp_replace(path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", no_fragment)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, _undotted(href)))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(site, _undotted(F.concat(folder, href))))
    )


#: A tag with its attributes, a word with the white space before it, a stray opening bracket, or white space at the end.
MARKUP_TOKEN = r"""<!--[\s\S]*?-->|</?[A-Za-z](?:"[^"]*"|'[^']*'|[^'">])*>|\s*[^\s<]+|\s*<(?!/?[A-Za-z]|!--)|\s+|<"""
# Fixed value: the elements of HTML that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def truncate_html(html: Column, limit: int = 50, suffix: str = "...") -> Column:
    """The first ``limit`` words with their tags, plus a suffix if cut; what is open there is closed.

    One fold over the tags and words with a stack of open elements. An end tag closes what was opened inside its element, and
    is left out if nothing of its name is open; void elements are not closed; comments go; a bracket that opens no tag is escaped.
    """
    strings = "array<string>"
    tokens = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(MARKUP_TOKEN), F.lit(0))
    start = F.struct(
        F.array().cast(strings).alias("out"), F.array().cast(strings).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("cut")
    )

    def closing(names: Column) -> Column:
        return F.array_join(F.transform(names, lambda name: F.concat(F.lit("</"), name, F.lit(">"))), "")

    def step(state: Column, token: Column) -> Column:
        def after(out=None, opened=None, n=None, cut=None) -> Column:
            values = {"out": out, "open": opened, "n": n, "cut": cut}
            return F.struct(*[(state[k] if v is None else v).alias(k) for k, v in values.items()])

        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        inner = F.reverse(state["open"])
        depth = F.array_position(inner, name).cast("int")
        left = F.slice(state["open"], F.lit(1), F.size(state["open"]) - depth)
        word = ~token.rlike(r"^\s*(?:<|$)")
        return (
            F.when(state["cut"], state)
            .when(token.startswith("<!--"), state)
            .when(token.startswith("</") & (depth > 0), after(F.array_append(state["out"], closing(F.slice(inner, F.lit(1), depth))), left))
            .when(token.startswith("</") & (name != ""), state)
            .when((name != "") & (name.isin(*VOID) | token.endswith("/>")), after(F.array_append(state["out"], token)))
            .when(name != "", after(F.array_append(state["out"], token), F.array_append(state["open"], name)))
            .when(word & (state["n"] >= limit), after(F.array_append(state["out"], F.lit(suffix)), cut=F.lit(True)))
            .when(word, after(F.array_append(state["out"], token), n=state["n"] + 1))
            .otherwise(after(F.array_append(state["out"], F.replace(token, F.lit("<"), F.lit("&lt;")))))
        )

    return F.aggregate(
        tokens, start, step, lambda state: F.concat(F.array_join(state["out"], ""), closing(F.reverse(state["open"])))
    )


def remove_scripts(html: Column) -> Column:
    """Drop script and style elements; a dangling opening tag drops the rest."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(out, r"(?is)<(?:script|style)\b.*$", "")


def md5_hex(content: Column) -> Column:
    return F.md5(F.coalesce(content, F.lit("")))


@lru_cache(maxsize=1)
def _variants() -> dict[str, str]:
    """Base letter to every letter that folds to it, both cases."""
    source, target = fold_table()
    out: dict[str, str] = {}
    for i, base in enumerate(target):
        out[base] = out.get(base, "") + source[i] + source[i].upper()[:1]
    return out


# Fixed value: the transliteration a highlight must see through.
TRANSLITERATED = {"gb": "£"}


def highlight_pattern(word: str) -> str:
    """A regex that finds ``word`` in any case, with or without diacritics."""
    parts = []
    i = 0
    while i < len(word):
        for plain, sign in TRANSLITERATED.items():
            if word[i:i + len(plain)] == plain:
                parts.append(f"(?:{plain}|{sign})")
                i += len(plain)
                break
        else:
            char = word[i]
            forms = char + (char.upper() if char.isalpha() else "") + _variants().get(char, "")
            parts.append("[" + "".join("\\" + c if c in "\\]^[-&" else c for c in forms) + "]")
            i += 1
    return "".join(parts)


def java_quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def highlight_first(html: Column, pattern: str) -> Column:
    """Wrap the first hit of a regex in a highlighting span, once."""
    return F.regexp_replace(
        html, "(?s)^(.*?)(" + pattern + ")", "$1" + HIGHLIGHT_OPEN + "$2" + HIGHLIGHT_CLOSE
    )
