"""Operator 10, secret scans: patterns, and sliding-window Shannon entropy by character class.

Base kinds are patterns: ``assign`` (a value given to a secret's name),
``access`` (an access key id) and ``hex`` (a long hexadecimal run). The method adds the
kind ``entropy``: runs of a class's characters are candidates; a window slides over each,
keeping the count of every character and the sum of ``c log2 c``, of which only the
character that enters and the one that leaves change; the entropy of a window is
``log2 w - sum / w``. Windows at or over the class's threshold are united to spans. Candidates
on the allow-list (no digit or no letter, UUIDs, plain sequences, placeholders, given strings)
and spans inside a base span are left out.

All is column expressions: one pass over the texts, no shuffle, no Python. Only texts in which
a pattern is found at all are cut by it, and only candidates are walked through.

Positions count code points, ends are exclusive.

Defined cases: a null text is empty and has no span; a text of any length is scanned whole; equal
rows give equal results; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import let
from feedloom.llm.common import text_of

NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter match is dropped after it was found, so a longer one that begins inside it isn't one.
LEAST_VALUE = 6
#: Found with their least length at once: a run that is too short has no longer one inside it.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"


class CharacterClass(NamedTuple):
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("[0-9A-Fa-f]{20,}", 20, 3.0),
    CharacterClass("[A-Za-z0-9+/_=-]{24,}", 24, 4.0),
)
#: What a candidate may be without being a secret.
ALLOWED = (
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "(?i)0123456789abcdef|abcdefghijklmnopqrstuvwxyz",
    "(?i)example|placeholder|your[_-]",
)
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start: int, kind: int, end: int>"


#: Elements that are folded into one list before it is added to the others: adding to a list copies it.
CHUNK = 256


def _scanned(values: Column, carry: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A scan: ``step`` gives the next carry and an array of results (of type ``kind``) for each of ``values``.

    The list is worked on in chunks, so its cost grows with its length and not with the square of it.
    """
    lists, none = f"array<array<{kind}>>", F.array().cast(f"array<{kind}>")

    def chunk(state: Column, own: Column) -> Column:
        def one(inner: Column, value: Column) -> Column:
            after, found = step(inner["carry"], value)
            return F.struct(after.alias("carry"), F.concat(inner["out"], found).cast(f"array<{kind}>").alias("out"))

        return F.aggregate(
            own, F.struct(state["carry"].alias("carry"), none.alias("out")), one,
            lambda done: F.struct(done["carry"].alias("carry"), F.array_append(state["out"], done["out"]).cast(lists).alias("out")),
        )

    def whole(bound: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(starts, lambda at: F.slice(bound, at, F.lit(CHUNK)))
        return F.aggregate(
            chunks, F.struct(carry.alias("carry"), F.array().cast(lists).alias("out")), chunk, lambda done: F.flatten(done["out"])
        )

    return let(values, whole)


def places(text: Column, pattern: str) -> Column:
    """(start, end, found) of all matches of a pattern: the text is cut by it, and lengths are summed."""
    cut, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<start: int, end: int, found: string>"

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["0"])
        end = begin + F.length(pair["1"])
        return end, F.array(F.struct(begin.alias("start"), end.alias("end"), pair["1"].alias("found")))

    pairs = let(found, lambda own: F.zip_with(F.slice(cut, 1, F.size(own)), own, lambda a, b: F.struct(a.alias("0"), b.alias("1"))))
    walked = _scanned(pairs, F.lit(0), kind, step)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{kind}>"))


def entropy_spans(found: Column, kind: CharacterClass) -> Column:
    """Spans (start, end) within a candidate whose windows have the class's entropy, by incremental counts."""
    w = kind.window
    weight = F.expr(f"array({','.join(f'{c * math.log2(c) if c else 0.0!r}D' for c in range(w + 2))})")
    spans = "array<struct<start: int, end: int>>"
    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast(spans).alias("spans")
    )
    codes = F.transform(F.split(found, ""), F.ascii)

    def changed(counts: Column, total: Column, code: Column, by: int) -> tuple[Column, Column]:
        now = F.get(counts, code)
        moved = F.element_at(weight, now + by + 1) - F.element_at(weight, now + 1)
        return F.transform(counts, lambda c, i: F.when(i == code, c + by).otherwise(c)), total + moved

    def step(state: Column, pair: Column) -> Column:
        counts, total = changed(state["counts"], state["sum"], pair["enters"], 1)
        after, less = changed(counts, total, pair["leaves"], -1)
        full = pair["leaves"] >= 0
        counts, total = F.when(full, after).otherwise(counts), F.when(full, less).otherwise(total)
        n = state["n"] + 1
        own = F.struct((n - w).alias("start"), n.alias("end"))
        last = F.try_element_at(state["spans"], F.lit(-1))
        joined = F.concat(
            F.slice(state["spans"], 1, F.size(state["spans"]) - 1), F.array(F.struct(last["start"].alias("start"), n.alias("end")))
        )
        more = F.when(last["end"] >= n - w, joined).otherwise(F.array_append(state["spans"], own))
        hit = (n >= w) & (math.log2(w) - total / w >= kind.bits)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), n.alias("n"), F.when(hit, more).otherwise(state["spans"]).cast(spans).alias("spans")
        )

    before = F.concat(F.array_repeat(F.lit(-1), w), codes)
    pairs = F.zip_with(codes, F.slice(before, 1, F.size(codes)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def _allowed(found: Column, allow: tuple[str, ...]) -> Column:
    hit = found.isin(*allow) if allow else F.lit(False)
    for pattern in ALLOWED:
        hit = hit | found.rlike(pattern)
    return hit


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(
        f"array<{SPAN}>"
    )


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    lines = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    return F.array_join(lines, ",")


def scan(docs: DataFrame, classes: tuple[CharacterClass, ...] = CLASSES, allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    text = F.col("__text")
    rows = docs.select("doc_id", text_of().alias("__text"))
    rows = rows.select(
        "doc_id",
        _spans(F.filter(places(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= LEAST_VALUE), 0).alias("assign"),
        _spans(places(text, ACCESS), 1).alias("access"),
        _spans(places(text, HEX), 2).alias("hex"),
        *[F.filter(places(text, c.pattern), lambda x: ~_allowed(x["found"], allow)).alias(f"class{k}") for k, c in enumerate(classes)],
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))

    def of_class(k: int, c: CharacterClass) -> Column:
        found = F.flatten(F.transform(f"class{k}", lambda x: F.transform(
            entropy_spans(x["found"], c),
            lambda s: F.struct((x["start"] + s["start"]).alias("start"), (x["start"] + s["end"]).alias("end")),
        )))
        return _spans(F.when(F.size(f"class{k}") > 0, found).otherwise(F.array().cast("array<struct<start: int, end: int>>")), 3)

    rows = rows.withColumn("base", base).withColumn(
        "more", F.array_distinct(F.concat(*[of_class(k, c) for k, c in enumerate(classes)]))
    )
    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        """In order of start, base kinds first, a span lies in a base span if one before it reaches as far."""
        is_base = x["kind"] < len(KINDS) - 1
        stays = is_base | (x["end"] > reach)
        return F.when(is_base, F.greatest(reach, x["end"])).otherwise(reach), F.when(stays, F.array(x)).otherwise(F.array().cast(f"array<{SPAN}>"))

    everything = F.when(F.size("more") == 0, F.col("base")).otherwise(
        _scanned(F.array_sort(F.concat("base", "more")), F.lit(0), SPAN, step)
    )
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(everything).alias("spans"),
    )


def _sql_quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same in SQL: windows are cut out one by one and their entropy is an aggregate."""
    patterns = [(ASSIGN, 0), (ACCESS, 1), (HEX, 2), *[(c.pattern, 10 + k) for k, c in enumerate(CLASSES)]]
    found = " UNION ALL ".join(
        f"SELECT doc_id, nth, {kind} AS kind, regexp_split_to_array(t, {_sql_quoted(p)}) AS cut, "
        f"regexp_extract_all(t, {_sql_quoted(p)}) AS found FROM d WHERE regexp_matches(t, {_sql_quoted(p)})"
        for p, kind in patterns
    )
    allowed = " OR ".join(f"regexp_matches(m, {_sql_quoted(p)})" for p in ALLOWED)
    windows = " UNION ALL ".join(
        f"SELECT doc_id, nth, {10 + k} AS kind, s, s + i AS a, s + i + {c.window} AS b FROM "
        f"(SELECT *, unnest(range(0, length(m) - {c.window - 1})) AS i FROM m WHERE kind = {10 + k} AND NOT ({allowed})) "
        f"WHERE list_aggregate(string_split(substr(m, (i + 1)::INT, {c.window}), ''), 'entropy') >= {c.bits}"
        for k, c in enumerate(CLASSES)
    )
    line = "string_agg(concat(['assign','access','hex','entropy'][kind + 1], ':', s, ':', e), ',' ORDER BY s, kind, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS nth FROM documents),
f AS ({found}),
u AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM f),
p AS (SELECT doc_id, nth, kind, found[i] AS m,
      list_sum(list_transform(cut[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s
      FROM u),
m AS (SELECT doc_id, nth, kind, m, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM p),
base AS (SELECT doc_id, nth, kind, s, e FROM m
         WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(m, {_sql_quoted(ASSIGN)}, 1)) >= {LEAST_VALUE}),
w AS ({windows}),
w2 AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY nth, kind, s ORDER BY a) THEN 0 ELSE 1 END AS new FROM w),
w3 AS (SELECT *, sum(new) OVER (PARTITION BY nth, kind, s ORDER BY a) AS run FROM w2),
more AS (SELECT DISTINCT doc_id, nth, 3 AS kind, s2 AS s, e FROM (
    SELECT doc_id, nth, min(a) AS s2, max(b) AS e FROM w3 GROUP BY doc_id, nth, kind, s, run)),
extra AS (SELECT * FROM more x WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.nth = x.nth AND b.s <= x.s AND x.e <= b.e)),
b1 AS (SELECT nth, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
       count(*) FILTER (kind = 2) AS n_hex, {line} AS spans FROM base GROUP BY nth),
a1 AS (SELECT nth, {line} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY nth)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b1.spans, '')) AS base_sha256, coalesce(a1.spans, '') AS spans
FROM d LEFT JOIN b1 USING (nth) LEFT JOIN a1 USING (nth)
"""
