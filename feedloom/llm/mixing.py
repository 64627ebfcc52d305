"""Operator 9, mixing sources to target weights by Sainte-Laguë apportionment.

The corpus is laid out in cells: a cell is a source's documents in one of the
hash shards, in seeded order, as one line of words cut into blocks of
``block_words``. A source takes every word as often as its target fits into it,
and blocks for what is left. The house of blocks is allotted to the sources by
highest quotients (left over words / 1, 3, 5, ...), and each source's seats to its
cells in the same way, which gives an integer quota for each source and shard.
In a cell the quota is a run of consecutive blocks from a seeded one onwards, round
the end; as documents lie in seeded order, that is a random choice which
cuts at most two of them.

Cells bound the windows: no task needs a whole source. The number of shards
follows the number of rows. Only rows a source, a cell and a quotient near the
dividing line are ordered globally, never documents.

Everything is DataFrame operations. Hashes are leading digits of MD5, so SQL
elsewhere can repeat them.

Defined cases: a null text or a text without words has size 0 and is taken 0
times; a null source is a source of its own, last in order; rows with equal
doc_id follow each other by size and source; empty tables give no rows; a
source without words has target 0. Other columns are returned by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import WORD, by_size, n_words, text_of
from feedloom.session import durable

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
BLOCK_WORDS = 64
SHARD_ROWS = 10_000
SEED = "mix"


def hashed(*parts: Column) -> Column:
    """A number of 52 bits from the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, weight, target from one row a source (source, source_size).

    A source is held at ``times`` its size if that is below its part of what
    the held ones leave. In order of size per weight the held sources come
    first, so the common share follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("weight", F.element_at(cycle, (place - 1) % len(weights) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(all_rows) - times * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    weighed = weighed.withColumn("share", left / weight_left).withColumn(
        "free", F.col("share") * F.col("weight") < times * F.col("source_size")
    )
    weighed = weighed.withColumn("nth", F.row_number().over(order))
    share = F.min(F.when(F.col("free"), F.struct("nth", "share"))).over(all_rows)
    share = F.coalesce(share["share"], F.lit(float("inf")))
    return weighed.select(
        "source", "source_size", "weight",
        F.least((times * F.col("source_size")).cast("double"), share * F.col("weight")).alias("target"),
    )


def sainte_lague(claims: DataFrame, group: list[str], key: list[str], claim: str, seats: str) -> DataFrame:
    """Adds ``quota``: seats of each claim by highest quotients ``claim / (2k + 1)`` within its group.

    Only quotients near the dividing line are listed, about two a claim: above
    it ``floor(claim / divisor + 1/2)`` seats are certain. Ties go by ``key``.
    """
    own = Window.partitionBy(*group or [F.lit(0)])
    total, n, house = F.sum(claim).over(own), F.count(F.lit(1)).over(own), F.col(seats)

    # With n claims, rounding moves the sum of seats by at most n / 2 from claims / divisor.
    def surely(house_size: Column) -> Column:
        found = F.floor(F.col(claim) * house_size / F.col("__total") + 0.5 + 1e-9)
        return F.when(F.col("__total") > 0, found).otherwise(0)

    ready = claims.withColumns({"__total": total, "__n": n}).withColumns({
        "__low": F.greatest(F.lit(0), surely(house - F.col("__n") / 2 - 1) - 1),
    }).withColumn("__high", F.greatest(F.col("__low"), surely(house + F.col("__n") / 2 + 1) + 1))
    listed = ready.withColumn("__k", F.explode(F.expr("sequence(__low, __high)"))).withColumn(
        "__quotient", F.col(claim) / (2 * F.col("__k") + 1)
    )
    rank = F.row_number().over(own.orderBy(F.col("__quotient").desc(), *[F.col(k).asc_nulls_last() for k in key], "__k"))
    given = F.sum(F.when(F.col("__k") == F.col("__low"), F.col("__low")).otherwise(0)).over(own)
    won = listed.withColumn("__won", (rank <= house - given) & (F.col(claim) > 0))
    return won.groupBy(*claims.columns).agg(
        (F.min("__low") + F.sum(F.col("__won").cast("long"))).cast("long").alias("quota")
    )


def taken(
    docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES,
    shard_rows: int = SHARD_ROWS, seed: str = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    sized = durable(docs.select("doc_id", "source", n_words().alias("size")))
    return _placed(sized, _quotas(sized, block_words, weights, times, shard_rows, seed), seed).select(
        "doc_id", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("head") + F.col("last") - F.col("first")).cast("long").alias("taken"),
    )


def _cell(n_shards: int | Column, seed: str) -> Column:
    return (hashed(F.lit(seed), F.lit("shard"), F.col("doc_id")) % n_shards).cast("int")


def _quotas(
    sized: DataFrame, block_words: int, weights: tuple[int, ...], times: int, shard_rows: int, seed: str
) -> DataFrame:
    """Of each cell: the passes taken whole, and the words [a, b) and [0, d) of its line taken once more."""
    n_shards = max(1, -(-sized.count() // shard_rows))
    cells = durable(
        sized.groupBy("source", _cell(n_shards, seed).alias("shard")).agg(F.sum("size").alias("cell_size"))
    )
    sources = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, times)
    size = F.greatest(F.col("source_size"), F.lit(1))
    sources = sources.withColumn("whole", F.floor(F.col("target") / size).cast("long"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    house = F.round(F.sum("rest").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    sources = sainte_lague(sources.withColumn("house", house), [], ["source"], "rest", "house").select(
        F.col("source").alias("__source"), "source_size", "target", "whole", F.col("quota").alias("seats")
    )
    cells = cells.join(sources, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    blocks = F.ceil(F.col("cell_size") / block_words).cast("long")
    cells = sainte_lague(cells, ["source"], ["shard"], "cell_size", "seats").withColumn("blocks", blocks)
    start = hashed(F.lit(seed), F.lit("start"), F.col("source"), F.col("shard")) % F.greatest("blocks", F.lit(1))
    cells = cells.withColumn("start", start).withColumn("end", F.col("start") + F.least("quota", "blocks"))
    return cells.select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.lit(n_shards).alias("n_shards"),
        "source_size", "target", "whole", (F.col("start") * block_words).alias("a"),
        F.least(F.least("end", "blocks") * block_words, F.col("cell_size")).alias("b"),
        (F.greatest(F.col("end") - F.col("blocks"), F.lit(0)) * block_words).alias("d"),
    )


def _placed(sized: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """Rows of ``sized`` with their cell's figures and the words of the partial pass: [0, head) and [first, last)."""
    quotas = by_size(quotas)
    n_shards = quotas.agg(F.coalesce(F.max("n_shards"), F.lit(1)).alias("n")).first()["n"]
    rows = sized.withColumns({"__cell": _cell(n_shards, seed), "__order": hashed(F.lit(seed), F.col("doc_id"))})
    order = Window.partitionBy("source", "__cell").orderBy("__order", F.col("doc_id").asc_nulls_last(), "size")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__at", F.coalesce(before, F.lit(0))).join(
        quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__cell") == F.col("__shard"))
    )

    def inside(edge: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col(edge) - F.col("__at")))

    return rows.withColumns({"head": inside("d"), "first": inside("a"), "last": F.greatest(inside("a"), inside("b"))})


def mix(
    docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES,
    shard_rows: int = SHARD_ROWS, seed: str = SEED,
) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each whole pass of a document and each part of one.

    A part is the document's text from its first to its last word taken, with
    words set one space apart; ``n_chars``, if there is one, follows the text.
    """
    sized = durable(docs.select("doc_id", "source", n_words().alias("size")))
    quotas = _quotas(sized, block_words, weights, times, shard_rows, seed)
    wide = docs.select("doc_id", "source", n_words().alias("size"), F.struct(*docs.columns).alias("__doc"))
    rows = _placed(wide, quotas, seed)
    length, size = F.col("last") - F.col("first"), F.col("size")
    times_whole = F.col("whole") + (length == size).cast("long") + (F.col("head") == size).cast("long")
    words = F.regexp_extract_all(text_of("__doc.text"), F.lit(WORD), F.lit(0))
    none = F.array().cast("array<string>")

    def part(lo: Column, n: Column) -> Column:
        cut = F.array(F.array_join(F.slice(words, (lo + 1).cast("int"), n.cast("int")), " "))
        return F.when((n > 0) & (n < size), cut).otherwise(none)

    texts = F.concat(
        F.array_repeat("__doc.text", times_whole.cast("int")), part(F.lit(0), F.col("head")), part(F.col("first"), length)
    )
    rows = rows.where((size > 0) & ((F.col("whole") > 0) | (F.col("head") > 0) | (length > 0)))
    rows = rows.select(F.explode(texts).alias("__text"), "__doc")
    values = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[values.get(c, F.col(f"__doc.`{c}`")).alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """``taken`` in SQL, with every quotient listed."""
    def number(*parts: str) -> str:
        text = " || ':' || ".join(parts)
        return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"

    seed, b = f"'{SEED}'", BLOCK_WORDS
    doc, source = "coalesce(doc_id::VARCHAR, '')", "coalesce(source, '')"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
n AS (SELECT greatest(1, ceil(count(*) / {SHARD_ROWS}.0))::BIGINT AS n FROM d),
h AS (SELECT d.*, {number(seed, "'shard'", doc)} % n AS shard, {number(seed, doc)} AS ord FROM d, n),
cells AS (SELECT source, shard, sum(size)::BIGINT AS cell_size FROM h GROUP BY ALL),
s1 AS (SELECT source, sum(cell_size)::BIGINT AS source_size FROM cells GROUP BY ALL),
s2 AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, weight, source NULLS LAST) AS nth FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () - {MOST_TIMES} * coalesce(sum(source_size) OVER before, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
       FROM s3 WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(share, nth) AS share FROM s4 WHERE share * weight < {MOST_TIMES} * source_size),
s5 AS (SELECT source, source_size, least(({MOST_TIMES} * source_size)::DOUBLE, coalesce(f.share, 'inf'::DOUBLE) * weight) AS target
       FROM s4, f),
s6 AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM s5),
s7 AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM s6),
q1 AS (SELECT source, rest, unnest(range(0, floor(rest / {b})::BIGINT + 3)) AS k FROM s7 WHERE rest > 0),
q2 AS (SELECT *, row_number() OVER (ORDER BY rest / (2 * k + 1) DESC, source NULLS LAST, k) AS place FROM q1),
seats AS (SELECT source, count(*) AS seats FROM q2 WHERE place <= (SELECT round(sum(rest) / {b}) FROM s7) GROUP BY ALL),
c1 AS (SELECT c.*, coalesce(t.seats, 0) AS seats, s.source_size FROM cells c JOIN s7 s ON c.source IS NOT DISTINCT FROM s.source
       LEFT JOIN seats t ON t.source IS NOT DISTINCT FROM c.source),
r1 AS (SELECT *, unnest(range(0, floor(cell_size * seats / greatest(source_size, 1))::BIGINT + 3)) AS k FROM c1 WHERE cell_size > 0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cell_size / (2 * k + 1) DESC, shard, k) AS place FROM r1),
quotas AS (SELECT source, shard, count(*) AS quota FROM r2 WHERE place <= seats GROUP BY ALL),
c2 AS (SELECT c1.*, ceil(c1.cell_size / {b})::BIGINT AS blocks, coalesce(quota, 0) AS quota FROM c1
       LEFT JOIN quotas t ON t.source IS NOT DISTINCT FROM c1.source AND t.shard = c1.shard),
c3 AS (SELECT *, {number(seed, "'start'", source, "shard::VARCHAR")} % greatest(blocks, 1) AS start FROM c2),
c4 AS (SELECT source, shard, start * {b} AS a, least(least(start + least(quota, blocks), blocks) * {b}, cell_size) AS b,
         greatest(start + least(quota, blocks) - blocks, 0) * {b} AS d FROM c3),
line AS (SELECT h.*, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY ord, doc_id NULLS LAST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM h),
j AS (SELECT l.*, s.source_size, s.target, s.whole, greatest(0, least(l.size, c.d - l.at)) AS head,
        greatest(0, least(l.size, c.a - l.at)) AS lo, greatest(0, least(l.size, c.b - l.at)) AS hi
      FROM line l JOIN c4 c ON c.source IS NOT DISTINCT FROM l.source AND c.shard = l.shard
      JOIN s7 s ON s.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target, (whole * size + head + greatest(lo, hi) - lo)::BIGINT AS taken FROM j
"""
