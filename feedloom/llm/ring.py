"""Operator 2, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at ``vnodes`` places of a ring; a document's hash falls in an
arc that the next place clockwise owns. A shard has room for
``ceil((1 + slack) * rows / shards)`` documents (with no slack, the floor, and
one more for the first ``rows % shards`` shards). What overflows a full shard
continues clockwise to the next shard with room. First choices are served
before any overflow, overflow in rounds of one step, arcs in ring order, and
within an arc documents in hash order; so the result depends on the set of
documents only.

Only arcs are handled one by one, and there are ``shards * vnodes`` of them
however many documents there are: their counts go to the driver, the cut points
come back as a table of at most a few rows an arc, and each document finds its
shard and its slot from its place in its arc. The one shuffle moves ids,
sizes and checksums, never texts.

Defined cases: a null text has size 1 and the checksum of the empty text; a
null id hashes as the empty string; repeated ids follow each other in their
arc, ordered by size and checksum; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import text_of

#: Hash positions are the first 15 hex digits of an MD5 digest.
DIGITS = 15


class Cut(NamedTuple):
    """Documents ``start`` to ``end`` (exclusive) of an arc go to a shard, at ``slot`` onwards."""

    arc: int
    start: int
    end: int
    shard: int
    slot: int


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order."""
    return sorted(
        (int(hashlib.md5(f"shard {s}#{v}".encode()).hexdigest()[:DIGITS], 16), s)
        for s in range(shards) for v in range(vnodes)
    )


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], owners: list[int], room: list[int]) -> list[Cut]:
    """Cut points of all arcs: ``counts`` by arc, ``owners`` the shard of each arc."""
    room = list(room)
    taken = [0] * len(room)
    cuts: list[Cut] = []
    waiting = [(arc, 0, counts[arc], arc) for arc in sorted(counts) if counts[arc]]
    while waiting:
        rest = []
        for arc, start, end, node in waiting:
            shard = owners[node]
            some = min(end - start, room[shard])
            if some:
                cuts.append(Cut(arc, start, start + some, shard, taken[shard]))
                room[shard] -= some
                taken[shard] += some
            if start + some < end:
                for _ in owners:  # clockwise to the next place whose shard has room
                    node = (node + 1) % len(owners)
                    if room[owners[node]]:
                        break
                else:
                    raise ValueError("the shards have less room than there are documents")
                rest.append((arc, start + some, end, node))
        waiting = rest
    return cuts


def arc_of(position: Column, places: list[int]) -> Column:
    """Index of the first place at or after ``position`` (the first one again past the last).

    The top bits of a position lead to the first place that can follow it; the
    few places that share these bits are compared.
    """
    bits = max(1, len(places).bit_length())
    shift = 4 * DIGITS - bits
    firsts = [bisect.bisect_left(places, b << shift) for b in range(1 << bits)]
    most = max(b - a for a, b in zip(firsts, [*firsts[1:], len(places)], strict=True))

    def literal(values: list[int], kind: str) -> Column:
        return F.expr(f"array({','.join(f'{v}{kind}' for v in values)})")

    first = F.element_at(literal(firsts, ""), F.shiftright(position, shift).cast("int") + 1)
    steps = F.lit(0)
    for k in range(most):
        here = F.try_element_at(literal(places, "L"), first + k + 1)
        steps = steps + F.coalesce(here < position, F.lit(False)).cast("int")
    return (first + steps) % len(places)


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (from 0 in each shard) of every row."""
    spark = docs.sparkSession
    nodes = ring(shards, vnodes)
    position = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, DIGITS), 16, 10)
    hashed = docs.select("doc_id", "text", position.cast("long").alias("position"))
    hashed = hashed.withColumn("arc", arc_of(F.col("position"), [p for p, _ in nodes]))
    counts = {r["arc"]: r["n"] for r in hashed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = place(counts, [s for _, s in nodes], capacities(sum(counts.values()), shards, slack))
    by_arc: dict[int, list[Cut]] = {}
    for cut in cuts:
        by_arc.setdefault(cut.arc, []).append(cut)
    table = spark.createDataFrame(
        [(arc, [(c.start, c.end, c.shard, c.slot) for c in own]) for arc, own in by_arc.items()],
        "arc int, cuts array<struct<start: long, end: long, shard: int, slot: long>>",
    )
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32")
    ranked = hashed.select(
        "doc_id", "position", "arc",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
    ).withColumn("nth", F.row_number().over(order).cast("long") - 1)
    mine = F.filter("cuts", lambda c: (c["start"] <= F.col("nth")) & (F.col("nth") < c["end"]))[0]
    return (
        ranked.join(F.broadcast(table), "arc")
        .withColumn("cut", mine)
        .select(
            "doc_id", "size", "text_crc32", F.col("cut.shard").alias("shard"),
            (F.col("cut.slot") + F.col("nth") - F.col("cut.start")).alias("slot"),
        )
    )
