"""Operator 5, suffix-array dedup: bytes covered by a long string that also starts earlier.

The suffix array is sparse and distributed. A suffix starts at an anchor: in
each string of ``LENGTH`` bytes the 32-byte gram of the smallest hash (the
leftmost of equals). Equal strings have equal anchors, so strings are compared
only where their anchors have the same gram, and anchors are dealt by gram.

1. ``_anchors`` lists each text's anchors with the range of strings that have it
   as theirs; the range's text is the anchor's context. Of equal contexts the
   earliest stays open and the others are covered whole; each task combines
   its own copies first, so a text with a million copies sends one row a task.
2. A gram with one context is done. The contexts of the others are cut from
   their texts and meet by gram in ``_covered``, which sorts them into an
   enhanced suffix array, finds the tree of common-prefix intervals with a
   stack scan, and cuts every interval by what stands to the left of the
   anchors. A class is a maximal repeat with all its occurrences unless it extends
   to the left as a whole, in which case a longer one says the same. All
   but the earliest occurrence are covered.
3. A gram with more than ``GROUP`` different contexts isn't brought together: its strings
   are dealt by a 128-bit hash of their own, and all but the earliest of each are covered.
4. What is covered is gathered by document and cut out.

Contexts are told apart by 128 bits (gram and context hash). Texts move once:
both joins of texts with what was found share one shuffle.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes have nothing
removed; rows with equal (or null) doc_id are documents of their own, ordered
by their text (null ids first); an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm import suffixes
from feedloom.llm.common import numbered, small_batches, text_of, text_pieces
from feedloom.session import durable

LENGTH = 100
GRAM = 32
#: Starts of grams in a string; an anchor is at most this minus one after a string's start.
STARTS = LENGTH - GRAM + 1
#: Different contexts of one gram that are handled in one place.
GROUP = 100_000
PIECE = 1 << 20
#: Anchors whose copies a task combines at a time.
COMBINED = 1 << 20
#: Contexts in one suffix array, at least (grams aren't cut).
BLOCK = 50_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)


def _gram_hashes(data: memoryview) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on (bytes past the end are zero)."""
    n = len(data)
    padded = bytes(data) + bytes(GRAM + 8)
    words = np.empty(n + 24, np.uint64)
    for shift in range(8):
        count = len(words[shift::8])
        words[shift::8] = np.frombuffer(padded, "<u8", count, shift)
    h = words[:n] * _ODD[0]
    for k in range(1, 4):
        h ^= h >> np.uint64(29)
        h += words[8 * k : n + 8 * k]
        h *= _ODD[k]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts in ``data``: text number, first string's start, number of strings, anchor's distance, gram hash.

    Places are relative to the whole of ``data``.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(np.uint64)
    grams = _gram_hashes(data)
    least = (grams & _HIGH) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: -(STARTS - width)], least[STARTS - width :])
    anchor = (least[: n - LENGTH + 1] & _LOW).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside[: len(anchor)], dtype=np.int8) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    strings = np.diff(np.append(first, len(anchor)))
    first, strings = first[inside[first]], strings[inside[first]]
    at = anchor[first]
    return np.searchsorted(offsets, first, side="right") - 1, first, strings, at - first, grams[at]


def _pack(first: np.ndarray, strings: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return first << 16 | distance << 8 | (strings - 1)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of the first string, number of strings, distance of the anchor from that start."""
    return at >> 16, (at & 255) + 1, at >> 8 & 255


def _ends(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the strings of an anchor cover."""
    first, strings, _ = _unpack(at)
    return first, first + strings - 1 + LENGTH


ANCHORS = "g long, d long, doc_id long, __row long, at long, spans array<long>"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of which a task has no earlier copy, and the spans of the copies it has."""
    digest = xxhash.xxh3_64_intdigest
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in batches:
        ids, rows = (batch.column(k).to_numpy() for k in (0, 1))
        for start, _, data, offsets in text_pieces(batch, 2, PIECE):
            text, first, strings, distance, gram = anchors(data, offsets)
            ends = (first + strings - 1 + LENGTH).tolist()
            context = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], np.uint64)
            held.append((
                gram.view(np.int64), context.view(np.int64), ids[start + text], rows[start + text],
                _pack(first - offsets[text], strings, distance),
            ))
            n_held += len(first)
        if n_held >= COMBINED:
            yield from _combined(held)
            held, n_held = [], 0
    yield from _combined(held)


def _combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    g, d, doc, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((at, row, doc, d, g))
    again = np.zeros(len(g), bool)
    again[order[1:]] = (g[order[1:]] == g[order[:-1]]) & (d[order[1:]] == d[order[:-1]])
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    once = ~again
    step = 1 << 16
    columns = [x[once] for x in (g, d, doc, row, at)]
    for k in range(0, len(columns[0]), step):
        own = [pa.array(x[k : k + step]) for x in columns]
        yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.list_(pa.int64()))], names)
    # Of the others the spans, one row a document; they pass through the next step under a key of their own.
    doc, row, at = doc[again], row[again], at[again]
    if not len(at):
        return
    order = np.lexsort((at, row, doc))
    doc, row = doc[order], row[order]
    lo, hi = _ends(at[order])
    new_doc = np.ones(len(lo), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    new = new_doc.copy()
    new[1:] |= lo[1:] > hi[:-1]
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(lo)) - 1
    spans = np.stack([lo[begins], hi[ends]], axis=1).ravel()
    owner = np.flatnonzero(new_doc[begins])
    lists = pa.ListArray.from_arrays(np.append(2 * owner, len(spans)).astype(np.int32), pa.array(spans))
    at_doc = begins[owner]
    key = doc[at_doc] * np.int64(-7046029254386353131) + row[at_doc]
    nothing = pa.nulls(len(owner), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(key), nothing, pa.array(doc[at_doc]), pa.array(row[at_doc]), nothing, lists], names
    )


CONTEXTS = "kind int, g long, d long, doc_id long, __row long, at long, context binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the open anchors of each document; of those of large groups the single strings."""
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    for batch in batches:
        ids, rows = (batch.column(k).to_pylist() for k in (0, 1))
        texts, found = batch.column(2), batch.column(3)
        ends = found.offsets.to_numpy()
        grams, ats, large = (found.values.field(k).to_numpy(zero_copy_only=False) for k in ("g", "at", "large"))
        out: list[tuple] = []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            data = texts[i].as_buffer()
            lo, hi = _ends(ats[a:b])
            for g, at, x, y, many in zip(grams[a:b].tolist(), ats[a:b].tolist(), lo.tolist(), hi.tolist(), large[a:b].tolist(), strict=True):
                if not many:
                    out.append((0, g, 0, ids[i], rows[i], at, data[x:y].to_pybytes()))
                    continue
                view = memoryview(data)
                for p in range(x, y - LENGTH + 1):
                    h = xxhash.xxh3_128_digest(view[p : p + LENGTH])
                    out.append((
                        1, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True),
                        ids[i], rows[i], p, None,
                    ))
            if len(out) >= 20_000:
                yield _batch(out, names)
                out = []
        if out:
            yield _batch(out, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


SPANS = "doc_id long, __row long, lo long, hi long"


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans covered, from rows sorted by kind, gram (or hash), document and place."""
    held: list[pa.RecordBatch] = []
    n_held, last = 0, None
    for batch in batches:
        kind = batch.column(0).to_numpy()
        cut = int(np.searchsorted(kind, 1))
        contexts, strings = batch.slice(0, cut), batch.slice(cut)
        if len(contexts):
            g = contexts.column(1).to_numpy()
            if n_held >= BLOCK:
                # Up to where the gram of the held rows ends.
                more = int(np.argmax(np.append(g, ~g[-1:]) != held[-1].column(1)[-1].as_py()))
                held.append(contexts.slice(0, more))
                if more < len(contexts):
                    yield from _from_block(held)
                    held, n_held = [], 0
                contexts = contexts.slice(more)
            if len(contexts):
                held.append(contexts)
                n_held += len(contexts)
        if len(strings):
            g, d, doc, row, at = (strings.column(k).to_numpy() for k in range(1, 6))
            again = np.zeros(len(g), bool)
            again[1:] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
            again[0] = last == (int(g[0]), int(d[0]))
            last = (int(g[-1]), int(d[-1]))
            yield _spans(doc[again], row[again], at[again], at[again] + LENGTH)
    yield from _from_block(held)


def _spans(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, row, lo, hi)], ["doc_id", "__row", "lo", "hi"])


def _from_block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    g, doc, row, at = (table.column(k).to_numpy() for k in ("g", "doc_id", "__row", "at"))
    order = np.lexsort((at, row, doc))
    contexts = table.column("context").to_pylist()
    contexts = [contexts[i] for i in order.tolist()]
    g, doc, row, at = g[order], doc[order], row[order], at[order]
    low, high = covered_distances(g, at, contexts)
    some = high >= 0
    first, _, distance = _unpack(at[some])
    anchor = first + distance
    yield _spans(doc[some], row[some], anchor - high[some], anchor - low[some] + LENGTH)


def _sorted_with_prefixes(group: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``parts`` by group and bytes, and the common prefix of each with the one before it."""
    n = len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    padded = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(n, width)
    by_length = np.argsort(lengths, kind="stable")
    by_bytes = by_length[np.argsort(np.ascontiguousarray(padded[by_length]).view(f"S{width}").ravel(), kind="stable")]
    order = by_bytes[np.argsort(group[by_bytes], kind="stable")]
    prefixes = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    differs = padded[a] != padded[b]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    shared = np.minimum(shared, np.minimum(lengths[a], lengths[b]))
    prefixes[1:] = np.where(group[a] == group[b], shared, 0)
    return order, prefixes


def covered_distances(group: np.ndarray, at: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in document order, which of their strings also start in an earlier context of their group.

    A string is named by the distance from its start to the anchor. Returns the
    smallest and the largest such distance, -1 where there is none. All between
    are within the same span of bytes, since strings of one anchor overlap.
    """
    n = len(at)
    _, strings, distance = _unpack(at)
    _, group, _ = suffixes.ranked(group)
    right = [c[d:] for c, d in zip(contexts, distance.tolist(), strict=True)]
    left = [c[:d][::-1] for c, d in zip(contexts, distance.tolist(), strict=True)]
    order, prefixes = _sorted_with_prefixes(group, right, LENGTH)
    left_order, left_prefixes = _sorted_with_prefixes(group, left, STARTS)
    place_left = np.empty(n, np.int64)
    place_left[left_order] = np.arange(n)
    begin, end, depth, above = suffixes.prefix_intervals(prefixes, GRAM)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)

    def left_class(reach: int) -> np.ndarray:
        """A number for what the ``reach`` bytes in front of each anchor are, in suffix order."""
        return np.cumsum(left_prefixes < reach)[place_left][order] if reach else np.zeros(n, np.int64)

    longer = left_class(STARTS)
    for reach in range(STARTS - 1, -1, -1):
        here, deep = left_class(reach), LENGTH - reach
        # Intervals of suffixes that share what is right of the anchor in a string of this reach. One
        # whose members all share a byte more to the left too was dealt with as that longer repeat.
        chosen = (above < deep) & (deep <= depth)
        chosen &= (above >= deep - 1) | suffixes.left_diverse(begin, end, longer)
        longer = here
        if not chosen.any():
            continue
        sizes = end[chosen] - begin[chosen] + 1
        starts = np.cumsum(sizes) - sizes
        places = np.arange(int(sizes.sum())) - np.repeat(starts - begin[chosen], sizes)
        member = order[places]
        own = (distance[member] >= reach) & (distance[member] - strings[member] < reach)
        interval = np.repeat(np.flatnonzero(chosen), sizes)[own]
        member, kind = member[own], interval * (n + 1) + here[places][own]
        if not len(member):
            continue
        # Members are numbered in document order: all but the smallest of a class are covered, as far
        # to the right as the interval is deep.
        by_kind = np.lexsort((member, kind))
        again = by_kind[1:][kind[by_kind[1:]] == kind[by_kind[:-1]]]
        near = LENGTH - depth[interval[again]]
        again = member[again]
        low[again] = np.where(low[again] < 0, near, np.minimum(low[again], near))
        high[again] = np.where(high[again] < 0, reach, high[again])
    return low, high


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REMOVED.split(", ")]
    for batch in batches:
        texts = batch.column(1)
        whole, spans, late = (batch.column(k).to_pylist() for k in (2, 3, 4))
        out = []
        for i in range(len(batch)):
            data = memoryview(texts[i].as_buffer() or b"")
            runs = merged(whole[i], spans[i], late[i])
            digest, at, removed = hashlib.sha256(), 0, 0
            for lo, hi in runs:
                digest.update(data[at:lo])
                removed += hi - lo
                at = hi
            digest.update(data[at:])
            out.append((len(data), removed, len(runs), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True))]
            if out else [batch.column(0), *[pa.nulls(0, k) for k in [pa.int64()] * 3 + [pa.string()]]],
            names,
        )


def merged(whole: list[int] | None, spans: list[list[int]] | None, late: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes: of anchors covered whole, of flat span lists, and of single spans."""
    lo, hi = _ends(np.array(whole or [], np.int64))
    flat = np.array([x for s in spans or [] for x in s], np.int64).reshape(-1, 2)
    more = np.array([(x["lo"], x["hi"]) for x in late or []], np.int64).reshape(-1, 2)
    lo, hi = np.concatenate([lo, flat[:, 0], more[:, 0]]), np.concatenate([hi, flat[:, 1], more[:, 1]])
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    begins = np.flatnonzero(new)
    return list(zip(lo[begins].tolist(), hi[np.append(begins[1:], len(lo)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    key = ["doc_id", "__row"]
    # A null id gets the smallest number here, as in _anchors, and is null again at the end.
    texts = numbered(docs.select("doc_id", text_of().alias("text"))).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "__row", "text"
    )
    by_context = Window.partitionBy("g").orderBy("d", *key, "at")
    whole_gram = Window.partitionBy("g")
    again = F.coalesce(F.lag("d").over(by_context) == F.col("d"), F.lit(False))
    found = texts.mapInArrow(_anchors, ANCHORS).withColumn("again", again)
    contexts = F.sum((~F.col("again")).cast("long")).over(whole_gram)
    found = found.withColumn("contexts", contexts).where("again or contexts > 1 or spans is not null")
    open_one = F.struct("g", "at", (F.col("contexts") > group).alias("large"))
    by_doc = durable(found.groupBy(*key).agg(
        F.collect_list(F.when(F.col("again"), F.col("at"))).alias("whole"),
        F.collect_list("spans").alias("spans"),
        F.collect_list(F.when(~F.col("again") & F.col("spans").isNull(), open_one)).alias("open"),
    ))
    joined = texts.join(by_doc, key, "left")
    # (coalesce keeps this a left join, so that both uses of the texts' shuffle are the same one)
    opened = joined.where("coalesce(size(open), 0) > 0").select(*key, "text", "open")
    late = (
        opened.mapInArrow(_contexts, CONTEXTS)
        .repartition("kind", "g").sortWithinPartitions("kind", "g", "d", *key, "at")
        .mapInArrow(_covered, SPANS).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("late"))
    )
    rows = joined.join(late, key, "left").select("doc_id", "text", "whole", "spans", "late")
    return rows.mapInArrow(_cut, REMOVED).withColumn(
        "doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    )
