"""Operator 6, SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. With two bits
or fewer in error some segment is free of errors and the one after it (in a
ring) has one at most, so three kinds of key, each an exact segment and a
fuzzy one, meet every such pair. A fuzzy segment, filled up to 23 bits, stands
for the codewords of the perfect binary Golay code within four bits of it,
1 or 6 of them: a word is within three bits of the codeword it decodes to, so words
one bit apart share that codeword.

Fingerprints that share a key are compared, bit by bit, in buckets of up to
``BUCKET``, which give a spanning forest of their links. Larger buckets take an exact way that needs no pairs:
two fingerprints are within two bits just if they share a fingerprint one bit or less from
both, so the bucket's task lists each under its neighbours, by the bits that vary in the bucket,
and gives a spanning forest of what the lists join: fewer links than members.
A bucket of over ``MOST`` is not held in a task. The bits that its members don't share by the
key's exact segment are cut into three parts, of which two bits in error leave one alone, and its members are
dealt again by the exact segment and each part, and so on: 43 free bits become 29, 20 and 14.

Different texts with one fingerprint are one node; nodes are named by their
smallest id. Groups are connected components (``components``).

``near_duplicates`` finds texts alike in five-word shingles. Eight fingerprints
of the words (a changed word changes five shingles but one word, so
fingerprints of words stay close), linked as above in any of them, join most
copies. They miss appended, cut and short ones, and their forests keep links of
fingerprints, not of what the check leaves. So the shingle sets have minima
under ``BANDS`` x ``ROWS`` hash functions too: sets of similarity 0.8 agree in a
whole band but for three pairs in a million, whatever their length and wherever
they differ. Texts of a band that are still apart are compared with each other;
every link is checked by the Jaccard similarity of the shingle sets.

Defined cases: a null or empty text has no word and fingerprint zero; a text of
fewer words than a shingle is one shingle; rows with equal doc_id are one
node; a null doc_id links nothing, and its component is that of the documents with
its fingerprint, or null; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_size, small_batches, text_pieces
from feedloom.llm.components import components
from feedloom.session import TEXT, durable

SEED = 42
#: First bit and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: The generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: Members of a bucket that are compared with each other.
BUCKET = 64
#: Members of a bucket that one task holds. Of 14 free bits there are no more fingerprints.
MOST = 1 << 14
#: Bytes of text worked on at once: the bits of a word are 64 bytes a fingerprint, eight fingerprints of them 60 times the text.
PIECE = 1 << 16


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial (11 bits)."""
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


@functools.cache
def error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of four bits or fewer that have it (6 places, the first repeated)."""
    patterns = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(23), w)], np.uint32)
    of = _syndromes(patterns)
    table = np.zeros((2048, 6), np.uint32)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(2049))
    for s in range(2048):
        own = patterns[order[starts[s] : starts[s + 1]]]
        table[s] = own[0]
        table[s, : len(own)] = own
    return table


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit numbers of the codewords within four bits of each word: (n, 6), the first repeated where there is one."""
    near = words.astype(np.uint32)[:, None] ^ error_patterns()[_syndromes(words)]
    return near >> np.uint32(11)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of all keys of the fingerprints (uint64)."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)) for at, width in SEGMENTS]
    places, keys = [], []
    for k in range(3):
        index = codeword_indices(parts[(k + 1) % 3]).astype(np.uint64)
        own = (np.uint64(k) << np.uint64(34)) | (parts[k][:, None] << np.uint64(12)) | index
        used = np.ones(own.shape, bool)
        used[:, 1:] = own[:, 1:] != own[:, :1]
        place, column = np.nonzero(used)
        places.append(place)
        keys.append(own[place, column])
    return np.concatenate(places), np.concatenate(keys).astype(np.int64)


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (rows, hashes a feature) from the features of each row: bits set in over half of them.

    Bits are added as bytes, eight to a 64-bit word, 255 features at a time.
    """
    n, k = len(counts), hashes.shape[1]
    out = np.zeros((n, k), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    counts = counts[rows]
    lanes = _SPREAD[np.ascontiguousarray(hashes).view(np.uint8)]
    blocks = -(-counts // 255)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    starts = np.repeat(np.cumsum(counts) - counts, blocks) + nth * 255
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8)
    total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    bits = 2 * total > counts[:, None]
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def _shingles(text: bytes, words: int) -> list[bytes]:
    own = text.lower().split()
    if not own:
        return []
    line = b" ".join(own)
    if len(own) <= words:
        return [line]
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[:-1].tolist()]
    return [line[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False)]


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (SEED,), key: str = "doc_id") -> DataFrame:
    """``key`` and ``prints`` (a 64-bit SimHash for each seed) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for start, end, data, offsets in text_pieces(batch, 1, PIECE):
                features: list[bytes] = []
                counts = np.zeros(end - start, np.int64)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = _shingles(bytes(data[a:b]), shingle)
                    counts[i] = len(own)
                    features += own
                if shingle == 1:  # words repeat; each is hashed once
                    index = {w: i for i, w in enumerate(dict.fromkeys(features))}
                    places = np.fromiter(map(index.__getitem__, features), np.int64, len(features))
                    hashes = np.array([[digest(w, s) for s in seeds] for w in index], np.uint64).reshape(-1, len(seeds))[places]
                else:
                    hashes = np.array([digest(f, s) for f in features for s in seeds], np.uint64).reshape(-1, len(seeds))
                prints = majority_bits(hashes, counts).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, prints.size + 1, len(seeds), dtype=np.int32), pa.array(prints.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], [key, "prints"])

    return docs.select(F.col(key), F.col("text")).mapInArrow(run, f"{key} long, prints array<long>")


#: Columns of what ``links`` finds: members of buckets to be dealt again (of, print, node), and links (a, b).
FOUND = ["of", "print", "a", "b"]


@functools.cache
def parts_of(path: int, depth: int) -> tuple[int, int, int]:
    """Masks of three parts of the bits that members of a bucket need not share.

    ``path`` has two bits for the exact segment of its key and for the part of each of the ``depth`` times it was dealt again.
    """
    if depth:
        parts = parts_of(path >> 2, depth - 1)
        left = sum(parts) - parts[path & 3]
        free = [1 << b for b in range(64) if left >> b & 1]
    else:
        free = [1 << b for k, (at, width) in enumerate(SEGMENTS) if k != path for b in range(at, at + width)]
    return tuple(sum(free[k::3]) for k in range(3))


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    """The columns of batches, several small ones together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]
            held = []
    if held:
        yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]


def _met(prints: np.ndarray, node: np.ndarray, starts: np.ndarray, ends: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    """The links of the rows of each run [start, end)."""
    prints = prints.view(np.uint64)
    two = starts[ends - starts == 2]
    two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= 2]
    found_a, found_b = [node[two]], [node[two + 1]]
    more = ends - starts > 2
    for lo, hi in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
        a, b = (nearest_links if hi - lo <= bucket else listed_links)(prints[lo:hi])
        if len(a):
            found_a.append(node[lo:hi][a])
            found_b.append(node[lo:hi][b])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], FOUND)


def _forests(rows: DataFrame, depth: int, bucket: int, most: int) -> DataFrame:
    """Links of the ``rows`` (key, print, node, and ``of`` if they were dealt again) of each key, and members of keys with over ``most``.

    Rows come in order of key. Of a key that goes on in the next batch no more than ``most`` rows are held.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large_key = None, None
        for rows in _joined(batches):
            if not depth:
                rows.append(rows[0] >> 34)
            key, prints, node, of = rows if held is None else (np.concatenate(x) for x in zip(held, rows, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
            ends = np.append(starts[1:], len(key))
            large = ends - starts > most
            large[0] |= (key[0], of[0]) == large_key
            large_key = (key[-1], of[-1]) if large[-1] else None
            held = tuple(x[len(x) if large[-1] else starts[-1] :].copy() for x in (key, prints, node, of))
            yield from _met(prints, node, starts[:-1][~large[:-1]], ends[:-1][~large[:-1]], bucket)
            again = np.repeat(large, ends - starts)
            if again.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[again]), pa.array(prints[again]), pa.array(node[again]), pa.nulls(int(again.sum()), pa.int64())], FOUND)
        if held and len(held[0]):
            yield from _met(held[1], held[2], np.array([0]), np.array([len(held[0])]), bucket)

    return durable(rows.mapInArrow(met, "of long, print long, a long, b long"))


def _dealt_again(large: DataFrame, depth: int) -> DataFrame:
    """Rows (key, print, node, of) of members (of, print, node) of large buckets: one for each part of the bits that were free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, prints, node = (batch.column(k).to_numpy() for k in range(3))
            kinds, at = np.unique(of, return_inverse=True)
            parts = np.array([parts_of(x & (4 << 2 * depth) - 1, depth) for x in kinds.tolist()], np.uint64).reshape(-1, 3)
            shared = ~(parts.sum(axis=1, keepdims=True) - parts)[at]
            for k in range(3):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((prints.view(np.uint64) & shared[:, k]).view(np.int64)), pa.array(prints), pa.array(node), pa.array(of << 2 | k)],
                    ["key", "print", "node", "of"],
                )

    return large.mapInArrow(run, "key long, print long, node long, of long")


def links(nodes: DataFrame, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints differ in two bits or fewer; they join all such nodes.

    ``nodes`` has distinct fingerprints: kind (int), print, node (long); only
    fingerprints of one kind are compared. ``most`` is 8 at least.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, prints, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            place, keys = keys_of(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys | kind[place].astype(np.int64) << 36), pa.array(prints[place]), pa.array(node[place])],
                ["key", "print", "node"],
            )

    keys = nodes.select("kind", "print", "node").mapInArrow(keyed, "key long, print long, node long")
    # Keys are many: they are moved once, and rows that meet follow each other.
    found = _forests(keys.repartition("key").sortWithinPartitions("key", "node"), 0, bucket, most)
    pairs, depth = found.where("print is null").select("a", "b"), 0
    while not (large := found.where("print is not null").select("of", "print", F.col("a").alias("node"))).isEmpty():
        keys = _dealt_again(large.distinct(), depth)
        depth += 1
        found = _forests(keys.repartition("of", "key").sortWithinPartitions("of", "key", "node"), depth, bucket, most)
        pairs = pairs.unionAll(found.where("print is null").select("a", "b"))
    return pairs


def nearest_links(prints: np.ndarray, most: int = 2) -> tuple[list[int], list[int]]:
    """Places (a, b) of a shortest spanning forest of the fingerprints, over distances up to ``most``.

    It joins what all pairs within that distance join, by fewer links than there are fingerprints.
    """
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    found_a: list[int] = []
    found_b: list[int] = []
    if np.count_nonzero(apart <= most) == len(prints):
        return found_a, found_b
    outside = np.full(len(prints), 255, np.uint8)  # distance to the forest
    parent = np.zeros(len(prints), np.int64)
    inside = np.zeros(len(prints), bool)
    for _ in range(len(prints)):
        new = int(np.argmin(np.where(inside, 255, outside)))
        if inside[new]:  # none left within reach: the next tree begins with the first one outside
            new = int(np.argmin(inside))
        elif outside[new] <= most:
            found_a.append(int(parent[new]))
            found_b.append(new)
        inside[new] = True
        closer = apart[new] < outside
        outside[closer] = apart[new][closer]
        parent[closer] = new
    return found_a, found_b


def listed_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a shortest spanning forest of the fingerprints over distances up to two, without pairs of them.

    Each is listed under those one bit or less from it and joined to the first of every list: the list's
    own fingerprint, one bit from the others, or else one that is two bits from them.
    """
    n = len(prints)
    varied = int(np.bitwise_or.reduce(prints) ^ np.bitwise_and.reduce(prints))
    flips = np.array([0, *(1 << b for b in range(64) if varied >> b & 1)], np.uint64)
    near = (prints[None, :] ^ flips[:, None]).ravel()
    order = np.argsort(near, kind="stable")  # its own fingerprint begins a list
    near = near[order]
    begins = np.concatenate([[True], near[1:] != near[:-1]])
    first = order[begins][np.cumsum(begins) - 1][~begins]
    a, b = first % n, order[~begins] % n
    root = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for own in (first < n, first >= n):
        x, y = a[own], b[own]
        while True:  # every tree but those with no smaller neighbour is hung under one
            lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = lo != hi
            x, y, lo, hi = x[apart], y[apart], lo[apart], hi[apart]
            if not len(x):
                break
            hi, one = np.unique(hi, return_index=True)
            found.append((x[one], y[one]))
            root[hi] = lo[one]
            while (root[root] != root).any():
                root = root[root]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))


def near_groups(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = durable(fingerprints(docs, shingle).select("doc_id", F.col("prints")[0].alias("print")))
    nodes = durable(prints.groupBy("print").agg(F.min("doc_id").alias("node")))
    named = nodes.where("node is not null").select(F.lit(0).alias("kind"), "print", "node")
    roots = components(links(named, bucket))
    nodes = nodes.join(by_size(roots), "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    return prints.join(nodes, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def _hash_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of rows with the sorted different shingle hashes of each text."""
    digest = xxhash.xxh64_intdigest
    for start, end, data, offsets in text_pieces(batch, 1, PIECE):
        yield start, end, [
            np.unique(np.array([digest(x) for x in _shingles(bytes(data[a:b]), shingle)], np.uint64))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        ]


#: A pair of similarity s has no common band with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8, 3e-9 at 0.85.
BANDS, ROWS = 24, 4
_FUNCTIONS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the bands of minima (rows, bands) of sets of hashes, given one after the other; empty sets are alike."""
    keys = np.zeros((len(counts), BANDS), np.uint64)
    rows = np.flatnonzero(counts)
    own = np.empty((len(rows), BANDS), np.uint64)
    own[:] = np.arange(1, BANDS + 1, dtype=np.uint64)
    starts = (np.cumsum(counts) - counts)[rows]
    for i, (mask, factor) in enumerate(_FUNCTIONS if len(rows) else ()):
        least = np.minimum.reduceat((hashes ^ mask) * factor, starts)
        key = (own[:, i // ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        own[:, i // ROWS] = key ^ (key >> np.uint64(32))
    keys[rows] = own
    return keys


def _profiles(texts: DataFrame, shingle: int) -> DataFrame:
    """__uid, n (different shingles), two 64-bit SimHashes and the band keys of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, sets in _hash_sets(batch, shingle):
                counts = np.array([len(s) for s in sets], np.int64)
                hashes = np.concatenate(sets)
                mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                prints = majority_bits(np.stack([hashes, mixed], axis=1), counts).view(np.int64)
                keys = band_keys(hashes, counts).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(counts), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists],
                    ["__uid", "n", "s0", "s1", "keys"],
                )

    return texts.mapInArrow(run, "__uid long, n long, s0 long, s1 long, keys array<long>")


def _sets(texts: DataFrame, uids: DataFrame, shingle: int) -> DataFrame:
    """__uid and the shingle set of the texts ``uids``. Shingles are sorted 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, sets in _hash_sets(batch, shingle):
                low = [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(low)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], ["__uid", "shingles"])

    return durable(texts.join(by_size(uids.distinct()), "__uid").select("__uid", "text").mapInArrow(run, "__uid long, shingles array<int>"))


def _alike(edges: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the edges (a, b) whose shingle sets have the Jaccard similarity."""
    sets = _sets(texts, edges.select(F.col("a").alias("__uid")).unionAll(edges.select(F.col("b").alias("__uid"))), shingle)
    left, right = (sets.select(F.col("__uid").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return durable(edges.join(left, "a").join(right, "b").where(both >= similarity * either).select("a", "b"))


#: Bits of 128 in which the SimHashes of two shingle sets may differ. At similarity 0.8 about 19 do, with a
#: deviation of 4; of unrelated texts 64 do, with a deviation of 6.
PROFILE_BITS = 42


#: Rounds in which a band's texts are compared with one of them, before those still apart are with each other.
ROUNDS = 2
#: Texts of a band that one task compares with as many others, and shingles of one, where their sets are compared.
BLOCK, BLOCK_SHINGLES = 1024, 4096


def _still_apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Those ``rows`` (key, __uid, n, s0, s1) whose key has texts of several groups, with the ``root`` of each."""
    rows = rows.join(roots.select(F.col("node").alias("__uid"), "root"), "__uid", "left")
    rows = rows.withColumn("root", F.coalesce("root", "__uid"))
    open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    return durable(rows.join(by_size(open_keys.where("lo < hi").select("key", "size")), "key"))


def _with_one(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of each text with one of its band, another one every turn."""
    fields = ("__uid", "n", "s0", "s1", "root")
    least = F.min(F.struct(F.xxhash64("key", "__uid", F.lit(turn)).alias("order"), *fields)).alias("one")
    one = by_size(rows.groupBy("key").agg(least).select("key", *[F.col(f"one.{c}").alias(f"{c}_1") for c in fields]))
    bits = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_1"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_1")))
    near = (bits <= PROFILE_BITS) & (F.least("n", "n_1") >= similarity * F.greatest("n", "n_1"))
    return rows.join(one, "key").where((F.col("root") != F.col("root_1")) & near).select(
        F.least("__uid", "__uid_1").alias("a"), F.greatest("__uid", "__uid_1").alias("b")
    )


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, __uid, size, weight, ...) in groups (key, p, q): large bands are cut into blocks, each pair of them a group."""
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / (block * BLOCK_SHINGLES))).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("__uid"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("size", "weight", "other")


def _may_be(i: int, j: slice, n: np.ndarray, s0: np.ndarray, s1: np.ndarray, root: np.ndarray, part: np.ndarray, two: bool, similarity: float) -> np.ndarray:
    """Which of the rows ``j`` row ``i`` is apart from, of the other block where there are two, and may be alike."""
    good = root[j] != root[i]
    if two:
        good &= part[j] != part[i]
    good &= np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i])
    good &= np.bitwise_count((s0[j] ^ s0[i]).view(np.uint64)).astype(np.int16) + np.bitwise_count(
        (s1[j] ^ s1[i]).view(np.uint64)) <= PROFILE_BITS
    return good


def _with_a_chance(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """The ``rows`` that may be alike to another one of their band that they are apart from."""
    groups = _in_blocks(rows.withColumn("weight", F.lit(0)), block).groupBy("key", "p", "q").agg(
        F.collect_list(F.struct("__uid", "n", "s0", "s1", "root", "own")).alias("all")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1)
            ends = own.offsets.to_numpy().tolist()
            uid, n, s0, s1, root, part = (own.values.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            chance = np.zeros(len(uid), bool)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                two = bool((part[lo:hi] != part[lo]).any())
                for i in range(lo, hi):
                    j = slice(i + 1, hi)
                    good = _may_be(i, j, n, s0, s1, root, part, two, similarity)
                    chance[j] |= good
                    chance[i] |= good.any()
            keys = np.repeat(key, np.diff(ends))
            found = [x[ends[0] : ends[-1]][chance[ends[0] : ends[-1]]] for x in (uid, n, s0, s1, root)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[chance[ends[0] : ends[-1]]]), *map(pa.array, found)], ["key", "__uid", "n", "s0", "s1", "root"])

    # Of one block with itself p = q; a group of two blocks may hold only one of them, and then no pair.
    groups = groups.where("p = q or (exists(all, x -> x.own = p) and exists(all, x -> x.own = q))")
    found = groups.select("key", "all").mapInArrow(compared, "key long, __uid long, n long, s0 long, s1 long, root long")
    return durable(found.distinct())


def forest(
    sets: list[np.ndarray], n: np.ndarray, s0: np.ndarray, s1: np.ndarray, root: np.ndarray, part: np.ndarray, similarity: float
) -> tuple[list[int], list[int]]:
    """Places (a, b) of links that join all rows of ``sets`` alike, over what their roots join: fewer links than rows."""
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    own = np.split(codes, np.cumsum(sizes)[:-1])
    root, two = root.copy(), bool((part != part[0]).any())
    holds = np.zeros(int(codes.max(initial=0)) + 1, bool)
    found_a: list[int] = []
    found_b: list[int] = []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(_may_be(i, slice(i + 1, None), n, s0, s1, root, part, two, similarity))
        if not len(others):
            continue
        holds[own[i]] = True
        both = np.array([np.count_nonzero(holds[own[j]]) for j in others.tolist()])
        holds[own[i]] = False
        for j in others[both >= similarity * (sizes[i] + sizes[others] - both)].tolist():
            if root[j] != root[i]:
                found_a.append(i)
                found_b.append(j)
                root[root == root[j]] = root[i]
    return found_a, found_b


def _whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of one group after the other; they come in order of its ``width`` first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(width)])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and [held[0].column(k)[0].as_py() for k in range(width)] != key[:, 0].tolist():
            yield pa.concat_batches(held)
            held = []
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _links_in_bands(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that join all texts alike within a band. A group compares the shingle sets themselves and gives
    fewer links than it has texts, however many pairs are alike or nearly so."""
    rows = _with_a_chance(rows, similarity, block)
    sizes = by_size(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")))
    sets = _sets(texts, rows.select("__uid"), shingle)
    groups = _in_blocks(rows.join(sizes, "key").join(sets, "__uid"), block)
    groups = groups.select("key", "p", "q", "__uid", "n", "s0", "s1", "root", "own", "shingles")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, 3):
            uid, n, s0, s1, root, part = (group.column(k).to_numpy() for k in range(3, 9))
            shingles = group.column(9)
            at, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            a, b = forest([values[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)], n, s0, s1, root, part, similarity)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(uid[b])], ["a", "b"])

    groups = groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return durable(groups.mapInArrow(joined, "a long, b long"))


def _more(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Components of the groups (node, root) and more links (a, b)."""
    return components(groups.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(found))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, n_prints: int = 8, bucket: int = 512, block: int = BLOCK
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the smallest doc_id stays.

    Candidates whose set sizes or 128-bit set fingerprints rule the similarity out are left aside. Every text is
    compared with its closest earlier SimHash candidate first; that joins most of each group. What is still apart is
    compared with the other candidates and with one text of each of its bands, by turns, and at last all texts of a
    band that are still apart with each other, so that no link within a band is missing. There the sets are compared
    in the band's own task, which gives links that join what is alike and no pairs.
    """
    base = durable(docs.select(F.monotonically_increasing_id().alias("__uid"), F.struct(*docs.columns).alias("__doc")), **TEXT)
    texts = base.select("__uid", F.col("__doc.text").alias("text"))
    seeds = tuple(range(SEED, SEED + n_prints))
    prints = durable(fingerprints(texts, 1, seeds, "__uid").select("__uid", F.posexplode("prints").alias("kind", "print")))
    nodes = durable(prints.groupBy("kind", "print").agg(F.min("__uid").alias("node")))
    same = prints.join(nodes, ["kind", "print"]).where("__uid != node").select(F.col("node").alias("a"), F.col("__uid").alias("b"))
    found = same.unionAll(links(nodes, bucket)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    profiles = durable(_profiles(texts, shingle))
    a, b = (profiles.select(F.col("__uid").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "s0", "s1")]) for c in "ab")
    bits = (F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))).cast("int")
    near = durable(
        found.distinct().join(a, "a").join(b, "b").withColumn("bits", bits)
        .where((F.col("bits") <= PROFILE_BITS) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb")))
        .select("a", "b", "bits")
    )
    closest = durable(near.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best")).select("best.a", "b"))
    first = _alike(closest, texts, shingle, similarity)
    groups, tried = components(first), closest
    rows = profiles.select("__uid", "n", "s0", "s1", F.explode("keys").alias("key"))
    for turn in range(ROUNDS):
        rows = _still_apart(rows, roots := by_size(groups))
        pairs = _with_one(rows, turn, similarity)
        if turn == 0:
            apart = near.select("a", "b")
            for c in "ab":
                root = roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
                apart = apart.join(root, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
            pairs = pairs.unionAll(apart.where("ra != rb").select("a", "b"))
        pairs = durable(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            groups = _more(groups, _alike(pairs, texts, shingle, similarity))
        tried = tried.unionAll(pairs)
        rows = rows.drop("root", "size")
    rows = _still_apart(rows, by_size(groups))
    if not rows.isEmpty():
        groups = _more(groups, _links_in_bands(rows, texts, shingle, similarity, block))
    members = groups.unionAll(groups.select(F.col("root").alias("node"), "root").distinct())
    ids = base.select(F.col("__uid").alias("node"), F.col("__doc.doc_id").alias("doc_id")).join(members, "node")
    stays = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    gone = ids.join(stays, "root").where("node != first.node").select(F.col("node").alias("__uid"))
    return base.join(by_size(gone), "__uid", "left_anti").select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
