"""Operator 3, token ids as directly addressable codes (DAC).

An id is split into chunks of ``bits`` bits, lowest first. Level 0 has the
first chunk of every id, level 1 the second chunk of those ids that have one,
and so on; a bitmap for each level but the last says which ids continue. A rank
directory over each bitmap (ones before every block of 512 bits) gives the
place of an id's next chunk, so any token is read by one look-up a level,
without decoding its neighbours.

A file set is a Parquet folder whose rows are segments: the ids of consecutive
documents, encoded as one binary value with its own header, beside the segment's
first id and length, and the ids and lengths of its documents. Segments are
written by Spark's committer, so a lost task leaves nothing behind, and they
are bounded in size, so reading or writing one takes bounded memory. Segments
of one part follow each other; parts follow each other by document id.

Layout of a segment value, all little-endian: magic ``DAC1``; uint32 bits,
levels, number of ids; then for each level: uint64 chunks; the chunks (uint8 or
uint16); and, but for the last level, uint64 words, the bitmap (uint64) and the
directory (uint32, one for each 8 words).

Strings of the file's added tokens inside a text are these tokens, as the library has it by default.

Defined cases: a null or empty text has the end id alone; rows with equal doc_id
stand next to each other in order of their text (null first); a null doc_id
comes first; an empty table gives no segment and no row.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import small_batches, text_pieces
from feedloom.llm.known import BYTE_LEVEL, Known, Lines, library, splitter

MAGIC = b"DAC1"
#: Bits in a block of the rank directory.
BLOCK = 512
#: Ids in a segment, beyond which the next document begins another one.
SEGMENT = 1 << 20

SEGMENTS = "part int, nth int, start long, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"
#: Text bytes given to the tokenizer at a time.
PIECE = 1 << 20


def encode_ids(ids: np.ndarray, bits: int = 8) -> bytes:
    """``ids`` (unsigned) as one DAC value. ``bits`` is 8 or 16."""
    chunk = {8: np.dtype("<u1"), 16: np.dtype("<u2")}[bits]
    rest = np.asarray(ids, np.uint64)
    levels = []
    while True:
        low = (rest & np.uint64((1 << bits) - 1)).astype(chunk)
        rest = rest >> np.uint64(bits)
        more = rest > 0
        levels.append((low, more))
        if not more.any():
            break
        rest = rest[more]
    out = [MAGIC, struct.pack("<III", bits, len(levels), len(ids))]
    for k, (low, more) in enumerate(levels):
        out += [struct.pack("<Q", len(low)), low.tobytes()]
        if k < len(levels) - 1:
            words = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little").view("<u8")
            ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1)
            directory = (np.cumsum(ones) - ones).astype("<u4")
            out += [struct.pack("<Q", len(words)), words.tobytes(), directory.tobytes()]
    return b"".join(out)


class Codes:
    """Reads a DAC value: all ids, a range of them, or a single one."""

    def __init__(self, value: bytes | memoryview):
        value = memoryview(value)
        if bytes(value[:4]) != MAGIC:
            raise ValueError("not a DAC value")
        self.bits, n_levels, self.n = struct.unpack_from("<III", value, 4)
        chunk = np.dtype("<u1" if self.bits == 8 else "<u2")
        at, self.levels = 16, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", value, at)
            low = np.frombuffer(value, chunk, n, at + 8)
            at += 8 + n * chunk.itemsize
            words = directory = None
            if k < n_levels - 1:
                (n,) = struct.unpack_from("<Q", value, at)
                words = np.frombuffer(value, "<u8", n, at + 8)
                directory = np.frombuffer(value, "<u4", n * 64 // BLOCK, at + 8 + 8 * n)
                at += 8 + 8 * n + 4 * len(directory)
            self.levels.append((low, words, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``, by one look-up a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        found = 0
        for k, (low, words, directory) in enumerate(self.levels):
            found |= int(low[i]) << (k * self.bits)
            if words is None or not int(words[i >> 6]) >> (i & 63) & 1:
                break
            i = self._rank(words, directory, i)
        return found

    @staticmethod
    def _rank(words: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones in the bitmap before place ``i``: the directory's entry and at most eight words."""
        i = int(i)
        block, word = i // BLOCK, i >> 6
        inside = int(np.bitwise_count(words[block * (BLOCK // 64) : word]).sum())
        return int(directory[block]) + inside + (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count()

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) as uint32; only their chunks are touched."""
        end = self.n if end is None else end
        out = np.zeros(end - start, np.uint32)
        at, lo, hi = slice(None), start, end
        for k, (low, words, directory) in enumerate(self.levels):
            chunks = low[lo:hi].astype(np.uint32) << np.uint32(k * self.bits)
            out[at] |= chunks
            if words is None or lo >= hi:
                break
            flags = np.unpackbits(words[lo >> 6 : (hi + 63) >> 6].view(np.uint8), bitorder="little")
            more = np.flatnonzero(flags[lo & 63 : (lo & 63) + hi - lo])
            at = more if isinstance(at, slice) else at[more]
            lo = self._rank(words, directory, lo) if len(more) else 0
            hi = lo + len(more)
        return out


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level file, each different word encoded once.

    Added tokens of the file are found in texts first, as the library does, and what lies between them is cut into
    words by the byte-level pattern; no token goes across its cuts.
    """

    def __init__(self, path: str, pattern: str = BYTE_LEVEL):
        model = library(path)
        if "ByteLevel(" not in repr(model.pre_tokenizer) or "add_prefix_space=False" not in repr(model.pre_tokenizer) or model.normalizer:
            raise ValueError(f"{path} is no plain byte-level tokenizer")
        self.added = {t.content: i for i, t in model.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in model.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take white space along")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        lines, self.words = Lines(model), splitter(pattern)

        def encode(words: list[str]) -> list[list[int]]:
            plain = iter(lines([w for w in words if w not in self.added]))
            return [[self.added[w]] if w in self.added else next(plain) for w in words]

        self.known = Known(encode)

    def split(self, text: str) -> list[str]:
        if not any(t in text for t in self.added):
            return self.words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.added else self.words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        return self.known.texts(texts, self.split)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, bits: int = 8, parts: int | None = None) -> None:
    """Encode all texts with a tokenizer file and write their ids, in doc_id order, as DAC segments.

    One shuffle brings the texts into ranges of ids; tokenizing and encoding follow in
    the same task, and the parts are as even as the ranges.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        part, nth, start, n_held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([start]), pa.array([len(ids)]),
                    pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([encode_ids(ids, bits)], pa.binary()),
                ],
                [x.split()[0] for x in SEGMENTS.split(", ")],
            )

        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_pieces(batch, 1, PIECE):
                texts = [str(data[a:b], "utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids, counts = model.encode(texts)
                held.append(np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32))
                doc_ids += own[lo:hi]
                lengths += (counts + 1).tolist()
                n_held += len(held[-1])
                if n_held >= SEGMENT:
                    yield segment()
                    start, nth, n_held = start + n_held, nth + 1, 0
                    doc_ids, lengths, held = [], [], []
        if held:
            yield segment()

    (
        docs.select("doc_id", "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SEGMENTS)
        .write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments, with ``first``: how many ids all earlier parts and segments have.

    One row a part (not a document) is summed up to place the parts.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    placed = spark.createDataFrame(starts, "part int, before long")
    return segments.join(F.broadcast(placed), "part").withColumn("first", F.col("before") + F.col("start")).drop("before")


def tokens_of(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids of every document, from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["codes"]).ids().astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - lengths),
                        pa.array(lengths), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("first", "doc_ids", "lengths", "codes").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id at each global ``place`` (long): the places of a segment are brought to it together, so no code is copied."""
    segments = read(spark, path).select("part", "nth", "first", "n_ids", "codes")
    # Where segments begin, in blocks of the size of a segment; one spans two or three.
    width = SEGMENT.bit_length() - 1
    last = F.greatest(F.col("first"), F.col("first") + F.col("n_ids") - 1)
    spans = segments.select(
        "part", "nth", "first", "n_ids", F.explode(F.sequence(F.shiftright("first", width), F.shiftright(last, width))).alias("block")
    )
    wanted = places.select("place", F.shiftright("place", width).alias("block")).join(spans, "block").where(
        (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_ids"))
    ).select("part", "nth", "place")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        places = asked.column("place").to_pylist() if len(held) else []
        if not places:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["place", "id"])
        codes, first = Codes(held.column("codes")[0].as_buffer()), held.column("first")[0].as_py()
        return pa.table([pa.array(places), pa.array([codes[p - first] for p in places], pa.int64())], ["place", "id"])

    codes = segments.select(F.col("part").alias("__part"), F.col("nth").alias("__nth"), "first", "codes")
    return wanted.groupBy("part", "nth").cogroup(codes.groupBy("__part", "__nth")).applyInArrow(run, "place long, id long")
