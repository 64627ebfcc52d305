"""Operator 11, alignment of two tokenizers over the same texts.

Both tokenizers encode a text; their tokens, as bytes, tile the same bytes (a space and the text), so a token of one side
is linked to those of the other whose bytes it overlaps. Links come from pandas ``merge_asof``, one batch of texts
at a time and keyed by document: each token's start finds the token of the other side that covers it, in both
directions. The overlap of two tokens begins where one of them does, so the union of the two directions is all links.
Where tokens of both sides begin together a group begins; these are the offsets where both end.

How many documents hold a link between two ids is counted corpus-wide. Documents are aligned in blocks of bounded text; a block is
one row with its different id pairs, how many of its documents hold each, and its documents packed to one value, with the
places of their own pairs in that list. Only (block, pair) rows are counted, joined and brought back to the block, so no
task sees more than a block, and no row a pair of tokens.

Memory: a worker holds ``KNOWN`` words of either side, the arrays of ``RUN`` characters and the places of one block, whatever
the input; the JVM moves packed documents, a few rows to a row group, which bounds what is read or written at a time.

Each side encodes a different word once a worker as long as it is kept (``known``); no token crosses a border of such words: for the
byte-level side they are its pattern's matches, for the piece side runs of marks with what follows. Texts beyond ``PIECE``
are worked on in parts cut in front of a single space between two characters that aren't white space, where both sides cut.

Shuffles: the pairs of the blocks for the count and the join, and the blocks' places to meet them.

Defined cases: a null or empty text, and one whose tokens don't give its bytes back on either side (one with the mark character,
or a side that normalises), has no tokens and zeros throughout; bytes that aren't UTF-8 are read as U+FFFD; strings of special
tokens are plain text; rows are aligned on their own, repeated or of equal id, and each counts as a document; an empty table
gives no rows; columns other than doc_id and text don't count.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_size, small_batches, text_pieces
from feedloom.llm.known import Known, Lines, library, splitter, words_of
from feedloom.session import durable

MARK = "▁"
MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text aligned at a time, where groups are given out and where they are summed up, and text bytes in a block of documents.
PIECE = 1 << 20
RUN = 1 << 18
BLOCK = 8 << 20
#: Bytes that a document counts in its block besides its text: empty texts fill one, too.
ROW = 100
#: Words that a worker keeps of either side.
KNOWN = 200_000
#: Blocks are large rows: a row group ends after some megabytes of them, not after a hundred at least.
GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


class Side:
    """One tokenizer: its words, and for every text the ids and whether their bytes are the text's.

    A new word whose ids don't give its bytes back is remembered as long as it is kept, and a text with such a word is not good.
    """

    #: Of each id.
    bytes: list[bytes]

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[Sequence[int]]]):
        self.split, self.bad = split, set()

        def checked(words: list[str]) -> list[Sequence[int]]:
            found = encode(words)
            table = self.bytes
            # Some at a time: mostly all are good.
            for k in range(0, len(words), 1000):
                own, ids = words[k : k + 1000], found[k : k + 1000]
                if self._all_good(own, ids):
                    continue
                for word, some in zip(own, ids, strict=True):
                    parts = [table[i] for i in some]
                    if b"".join(parts) != self.raw(word) or not all(parts):
                        self.bad.add(word)
            return found

        self.known = Known(checked, KNOWN)

    def raw(self, word: str) -> bytes:
        return word.encode()

    def _all_good(self, words: list[str], found: list[Sequence[int]]) -> bool:
        """Whether the ids give the bytes of all words: so they do together, and as many for each."""
        parts = list(map(self.bytes.__getitem__, chain.from_iterable(found)))
        raw = self.raw("".join(words))
        if b"".join(parts) != raw:
            return False
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        # A character below U+0080 is a byte, and a mark is read as one of these.
        own = words if raw.isascii() else map(self.raw, words)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))]
        return bool(sizes.all()) and np.array_equal(ends, np.cumsum(np.fromiter(map(len, own), np.int64, len(words))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, how many each has, and whether they are its bytes."""
        words, counts = words_of(texts, self.split)
        if len(self.bad) > self.known.limit:
            # Words that are not kept are checked again when they come again.
            self.bad.intersection_update(self.known.numbers)
        ids, sizes = self.known.words_of(words, counts)
        good = np.ones(len(texts), bool)
        if self.bad:
            wrong = np.fromiter(map(self.bad.__contains__, words), bool, len(words))
            good[np.repeat(np.arange(len(texts)), counts)[wrong]] = False
        if sum(map(len, words)) != sum(map(len, texts)):
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            good &= [sum(map(len, words[a:b])) == len(t) for t, a, b in zip(texts, ends, ends[1:], strict=False)]
        return ids, sizes, good


class ByteSide(Side):
    """A byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str):
        model = library(path)
        model.encode_special_tokens = True
        super().__init__(splitter(pattern), Lines(model))
        byte_of = self._byte_of()
        self.bytes = [b""] * model.get_vocab_size()
        for token, i in model.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(byte_of[c] for c in token)

    @staticmethod
    def _byte_of() -> dict[str, int]:
        """The characters that stand for bytes: printable Latin-1 ones for themselves, others for those from U+0100 on."""
        printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        rest = [b for b in range(256) if b not in printable]
        return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PieceSide(Side):
    """A piece model that marks spaces and puts one in front."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)

        def encode(words: list[str]) -> list[list[int]]:
            # The library puts the first mark back; of nothing it makes no piece.
            found = model.encode([w[1:] for w in words], num_threads=1)
            return [ids if len(w) > 1 else [model.piece_to_id(MARK)] for w, ids in zip(words, found, strict=True)]

        super().__init__(lambda text: MARKED.findall(text.replace(" ", MARK)), encode)
        self.bytes = [
            bytes([int(p[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i)
            else p.replace(MARK, " ").encode()
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))
        ]

    def raw(self, word: str) -> bytes:
        return word.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes, good = super().encode(texts)
        # A mark in the text itself comes back as a space.
        return ids, sizes, good & [MARK not in t for t in texts]


class Aligner:
    """Both sides, and the texts of their ids."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = ByteSide(a_path, pattern), PieceSide(b_path)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        #: A's ids with a comma, A's with a bar, B's with a comma, B's with a semicolon.
        self.words = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]

    def align(self, texts: list[str]) -> Aligned:
        """Texts as they are tiled (with the space in front)."""
        (a, n_a, good_a), (b, n_b, good_b) = self.a.encode(texts), self.b.encode(texts)
        good = good_a & good_b
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return Aligned(self, a, b, n_a, n_b, good)


class Aligned:
    """Links and groups of a batch of texts."""

    def __init__(self, aligner: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, good: np.ndarray):
        self.aligner, self.a, self.b, self.n_a, self.n_b, self.good = aligner, a, b, n_a, n_b, good
        n = len(good)
        sides = []
        for ids, sizes, counts, name in ((a, aligner.sizes[0], n_a, "a"), (b, aligner.sizes[1], n_b, "b")):
            own = sizes[ids]
            sides.append(pd.DataFrame({
                "at": np.cumsum(own) - own, "doc": np.repeat(np.arange(n), counts), name: np.arange(len(ids)),
            }))
        left, right = sides
        # Offsets run on from text to text, so both sides are in order already.
        b_of_a = pd.merge_asof(left[["at", "doc"]], right, on="at", by="doc")["b"].to_numpy(np.int64)
        a_of_b = pd.merge_asof(right[["at", "doc"]], left, on="at", by="doc")["a"].to_numpy(np.int64)
        at_a, at_b = left["at"].to_numpy(), right["at"].to_numpy()
        self.starts_a = at_b[b_of_a] == at_a
        self.starts_b = at_a[a_of_b] == at_b
        other = ~self.starts_b
        #: The links by place in ``a`` and ``b``, and their text.
        self.link_a = np.concatenate([left["a"].to_numpy(), a_of_b[other]])
        self.link_b = np.concatenate([b_of_a, right["b"].to_numpy()[other]])
        doc_a, doc_b = left["doc"].to_numpy(), right["doc"].to_numpy()
        self.link_doc = np.concatenate([doc_a, doc_b[other]])
        self.n_links = np.bincount(self.link_doc, minlength=n)
        self.n_groups = np.bincount(doc_a[self.starts_a], minlength=n)

    def pairs(self) -> np.ndarray:
        """The ids of the links, as one number each."""
        return self.a[self.link_a].astype(np.int64) * self.aligner.n_b + self.b[self.link_b]

    def group_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each side in each group."""
        return tuple(np.diff(np.append(np.flatnonzero(starts), len(starts))) for starts in (self.starts_a, self.starts_b))

    def group_texts(self) -> list[str]:
        """Of each text its groups, each with a semicolon behind it."""
        size_a, size_b = self.group_sizes()
        before = np.cumsum(size_a + size_b) - size_a - size_b
        place_a = np.arange(len(self.a)) + np.repeat(before - (np.cumsum(size_a) - size_a), size_a)
        place_b = np.arange(len(self.b)) + np.repeat(before + size_a - (np.cumsum(size_b) - size_b), size_b)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        n_a, n_b = self.aligner.n_a, self.aligner.n_b
        order[place_a], order[place_b] = self.a, self.b.astype(np.int64) + 2 * n_a
        order[before + size_a - 1] += n_a
        order[before + size_a + size_b - 1] += n_b
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        words = self.aligner.words
        return ["".join(map(words.__getitem__, order[x:y].tolist())) for x, y in zip([0, *ends], ends, strict=False)]


@functools.cache
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One for each worker process, which runs many tasks."""
    return Aligner(a_path, b_path, pattern)


def _parts(data: memoryview, offsets: np.ndarray, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with a space in front, long ones in parts: the row each part belongs to, and the parts, about ``limit`` at a time."""
    rows, parts, held = [], [], 0
    for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if x == y:
            continue
        text, at = " " + str(data[x:y], "utf-8", "replace"), 0
        while at < len(text):
            cut = CUT.search(text, at + limit) if len(text) - at > limit else None
            end = cut.start() if cut else len(text)
            rows.append(i)
            parts.append(text[at:end])
            held += end - at
            at = end
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


class _Rows:
    """Sums over the parts of each row of a run of rows."""

    def __init__(self, n: int):
        self.counts = np.zeros((4, n), np.int64)
        self.sums: list = [None] * n
        self.good = np.ones(n, bool)
        #: Row and pair of the links that were seen, each once for a batch, and how many they are.
        self.seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: list[int], found: Aligned) -> None:
        row = np.array(rows)
        np.logical_and.at(self.good, row, found.good)
        for own, counts in zip(self.counts, (found.n_a, found.n_b, found.n_groups, found.n_links), strict=True):
            np.add.at(own, row, counts)
        for i, text in zip(rows, found.group_texts(), strict=True):
            if text:
                if self.sums[i] is None:
                    self.sums[i] = hashlib.sha256(text[:-1].encode())
                else:
                    self.sums[i].update(b";" + text[:-1].encode())
        width = found.aligner.n_a * found.aligner.n_b
        # Rows are numbered within the batch, so that row and pair fit one number.
        own, local = np.unique(row, return_inverse=True)
        codes, times = np.unique(local[found.link_doc] * width + found.pairs(), return_counts=True)
        self.seen.append((own[codes // width], codes % width, times))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair and number of all links, in order of row and pair."""
        row, pair, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.seen, strict=True)) if self.seen else (
            np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        stay = self.good[row]
        row, pair, times = row[stay], pair[stay], times[stay]
        order = np.lexsort([pair, row])
        row, pair, times = row[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])[: len(row)])
        return row[first], pair[first], np.add.reduceat(times, first) if len(first) else times

    def digests(self) -> list[str]:
        return [s.hexdigest() if s is not None and good else "" for s, good in zip(self.sums, self.good.tolist(), strict=True)]


BLOCKS = "block long, documents binary, pairs array<long>, held array<int>"
BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed value: for the JVM, bytes instead of long arrays that are copied by element and held unpacked."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> pa.RecordBatch:
    (batch,) = pa.ipc.open_stream(value.as_buffer())
    return batch


def blocks(docs: DataFrame, a_path: str, b_path: str, pattern: str, block: int = BLOCK, piece: int = RUN) -> DataFrame:
    """The documents aligned, a row for each block of them (written out, as it is read twice)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path, pattern)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def written() -> pa.RecordBatch:
            ids, counts, digests, n_places, pairs, times = zip(*held, strict=True)
            held.clear()
            all_pairs, places, n_held = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            del pairs
            ends = np.concatenate([[0], np.cumsum(np.concatenate(n_places))]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (places.astype(np.int32), np.concatenate(times))
            ]
            documents = pa.RecordBatch.from_arrays(
                [
                    pa.array([x for own in ids for x in own], pa.int64()), *map(pa.array, np.concatenate(counts, axis=1)),
                    pa.array([x for own in digests for x in own], pa.string()), *lists,
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"],
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([_packed(documents)], pa.binary()),
                    pa.array([all_pairs], pa.list_(pa.int64())), pa.array([n_held.astype(np.int32)], pa.list_(pa.int32())),
                ],
                BLOCK_NAMES,
            )

        for batch in batches:
            for start, end, data, offsets in text_pieces(batch, 1, piece):
                rows = _Rows(end - start)
                for part_rows, parts in _parts(data, offsets, piece):
                    rows.add(part_rows, own.align(parts))
                row, pair, times = rows.links()
                held.append((
                    batch.column(0).slice(start, end - start).to_pylist(), rows.counts * rows.good, rows.digests(),
                    np.bincount(row, minlength=end - start), pair, times.astype(np.int32),
                ))
                size += len(data) + ROW * (end - start)
                if size >= block:
                    yield written()
                    size, number = 0, number + 1
        if held:
            yield written()

    return durable(docs.select("doc_id", "text").mapInArrow(run, BLOCKS), **GROUPS)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, a, b, n_docs, and whether no other pair of its A id is in more documents (ties included)."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = durable(pairs.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n_docs")))
    counts = counts.withColumn("a", F.expr(f"pair div {n_b}L")).withColumn("b", F.col("pair") % n_b)
    # One row for each id of the A vocabulary.
    best = counts.groupBy("a").agg(F.max("n_docs").alias("__most"))
    return counts.join(F.broadcast(best), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("__most")).alias("best"))


def _judged(block: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block, with the counts of its pairs."""
    row = _unpacked(block.column("documents")[0])
    size = len(found)
    n_docs, best = np.zeros(size, np.int64), np.zeros(size, bool)
    place = found.column("place").to_numpy()
    n_docs[place], best[place] = found.column("n_docs").to_numpy(), found.column("best").to_numpy()
    places, times = (row[name].values.to_numpy() for name in ("places", "times"))
    ends = row["places"].offsets.to_numpy()
    sums = []
    for weight in (best[places] * times, n_docs[places] * times):
        total = np.concatenate([[0], np.cumsum(weight)])
        sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
    return pa.table(
        [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["groups_sha256"]],
        [x.split()[0] for x in DOCUMENT.split(", ")],
    )


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, block: int = BLOCK, piece: int = RUN) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are the best of their A id, and the sum of the links' counts."""
    aligned = blocks(docs, a_path, b_path, pattern, block, piece)
    counts = pair_counts(aligned, _vocabulary(b_path))
    found = aligned.select("block", F.posexplode("pairs").alias("place", "pair")).join(
        by_size(counts.select("pair", "n_docs", "best")), "pair"
    )
    return (
        aligned.drop("pairs", "held").groupBy("block")
        .cogroup(found.select(F.col("block").alias("__block"), "place", "n_docs", "best").groupBy("__block"))
        .applyInArrow(_judged, DOCUMENT)
    )


def _vocabulary(b_path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_path).vocab_size()


def best_matches(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """The alignment as a table from one vocabulary to the other: a, b, n_docs of the pairs in most documents for each A id."""
    counts = pair_counts(blocks(docs, a_path, b_path, pattern), _vocabulary(b_path))
    return counts.where("best").select("a", "b", "n_docs")


def groups(docs: DataFrame, a_path: str, b_path: str, pattern: str, piece: int = PIECE) -> DataFrame:
    """doc_id, part and nth (a group's place in its row), the ids ``a`` and ``b`` of the group. Rows of bad texts are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, _, data, offsets in text_pieces(batch, 1, piece):
                parts_of: dict[int, int] = {}
                for rows, parts in _parts(data, offsets, piece):
                    found = own.align(parts)
                    sizes = found.group_sizes()
                    lists = [
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(x, pa.int32()))
                        for n, x in zip(sizes, (found.a, found.b), strict=True)
                    ]
                    part = []
                    for i in rows:
                        part.append(parts_of.get(i, 0))
                        parts_of[i] = part[-1] + 1
                    many = found.n_groups
                    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[start + i] for i, n in zip(rows, many.tolist(), strict=True) for _ in range(n)], pa.int64()),
                        pa.array(np.repeat(part, many), pa.int32()), pa.array(nth, pa.int64()), *lists,
                    ], ["doc_id", "part", "nth", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, nth long, a array<int>, b array<int>")
