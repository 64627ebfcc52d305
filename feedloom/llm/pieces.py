"""Operator 7, SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked as the model's library does it (a mark for every space and one
in front) and split where a mark follows something else, and its words further where no piece
of the model has the two characters side by side; no piece goes across such places, so these units
are encoded on their own. Each task keeps the words it knows. New words of a
batch are sorted, which lays them out as a trie in depth-first order: going from one
word to the next keeps the forward states of their common prefix and computes the rest.

The forward state of a prefix depends on the model. For a unigram model it is
the best score of a segmentation and its last piece. A BPE model's scores are merge
ranks, whose sum no merge order maximises, so the best-sum path would not be the model's
encoding; there the state is the last piece of the prefix's own encoding, the one piece
that may follow the state before it (two pieces may follow each other if
merging their joined text gives them back). Both give the library's ids.

Characters outside the vocabulary become byte pieces (or the unknown piece of a model
without them).

Defined cases: a null or empty text has no ids and decodes to the empty text; a mark
character in a text decodes to a space, and the ``exact`` flag says so; every row is
encoded on its own, repeated ones alike; an empty table gives no rows; other columns stay
with ``encode``. A text is encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import small_batches, text_pieces
from feedloom.llm.known import Known

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words and pairs of pieces a task keeps; beyond that it starts anew.
KNOWN = 500_000
PIECE = 1 << 18


class Model:
    """Pieces of a model file, and the encoding of words by them."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        kinds = proto.SentencePiece
        normal = (kinds.NORMAL, kinds.USER_DEFINED)
        self.unigram = proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in normal}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.ids))
        least = min(self.scores[i] for i in self.ids.values())
        self.unknown_score = least - 10.0
        self.text = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE
            else b"" if p.type == kinds.CONTROL
            else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self.text[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        #: What a piece can begin with; other texts need not be looked at further.
        self.begins = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        #: Neighbours inside a piece. Between any other two characters every encoding has a border.
        self.joins = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        self.known = Known(self.encode_words, KNOWN)
        self._units: dict[str, list[int]] = {}
        #: By left piece, then right piece: whether the one may follow the other.
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0

    def units(self, word: str) -> list[str]:
        """The word cut where no piece goes across."""
        joins, out, start = self.joins, [], 0
        for at in range(1, len(word)):
            if word[at - 1 : at + 1] not in joins:
                out.append(word[start:at])
                start = at
        out.append(word[start:])
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of these words, by those of their units."""
        if len(self._units) > KNOWN:
            self._units.clear()
        known, cut = self._units, [self.units(w) for w in words]
        self._encode_units(sorted({u for own in cut for u in own if u not in known}))
        return [known[own[0]] if len(own) == 1 else [i for u in own for i in known[u]] for own in cut]

    def _encode_units(self, units: list[str]) -> None:
        """Ids of different units in sorted order: as a trie is visited depth first, with the forward states of shared prefixes."""
        if self._n_pairs > KNOWN:
            self._pairs.clear()
            self._n_pairs = 0
        known, ids = self._units, self.ids
        step = self._forward_unigram if self.unigram else self._forward_bpe
        states: list = [(0.0, "", ())]
        before = ""
        for unit in units:
            if not self.unigram and unit.startswith(MARK * 2):
                # Runs of marks have pieces of equal score; ties are for the merges themselves.
                known[unit] = [i for p in self.merge(unit) for i in self._ids_of(p)]
                continue
            shared = len(os.path.commonprefix((before, unit)))
            del states[shared + 1 :]
            for end in range(shared + 1, len(unit) + 1):
                states.append(step(unit, end, states))
            before = unit
            parts, end = [], len(unit)
            while end:
                piece = states[end][1]
                parts.append(piece)
                end -= len(piece)
            found: list[int] = []
            for piece in reversed(parts):
                own = ids.get(piece)
                if own is None:
                    found += self._ids_of(piece)
                else:
                    found.append(own)
            known[unit] = found

    def _ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _forward_unigram(self, word: str, end: int, states: list) -> tuple[float, str, tuple]:
        """Best score of the prefix up to ``end`` and its last piece (the shortest of equals, as starts rise)."""
        best, last = None, ""
        for start in range(max(0, end - self.longest), end):
            piece = word[start:end]
            found = self.ids.get(piece)
            if found is None and (end - start > 1):
                continue
            score = states[start][0] + (self.unknown_score if found is None else self.scores[found])
            if best is None or score > best:
                best, last = score, piece
        return best, last, ()

    def _forward_bpe(self, word: str, end: int, states: list) -> tuple[float, str, tuple[int, ...]]:
        """The last piece of the encoding of the prefix up to ``end``, and the starts from which a piece may go on beyond it."""
        ids, pairs, begins = self.ids, self._pairs, self.begins
        last, going = None, []
        for start in (*states[end - 1][2], end - 1):
            piece = word[start:end]
            if piece in begins:
                going.append(start)
            elif end - start > 1:
                continue
            if last is None and (piece in ids or end - start == 1):
                left = states[start][1]
                own = pairs.get(left)
                if own is None:
                    own = pairs[left] = {}
                follows = own.get(piece)
                if follows is None:
                    follows = own[piece] = self.merge(left + piece) == ([left, piece] if left else [piece])
                    self._n_pairs += 1
                if follows:
                    last = piece
        return 0.0, last, tuple(going)

    def merge(self, text: str) -> list[str]:
        """Pieces by the model's merges: the best-scored pair first, the leftmost of equals."""
        if len(text) > 100:
            return self._merge_long(text)
        parts, ranks, none = list(text), self.ranks, float("inf")
        joined = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while joined:
            best = min(joined)
            if best == none:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i:
                joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(joined):
                joined[i] = ranks.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a queue, for texts of any length."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts):
                joined = parts[i] + parts[j]
                found = self.ids.get(joined)
                if found is not None:
                    heapq.heappush(queue, (-self.scores[found], i, j, joined))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def split(self, text: str) -> list[str]:
        """The marked words of a text."""
        return WORDS.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        return self.known.texts(texts, self.split)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.cache
def load(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with the column ``ids`` (one of that name is replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model)
        for batch in batches:
            for start, end, _, ids, counts in _encoded(encoder, batch, at):
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                own = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*own.columns, lists], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _encoded(encoder, batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """Runs of rows of the batch: first, end, texts (empty for null), their ids one after the other, and how many each has."""
    for start, end, data, offsets in text_pieces(batch, at, PIECE):
        texts = [str(data[a:b], "utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield start, end, texts, *encoder.encode(texts)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with the column ``decoded``, the text of their ``ids``."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(model)
        for batch in batches:
            texts = [decoder.decode(x.tolist()) for x in _lists(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values[a:b]


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit integers), decoded_sha256, and whether the text came back."""
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, sums, digests, same = [], [], [], []
            for text, ids in zip(texts, _lists(batch.column(2)), strict=True):
                decoded = decoder.decode(ids.tolist())
                sizes.append(len(ids))
                sums.append(zlib.crc32(np.ascontiguousarray(ids, "<u4")))
                digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == (text or ""))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string()),
                pa.array(same, pa.bool_()),
            ], names)

    return encode(docs.select("doc_id", "text"), model).select("doc_id", "text", "ids").mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean"
    )


def ids_of(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, source, n_ids and ids: what a training run reads; and whether the ids, decoded, give the text back."""
    rows = docs.select("doc_id", "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Encoded and decoded by one worker, which holds the model and its words once.
        encoder = load(model)
        for batch in batches:
            for start, end, texts, ids, counts in _encoded(encoder, batch, 2):
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                exact = [encoder.decode(x.tolist()) == text for text, x in zip(texts, _lists(lists), strict=True)]
                own = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(counts, pa.int32()), lists, pa.array(exact, pa.bool_())],
                    ["doc_id", "source", "n_ids", "ids", "exact"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, T.StructType([
        rows.schema["doc_id"], rows.schema["source"], T.StructField("n_ids", T.IntegerType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType()),
    ]))
