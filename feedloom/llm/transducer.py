"""Operator 12, byte-level BPE encoding and decoding by a lazily determinised transducer.

**Encoding.** The merges are compiled into a transducer that reads bytes and writes tokens. As a
non-deterministic machine it is in the middle of some token of the vocabulary's trie: it may end that
token and start the next one if the two may follow each other, which is so if merging the two tokens'
joined bytes gives the two back. Of all paths through a word exactly one keeps to this at every border,
and it is the result of the merges. Determinising it by subsets gives states that are lists of hypotheses:
(place in the trie, last token, tokens not yet written). Tokens on which all hypotheses agree are written at
once, and a hypothesis without a continuation in the trie is dropped, so what waits is bounded by
the longest token, whatever the word's length. States and transitions are made when a word first needs
them and kept up to a limit, beyond which the worker starts anew.

The transducer reads each different word of a batch once; words are the matches of the tokenizer's pattern. A word that is
itself a token is that token, as in the library.

**Decoding.** Token bytes are joined; characters come from an incremental UTF-8 machine whose state is what a character
still lacks, so a token may end inside one. What isn't UTF-8 becomes U+FFFD as Python's ``replace`` has it. Most tokens lead
from the state between characters back to it; only the others are stepped through.

No shuffle: both directions are one pass over the rows.

Defined cases: a null or empty text has no tokens and decodes to no bytes; a string value with bytes that
aren't UTF-8 is read with U+FFFD in their place; rows are encoded on their own, repeated ones alike; an empty table gives
no rows; ``encode`` and ``decode`` keep other columns and replace ones named like theirs. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from feedloom.llm.common import small_batches, text_pieces
from feedloom.llm.known import Known, splitter

#: Text bytes encoded at a time.
PIECE = 1 << 20
#: Transitions, and pairs of tokens, that a worker keeps; beyond that it starts anew.
KEPT = 1_000_000

#: (node of the trie, last token or -1, tokens that wait to be written)
Hypothesis = tuple[int, int, tuple[int, ...]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a line each, the token in base 64."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Transducer:
    """Byte-pair merges by rank as a deterministic machine that grows as it is used."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks, self.kept, self.none = ranks, kept, max(ranks.values()) + 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Trie: (node << 8 | byte) -> node, 0 is the root. The token that ends in a node, and whether the node has a child.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    after = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = after
            self.token[node] = rank
        self._forget()

    def _forget(self) -> None:
        self.pairs: dict[int, bool] = {}
        #: (state << 8 | byte) -> (next state, tokens written).
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.states: list[tuple[Hypothesis, ...]] = []
        self.number: dict[tuple[Hypothesis, ...], int] = {}
        #: Tokens still to be written where the input ends.
        self.last: list[tuple[int, ...]] = []
        self._state(((0, -1, ()),))

    def _state(self, hypotheses: tuple[Hypothesis, ...]) -> int:
        found = self.number.get(hypotheses)
        if found is None:
            found = self.number[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.last.append(hypotheses[-1][2])
        return found

    def merge(self, word: bytes) -> list[bytes]:
        """The definition: the pair of lowest rank is joined, the leftmost of equals, until none has a rank."""
        ranks, none, parts = self.ranks, self.none, [word[i : i + 1] for i in range(len(word))]
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

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may stand after ``left`` (-1: at the start)."""
        key = (left + 1) << 32 | right
        found = self.pairs.get(key)
        if found is None:
            b = self.bytes_of[right]
            a = self.bytes_of[left] if left >= 0 else b""
            found = self.pairs[key] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The move of a state by a byte, made when it is first needed."""
        after: list[Hypothesis] = []
        ended: Hypothesis | None = None
        for node, left, waiting in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                after.append((node, left, waiting))
            token = self.token[node]
            if ended is None and token >= 0 and self.follows(left, token):
                ended = (0, token, (*waiting, token))
        after.append(ended)
        first = after[0][2]
        agreed = len(first)
        for _, _, waiting in after:
            while waiting[:agreed] != first[:agreed]:
                agreed -= 1
        if agreed:
            after = [(node, left, waiting[agreed:]) for node, left, waiting in after]
        made = (self._state(tuple(after)), first[:agreed])
        self.moves[state << 8 | byte] = made
        return made

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        state, out = self.run(0, word)
        out += self.last[state]
        return out

    def run(self, state: int, part: bytes) -> tuple[int, list[int]]:
        """The state after some bytes, and the tokens that they decide."""
        out: list[int] = []
        moves = self.moves
        for byte in part:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) > self.kept or len(self.pairs) > self.kept:
                    held = self.states[state]
                    self._forget()
                    moves, state = self.moves, self._state(held)
                move = self._move(state, byte)
            state, written = move
            if written:
                out += written
        return state, out


class Stream:
    """Encodes one word that arrives in parts; ``waiting`` tokens at most are held back."""

    def __init__(self, machine: Transducer):
        self.machine, self.state = machine, 0

    def feed(self, part: bytes) -> list[int]:
        """The tokens that these bytes decide."""
        self.state, out = self.machine.run(self.state, part)
        return out

    @property
    def waiting(self) -> int:
        return max(len(h[2]) for h in self.machine.states[self.state])

    def end(self) -> list[int]:
        """The rest; the stream can begin another word."""
        out, self.state = list(self.machine.last[self.state]), 0
        return out


#: The UTF-8 machine: state -> ranges of bytes and the state they lead to. 0 is between characters, 1 to 3 lack as many
#: continuation bytes; 4 to 7 are after a first byte (E0, ED, F0, F4) that narrows the second one.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6),
        (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)], 2: [(0x80, 0xBF, 1)], 3: [(0x80, 0xBF, 2)],
    4: [(0xA0, 0xBF, 1)], 5: [(0x80, 0x9F, 1)], 6: [(0x90, 0xBF, 2)], 7: [(0x80, 0x8F, 2)],
}
BROKEN = 8
STEP = [[BROKEN] * 256 for _ in UTF8]
for _state, _ranges in UTF8.items():
    for _low, _high, _after in _ranges:
        STEP[_state][_low : _high + 1] = [_after] * (_high - _low + 1)


class Utf8:
    """Characters of bytes that arrive in parts. ``state`` and the bytes of the character that isn't complete are kept."""

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, part: bytes) -> str:
        """The characters that these bytes complete."""
        if not self.state and part.isascii():
            return part.decode("ascii")
        out: list[str] = []
        state, data = self.state, self.held + part
        start, at = 0, len(self.held)
        while at < len(data):
            after = STEP[state][data[at]]
            if after == BROKEN:
                # What was read of the character is replaced; the byte begins another one, unless it can't.
                out.append("�")
                at += state == 0
                state, start = 0, at
                continue
            at += 1
            state = after
            if not state:
                out.append(data[start:at].decode())
                start = at
        self.state, self.held = state, data[start:]
        return "".join(out)

    def end(self) -> str:
        """U+FFFD if a character isn't complete."""
        out, self.state, self.held = "�" if self.held else "", 0, b""
        return out


class Decoder:
    """Bytes and characters of token ids."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        size = max(bytes_of) + 1
        #: Whether a token leads from between characters to between characters; its characters then.
        self.closed = np.zeros(size, bool)
        self.text: list[str] = [""] * size
        for rank, token in bytes_of.items():
            machine = Utf8()
            text = machine.feed(token)
            if not machine.held and "�" not in text:
                self.closed[rank], self.text[rank] = True, text

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """Text as it becomes certain: runs of closed tokens at once, the others byte by byte."""
        machine = Utf8()
        closed = self.closed[ids]
        cuts = [0, *(np.flatnonzero(closed[1:] != closed[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if closed[a]:
                if machine.held:
                    yield machine.end()
                yield "".join(map(self.text.__getitem__, ids[a:b].tolist()))
            else:
                yield machine.feed(self.bytes(ids[a:b].tolist()))
        yield machine.end()

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids))

    def decode_bytes(self, ids: np.ndarray, raw: bytes) -> str:
        """The same where the bytes are at hand: closed tokens only need no machine."""
        return raw.decode() if self.closed[ids].all() else self.decode(ids)


class Coder:
    """What a worker keeps: the machine, words known by now, and the decoder."""

    def __init__(self, path: str, pattern: str):
        self.machine = Transducer(read_ranks(path))
        self.split = splitter(pattern)
        self.known = Known(lambda words: [self.machine.encode(w.encode()) for w in words])
        self.decoder = Decoder(self.machine.bytes_of)
        self.decimal = [str(i) for i in range(self.machine.none)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        return self.known.texts(texts, self.split)


@functools.cache
def coder(path: str, pattern: str) -> Coder:
    """One for each worker process, which runs many tasks."""
    return Coder(path, pattern)


def _texts(data: memoryview, offsets: np.ndarray) -> list[str]:
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with the column ``ids`` (one of that name is replaced)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for start, end, data, offsets in text_pieces(batch, at, PIECE):
                ids, counts = own.encode(_texts(data, offsets))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with the column ``decoded``, the text of their ``ids`` (null: empty)."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(path, pattern).decoder
        for batch in batches:
            lists = [np.array([] if x.values is None else x.values, np.int64) for x in batch.column(at)]
            texts = pa.array(map(decoder.decode, lists), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (of the ids' bytes), and whether the
    characters that the ids stream out are the text."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        decimal = own.decimal.__getitem__
        for batch in batches:
            for start, end, data, offsets in text_pieces(batch, 1, PIECE):
                texts = _texts(data, offsets)
                ids, counts = own.encode(texts)
                ends = np.cumsum(counts)
                sums, digests, same = [], [], []
                for text, a, b in zip(texts, (ends - counts).tolist(), ends.tolist(), strict=True):
                    one = ids[a:b].tolist()
                    raw = own.decoder.bytes(one)
                    sums.append(hashlib.sha256(" ".join(map(decimal, one)).encode()).hexdigest())
                    digests.append(hashlib.sha256(raw).hexdigest())
                    same.append(own.decoder.decode_bytes(ids[a:b], raw) == text)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), pa.array(counts), pa.array(sums, pa.string()),
                    pa.array(digests, pa.string()), pa.array(same, pa.bool_()),
                ], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"
    )
