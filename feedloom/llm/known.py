"""Ids of texts by those of their words, each different word encoded once by a worker."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Sequence
from itertools import chain, repeat

import numpy as np
import regex


#: Fixed value: the pattern of the library's byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a tokenizer's pattern. Texts of Latin-1 characters go through a plain pattern of the same meaning, in half the time."""
    every, latin = regex.compile(pattern).findall, _latin(pattern)
    if latin is None:
        return every
    some = re.compile(latin).findall

    def split(text: str) -> list[str]:
        if text.isascii():
            return some(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return some(text)

    return split


def _latin(pattern: str) -> str | None:
    """The pattern with its classes of characters written out for those below U+0100; None if it has classes beyond these."""
    sets = {
        name: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(name, chr(c))) for name in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in sets:
            out.append(sets[part] if inside else f"[{sets[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{sets[chr(92) + 's']}]")
        elif len(part) > 1 and part[1].isalnum():
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def library(path: str):
    """A file of the tokenizers library, which then uses one thread: Spark runs a worker for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Lines:
    """Encodes words with a byte-level tokenizer of the library, those without inner white space many to a text, a line each.

    The tokenizer cuts before and after a line end between characters that aren't, and gives it one id, which
    no word without line ends has.
    """

    #: A word that stands on a line: white space only in front, and one space at most.
    PLAIN = re.compile(r" ?\S+")

    def __init__(self, model):
        self.model = model
        self.line_end = model.encode("\n", add_special_tokens=False).ids

    def __call__(self, words: list[str]) -> list[list[int] | np.ndarray]:
        out: list[list[int] | np.ndarray] = [[]] * len(words)
        single = len(self.line_end) == 1
        plain = [i for i, w in enumerate(words) if single and self.PLAIN.fullmatch(w)]
        for k in range(0, len(plain), 5_000):
            own = plain[k : k + 5_000]
            (found,) = self.model.encode_batch_fast(["\n".join([words[i] for i in own])], add_special_tokens=False)
            ids = np.array(found.ids, np.int32)
            cuts = np.flatnonzero(ids == self.line_end[0])
            ends = [*cuts.tolist(), len(ids)]
            flat = ids.tolist()
            for i, a, b in zip(own, [0, *(cuts + 1).tolist()], ends, strict=True):
                out[i] = flat[a:b]
        odd = sorted(set(range(len(words))) - set(plain))
        for k in range(0, len(odd), 5_000):
            own = odd[k : k + 5_000]
            for i, x in zip(own, self.model.encode_batch_fast([words[i] for i in own], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out


class Known:
    """The ids of words as flat arrays; ``encode`` gives those of new words.

    At most ``limit`` words are kept from one batch to the next: beyond it only the half that
    was used most stays, so memory is bounded and frequent words are not encoded again.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.numbers: dict[str, int] = {}
        #: Ids of word i: ids[ends[i]:ends[i + 1]]; how often it was asked for: uses[i].
        self.ids, self.ends, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, valid until the next call."""
        if len(self.numbers) > self.limit:
            self._halve()
        numbers = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            numbers[new] = np.fromiter(map(self.numbers.__getitem__, missing), np.int64, len(missing))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        ends = np.cumsum(sizes)
        gather = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
        return self.ids[gather], sizes

    def texts(self, texts: Sequence[str | None], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. ``split`` cuts a text into words."""
        return self.words_of(*words_of(texts, split))

    def words_of(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where the texts are cut already: their words, and how many each text has."""
        ids, sizes = self.gathered(self.look_up(words))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def _learn(self, words: list[str]) -> None:
        found = list(self.encode(words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])

    def _halve(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
        ids, sizes = self.gathered(stay)
        words = list(self.numbers)
        self.numbers = {words[i]: k for k, i in enumerate(stay.tolist())}
        self.ids, self.ends = ids, np.concatenate([[0], np.cumsum(sizes)])
        self.uses = self.uses[stay] // 2


def words_of(texts: Sequence[str | None], split: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray]:
    """The words of all texts, one after the other, and how many each has."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = split(text)
            counts[i] = len(own)
            words += own
    return words, counts
