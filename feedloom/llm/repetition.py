"""Operator 1, quality rules: repeated substrings of a text from its suffix array.

Words are the symbols. The words that lie in a 5-word window found twice in
the text are cut out, their suffix array is built, and the tree of
common-prefix intervals gives the maximal repeated substrings (intervals whose
members have different words in front). The spans of repeats of ``min_words``
or more are united; a text is rejected if they cover too large a part of its
characters, or if one of them is too long.

Every text is judged on its own, so the work is one pass without a shuffle.

Defined cases: a null or empty text has no words and fails the base rule; a
text of one repeated word is one repeat; equal rows get equal verdicts; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm import suffixes
from feedloom.llm.common import small_batches, text_pieces

WINDOW = 5
#: Text bytes worked on at a time.
PIECE = 1 << 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_repeats long, longest_repeat long, repeat_chars long"
)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def keep(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    row = F.struct(*docs.columns)
    judged = _judged(docs.select("doc_id", "text", row.alias("__doc")), ["__doc"], **limits)
    return judged.where("kept").select(*[F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


def repetition(docs: DataFrame, **limits) -> DataFrame:
    """Verdict and its figures for each row of ``docs`` (doc_id, text); limits as in ``_judged``."""
    return _judged(docs.select("doc_id", "text"), [], **limits)


def _judged(
    docs: DataFrame, carried: list[str], min_words: int = 10, max_covered: float = 0.2, max_longest: int = 200,
    least_words: int = 10, max_window_share: float = 0.2,
) -> DataFrame:
    """``docs`` begins with doc_id and text; ``carried`` columns follow and pass through."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in text_pieces(batch, 1, PIECE):
                f = text_figures(data, offsets, min_words)
                failed = (f["n_words"] < least_words) | (f["n_repeat_words"] > max_window_share * f["n_words"])
                f["base_failed"] = failed
                f["kept"] = ~failed & (f["longest_repeat"] <= max_longest) & (
                    f["repeat_chars"] <= max_covered * f["word_chars"]
                )
                through = [batch.column(2 + k).slice(start, end - start) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), *(pa.array(f[x]) for x in names[1:]), *through], names + carried
                )

    schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, *(docs.schema[c] for c in carried)])
    return docs.mapInArrow(run, schema)


def text_figures(data: memoryview, offsets: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """Figures of several texts that lie one after the other in ``data``."""
    n = len(offsets) - 1
    raw = np.frombuffer(data, np.uint8)

    def counted(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

    words: list[bytes] = []
    n_words, n_dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        text = bytes(data[lo:hi])
        own = text.split()
        words += own
        n_words[i] = len(own)
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        n_dup_lines[i] = len(lines) - len(set(lines))
    out = {
        "n_words": n_words, "n_dup_lines": n_dup_lines,
        "word_chars": counted(_FIRST[raw] & ~_SPACE[raw]), "n_symbols": counted(_SYMBOL[raw]),
    }
    doc = np.repeat(np.arange(n), n_words)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    chars = np.fromiter(map(len, words), np.int64, len(words))
    if len(words) and any(not w.isascii() for w in index):
        size = np.fromiter((len(w.decode("utf-8", "replace")) for w in index), np.int64, len(index))
        chars = size[ids]
    twice = repeated_windows(ids, doc, len(index))
    covered = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k:] |= twice[: len(ids) - k]
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    out |= _maximal_repeats(ids, doc, covered, chars, n, min_words)
    return {k: v.astype(np.int64) for k, v in out.items()}


def repeated_windows(ids: np.ndarray, doc: np.ndarray, n_ids: int) -> np.ndarray:
    """Where a window of five words begins that is found elsewhere in the same text.

    Windows of two words first; only where these repeat are longer ones compared.
    """
    n = len(ids)
    twice = np.zeros(n, bool)
    if n <= WINDOW:
        return twice
    _, own, _ = suffixes.ranked(doc * n_ids + ids)
    pair = np.full(n, -1, np.int64)
    at = np.flatnonzero(doc[1:] == doc[:-1])
    pair[at] = _tied(own[at] * n_ids + ids[at + 1])
    four = np.full(n, -1, np.int64)
    at = np.flatnonzero((pair[:-2] >= 0) & (pair[2:] >= 0))
    four[at] = _tied(pair[at] * n + pair[at + 2])
    at = np.flatnonzero((four[:-4] >= 0) & (pair[3:-1] >= 0))
    at = at[_tied(four[at] * n + pair[at + 3]) >= 0]
    twice[at] = True
    return twice


def _tied(keys: np.ndarray) -> np.ndarray:
    """A number for each key that occurs again, -1 for others."""
    if not len(keys):
        return keys
    _, rank, classes = suffixes.ranked(keys)
    return np.where(np.bincount(rank, minlength=classes)[rank] > 1, rank, -1)


def _maximal_repeats(
    ids: np.ndarray, doc: np.ndarray, covered: np.ndarray, chars: np.ndarray, n: int, min_words: int
) -> dict[str, np.ndarray]:
    out = {k: np.zeros(n, np.int64) for k in ("n_repeats", "longest_repeat", "repeat_chars")}
    at = np.flatnonzero(covered)
    if not len(at):
        return out
    # The covered words, with a symbol of its own wherever they don't follow each other.
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])) + 1
    symbols = (doc[at] * (int(ids.max()) + 1) + ids[at]).astype(np.int64)
    first = int(symbols.max()) + 1
    symbols = np.append(np.insert(symbols, cut, first + np.arange(len(cut))), first + len(cut))
    place = np.append(np.insert(at, cut, -1), -1)
    order, levels = suffixes.suffix_array(symbols)
    prefixes = suffixes.common_prefixes(order, levels)
    left, right, depth, _ = suffixes.prefix_intervals(prefixes, min_words)
    if not len(left):
        return out
    before = np.where(order > 0, symbols[order - 1], -1)
    # Cuts are symbols of their own, so a repeat that begins at one is diverse.
    diverse = suffixes.left_diverse(left, right, before)
    left, right, depth = left[diverse], right[diverse], depth[diverse]
    owner = doc[place[order[left]]]
    np.add.at(out["n_repeats"], owner, 1)
    np.maximum.at(out["longest_repeat"], owner, depth)
    # Of a suffix in several intervals the deepest counts; deeper ones are written later.
    reach = np.zeros(len(order), np.int64)
    for i in np.argsort(depth, kind="stable").tolist():
        reach[left[i] : right[i] + 1] = depth[i]
    edge = np.zeros(len(symbols) + 1, np.int64)
    begins = order[reach > 0]
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + reach[reach > 0], -1)
    inside = (np.cumsum(edge[:-1]) > 0) & (place >= 0)
    out["repeat_chars"] = np.bincount(doc[place[inside]], weights=chars[place[inside]], minlength=n)
    return out
