import hashlib
import random

import numpy as np
import pytest

from feedloom.llm import repeats
from tests.llm.conftest import documents

N = repeats.LENGTH


def plain(rows):
    """Digest rows from a dictionary of all strings."""
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    seen, out = set(), []
    for some, doc, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - N + 1):
            s = raw[i : i + N]
            if s in seen:
                gone[i : i + N] = b"\1" * N
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc if some else None, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, **parameters):
    found = [tuple(r) for r in repeats.remove_repeats(docs, **parameters).collect()]
    want = plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(repr, found)) == sorted(map(repr, want))


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_edges(edge_docs, group):
    check(edge_docs, group=group)


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_documents(spark, group):
    check(documents(spark), group=group)


def test_overlapping_repeats(spark):
    """Few letters, so that grams, contexts and whole strings repeat in many ways."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts += ["a" * 700, "a" * 99, "a" * 100, "a" * 101, "ab" * 200, "\0" * 150, "x" + "\0" * 120, "é" * 60, "é" * 49 + "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    check(docs)
    check(docs, group=3)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 3)
    monkeypatch.setattr(repeats, "COMBINED", 50)
    monkeypatch.setattr(repeats, "PIECE", 300)
    batches = repeats.remove_repeats
    docs = documents(spark)
    assert batches(docs).count() == docs.count()


def test_classes_against_pairs():
    rng = random.Random(3)
    for _ in range(30):
        contexts, at, group = [], [], []
        for _ in range(25):
            strings, distance = rng.randrange(1, 30), rng.randrange(0, 60)
            strings = min(strings, distance + 1)
            base = "".join(rng.choice("ab") for _ in range(3)) * 60
            text = base[: strings - 1 + N]
            if rng.random() < 0.4:
                cut = rng.randrange(len(text))
                text = text[:cut] + "c" + text[cut + 1 :]
            contexts.append(text.encode())
            at.append((7 << 16) | distance << 8 | (strings - 1))
            group.append(hash(contexts[-1][distance : distance + repeats.GRAM]) % 2**40)
        low, high = repeats.covered_distances(np.array(group), np.array(at), contexts)
        seen = set()
        for i, c in enumerate(contexts):
            strings, distance = (at[i] & 255) + 1, at[i] >> 8 & 255
            own = [(group[i], distance - j, c[j : j + N]) for j in range(strings)]
            covered = [k[1] for k in own if k in seen]
            assert (low[i], high[i]) == ((min(covered), max(covered)) if covered else (-1, -1))
            seen |= set(own)


def test_empty(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
