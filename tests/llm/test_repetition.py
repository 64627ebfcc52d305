import random
import re

from feedloom.llm import repetition, suffixes
from tests.llm.conftest import documents

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, min_words=10):
    """The figures of one text, from comparing all pairs of places."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    at = {}
    for i in range(n - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    long, covered = 0, set()
    at = {}
    for i in range(n - min_words + 1):
        at.setdefault(tuple(words[i : i + min_words]), []).append(i)
    for v in at.values():
        for i in v:
            for j in v:
                if i != j:
                    k = 0
                    while i + k < n and j + k < n and words[i + k] == words[j + k]:
                        k += 1
                    long = max(long, k)
                    covered |= set(range(i, i + k))
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
        "base_failed": n < 10 or 100 * len(inside) > 20 * n, "longest_repeat": long,
        "repeat_chars": sum(len(words[i]) for i in covered),
    }


def check(docs):
    rows = repetition.repetition(docs).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").na.fill({"text": "", "doc_id": -1}).collect())
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r) for r in rows)
    assert len(texts) == len(found)
    for (doc, text), (same, row) in zip(texts, found, strict=True):
        assert doc == same
        want = plain(text)
        assert {k: row[k] for k in want} == want
        over = want["longest_repeat"] > 200 or want["repeat_chars"] > 0.2 * want["word_chars"]
        assert row["kept"] == (not want["base_failed"] and not over)


def test_edges(edge_docs):
    check(edge_docs)


def test_documents(spark):
    check(documents(spark).where("doc_id < 120"))


def test_empty(no_docs):
    assert repetition.repetition(no_docs).count() == 0


def test_long_repeat_is_rejected(spark):
    rng = random.Random(1)
    words = [str(rng.random()) for _ in range(4000)]
    passage = words[:230]
    docs = spark.createDataFrame([(1, " ".join(words + passage)), (2, " ".join(words + passage[:150]))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in repetition.repetition(docs).collect()}
    assert not found[1]["kept"] and not found[1]["base_failed"] and found[1]["longest_repeat"] == 230
    assert found[2]["kept"] and found[2]["n_repeats"] == 1


def test_suffix_array_and_intervals():
    rng = random.Random(2)
    for n in (1, 2, 5, 40, 200):
        for letters in (1, 2, 5):
            s = [rng.randrange(letters) for _ in range(n)] + [99]
            order, levels = suffixes.suffix_array(np.array(s))
            assert order.tolist() == sorted(range(n + 1), key=lambda i: s[i:])
            prefixes = suffixes.common_prefixes(order, levels)

            def shared(i, j):
                k = 0
                while i + k <= n and j + k <= n and s[i + k] == s[j + k]:
                    k += 1
                return k

            assert prefixes.tolist()[1:] == [shared(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
            left, right, depth, above = suffixes.prefix_intervals(prefixes, 1)
            want = {}
            for d in range(1, n + 1):
                groups = {}
                for place, i in enumerate(order.tolist()):
                    if i + d <= n + 1:
                        groups.setdefault(tuple(s[i : i + d]), []).append(place)
                for g in groups.values():
                    if len(g) > 1:
                        want[g[0], g[-1]] = max(d, want.get((g[0], g[-1]), 0))
            assert {(a, b): d for a, b, d in zip(left.tolist(), right.tolist(), depth.tolist(), strict=True)} == want
            assert all(a < d for a, d in zip(above.tolist(), depth.tolist(), strict=True))


def test_keep_returns_whole_rows(edge_docs, no_docs):
    kept = repetition.keep(edge_docs)
    assert kept.columns == edge_docs.columns and repetition.keep(no_docs).count() == 0
    passed = {r["doc_id"] for r in repetition.repetition(edge_docs).where("kept").collect()}
    want = [tuple(r) for r in edge_docs.collect() if r["doc_id"] in passed]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))
