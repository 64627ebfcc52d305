import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from feedloom.llm import golay
from feedloom.llm.components import components
from tests.llm.conftest import documents


def plain_print(text, words, seed=42):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(p, seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def check(docs, **parameters):
    rows = [(r["doc_id"], plain_print(r["text"], 3)) for r in docs.select("doc_id", "text").collect()]
    by_print = defaultdict(set)
    for d, p in rows:
        if d is not None:
            by_print[p].add(d)
    node = {p: min(d) for p, d in by_print.items()}
    near = [(node[p], node[q]) for p, q in combinations(node, 2) if (p ^ q).bit_count() <= 2]
    root = roots(set(node.values()), near)
    want = [(d, f"{p:016x}", root[node[p]] if p in node else None) for d, p in rows]
    found = [tuple(r) for r in golay.near_groups(docs, **parameters).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


@pytest.mark.parametrize("bucket", [64, 1])
def test_edges(edge_docs, bucket):
    check(edge_docs, bucket=bucket)


def test_documents(spark):
    check(documents(spark))


@pytest.mark.parametrize("bucket", [64, 4])
def test_links_of_prints(spark, bucket):
    """Clouds of fingerprints around a few centres, against all pairs."""
    rng = random.Random(6)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(0, p, i) for i, p in enumerate(signed)], "kind int, print long, node long")
    found = {tuple(sorted(r)) for r in golay.links(df, bucket).collect()}
    near = {(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert found <= near
    ids = range(len(prints))
    assert roots(ids, found) == roots(ids, near)


def test_forest_joins_what_all_pairs_join():
    rng = random.Random(7)
    for n in (1, 2, 3, 30, 200):
        centre = [rng.getrandbits(64) for _ in range(3)]
        prints = sorted({rng.choice(centre) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(n)})
        a, b = golay.nearest_links(np.array(prints, np.uint64))
        assert all((prints[i] ^ prints[j]).bit_count() <= 2 for i, j in zip(a, b, strict=True)) and len(a) < len(prints)
        near = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
        assert roots(range(len(prints)), zip(a, b, strict=True)) == roots(range(len(prints)), near)


def test_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    codewords = [c for c in (i << 11 for i in range(4096)) ]
    codewords = np.array(codewords, np.uint32)
    codewords ^= golay._syndromes(codewords)
    assert len(set(codewords.tolist())) == 4096 and min(int(c).bit_count() for c in codewords[1:]) == 7
    for w in words:
        near = {int(c) >> 11 for c in codewords if (int(c) ^ int(w)).bit_count() <= 4}
        assert set(golay.codeword_indices(np.array([w]))[0].tolist()) == near


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    pairs += [(500, i) for i in range(501, 620)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {n: r for n, r in roots({x for p in pairs for x in p}, pairs).items() if n != r}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.where("a < 0")).count() == 0


def shingle_set(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def test_near_duplicates(spark, edge_docs, no_docs):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    texts, planted = [], []
    for k in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(100, 400))]
        planted.append(len(texts))
        texts.append(" ".join(words))
        for _ in range(k % 4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, __uid string, a long")
    kept = golay.near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == planted
    assert golay.near_duplicates(no_docs).count() == 0
    kept = golay.near_duplicates(edge_docs).collect()
    rows = edge_docs.collect()
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    # Whatever went has something alike that stayed.
    for r in rows:
        own = sets[r["doc_id"]]
        assert any(own == sets[k["doc_id"]] or len(own & sets[k["doc_id"]]) >= 0.8 * len(own | sets[k["doc_id"]]) for k in kept)


def kept_of(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return sorted(set(roots(range(len(texts)), pairs).values())), len(pairs)


def test_near_duplicates_appended_cut_and_short(spark):
    """Copies with a passage appended, the end cut, or one word changed in a short text: none may be missed."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    texts = []
    for n in [20, 24, 30, 40, 60, 100, 200, 300] * 5:
        words = prose(n)
        texts.append(words)
        for share in (0.05, 0.1, 0.15, 0.2):
            texts.append(words + prose(int(n * share)))
            if rng.random() < 0.5:
                texts.append(prose(int(n * share)) + words)
        texts += [words[: n - int(n * share)] for share in (0.05, 0.1, 0.15)]
        words = prose(n)
        texts.append(words)
        texts.append(["changed", *words[1:]])
    texts = [" ".join(words) for words in texts]
    want, planted = kept_of(texts)
    assert planted > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in golay.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("block", [1024, 3])
def test_links_left_after_the_check(spark, block):
    """Texts of the same words in another order have one fingerprint; those alike are found behind one that is not."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    texts = []
    for n in (60, 200, 400):
        words = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(4):
            mixed = rng.sample(words, n)
            texts.append(mixed)
            texts.append(mixed[n // 2 :] + mixed[: n // 2])
        # A template: half of the words are common, and some of the texts have a copy.
        for _ in range(12):
            own = [rng.choice(vocabulary) for _ in range(n // 6)]
            texts.append(words + own)
            texts += [words + own + ["end"]] * rng.randrange(2)
    texts = [" ".join(words) for words in texts]
    want, _ = kept_of(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in golay.near_duplicates(docs, block=block).collect()) == want


@pytest.mark.parametrize("bucket", [8, 64])
def test_links_over_many_batches(spark, bucket):
    """Keys go on from one run of rows to the next, small and large ones."""
    rng = np.random.default_rng(13)
    centres = rng.integers(0, 1 << 63, 120, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (120, 60, 2), np.uint64)
    prints = np.unique((centres[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel())
    pairs = [(a, b) for a in range(len(prints)) for b in (a + 1 + np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= 2)).tolist()]
    nodes = spark.createDataFrame([(k, int(p), i + k * 10_000) for k in range(2) for i, p in enumerate(prints.view(np.int64))], "kind int, print long, node long")
    found = {r["node"]: r["root"] for r in components(golay.links(nodes.coalesce(1), bucket)).collect()}
    want = {n: r for n, r in roots(range(len(prints)), pairs).items() if n != r}
    assert found == want | {n + 10_000: r + 10_000 for n, r in want.items()}


@pytest.mark.parametrize("block", [1024, 16])
def test_a_band_gives_no_pairs(spark, block):
    """Texts of a band are joined by fewer links than there are texts in its groups, alike or not."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    words = [rng.choice(vocabulary) for _ in range(200)]
    texts = []
    for i in range(60):
        copy = list(words)
        copy[i] = "changed"
        texts.append(copy)
    texts += [words[:110] + [rng.choice(vocabulary) for _ in range(70)] for _ in range(60)]
    texts = [" ".join(x) for x in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "__uid long, text string")
    rows = golay._profiles(frame, 5).selectExpr("7L AS key", "__uid", "n", "s0", "s1", f"{len(texts)}L AS size", "__uid AS root")
    found = [(r["a"], r["b"]) for r in golay._links_in_bands(rows, frame, 5, 0.8, block).collect()]
    sets = [shingle_set(t) for t in texts]
    alike = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {tuple(sorted(x)) for x in found} <= set(alike)
    assert roots(range(len(texts)), found) == roots(range(len(texts)), alike)
    assert len(alike) > 1000 and len(found) < (60 if block == 1024 else 10 * len(texts))


@pytest.mark.parametrize("most", [8, 200, golay.MOST])
def test_large_buckets_give_forests(spark, most):
    """A dense cloud of fingerprints is joined by fewer links than members a bucket, and by nothing that is listed in rows."""
    rng = random.Random(13)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 2) for j in range(64)}
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(300)}
    own = np.array(sorted(prints), np.uint64)
    apart = np.bitwise_count(own[:, None] ^ own[None, :])
    near = list(zip(*(x.tolist() for x in np.nonzero(np.triu(apart <= 2, 1))), strict=True))
    nodes = spark.createDataFrame([(0, p, i) for i, p in enumerate(own.view(np.int64).tolist())], "kind int, print long, node long")
    frame = golay.links(nodes, 4, most)
    found = [(r["a"], r["b"]) for r in frame.collect()]
    assert all(apart[a, b] <= 2 for a, b in found)
    assert roots(range(len(own)), found) == roots(range(len(own)), near)
    place, _ = golay.keys_of(own)
    if most == golay.MOST:
        assert len(found) < len(place)
    a, b = golay.listed_links(own)
    assert len(a) == len(set(roots(range(len(own)), near))) - len(set(roots(range(len(own)), near).values()))
    shortest = golay.nearest_links(own)
    assert sorted(apart[a, b].tolist()) == sorted(apart[shortest[0], shortest[1]].tolist())
