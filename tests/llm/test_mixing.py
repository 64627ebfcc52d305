import random
from collections import Counter, defaultdict

import pytest

from feedloom.llm import mixing
from tests.llm.conftest import documents


def water(sizes, weights=(1, 2, 3), times=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        share = (total - sum(held.values())) / (sum(weight[s] for s in free) or 1)
        over = [s for s in free if share * weight[s] >= times * sizes[s]]
        if not over:
            return held | {s: share * weight[s] for s in free}
        held |= {s: times * sizes[s] for s in over}


@pytest.mark.parametrize("case", ["edge", "docs", "cells"])
def test_targets_and_taken(spark, edge_docs, case):
    docs = edge_docs if case == "edge" else documents(spark)
    block, rows = (4, 5) if case == "cells" else (64, 50_000)
    found = mixing.taken(docs, block_words=block, shard_rows=rows).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in docs.collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, took = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[source[r["doc_id"]]] += r["size"]
        took[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water(sizes)
    for r in found:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
    cells = 1 if case != "cells" else 40
    for s in sizes:
        assert abs(took[s] - want[s]) <= block * (1 + cells)
    again = mixing.taken(docs.repartition(3), block_words=block, shard_rows=rows).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_highest_quotients(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        claims = [rng.choice([0, 1, rng.randrange(1, 100), rng.randrange(1, 10000)]) for _ in range(rng.randrange(1, 12))]
        seats = rng.randrange(0, 60)
        seats = seats if sum(claims) else 0
        got = [0] * len(claims)
        for _ in range(seats):
            best = max(range(len(claims)), key=lambda i: (claims[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        for i, c in enumerate(claims):
            rows.append((g, i, float(c), seats))
            want[g, i] = got[i]
    df = spark.createDataFrame(rows, "g int, i int, claim double, seats long")
    found = mixing.sainte_lague(df, ["g"], ["i"], "claim", "seats").collect()
    assert {(r["g"], r["i"]): r["quota"] for r in found} == want


def test_mix_texts(edge_docs, edge_rows):
    mixed = mixing.mix(edge_docs, block_words=16)
    assert mixed.columns == edge_docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    want = defaultdict(int)
    for r in mixing.taken(edge_docs, block_words=16).collect():
        if r["taken"]:
            want[r["doc_id"]] += r["taken"]
    assert words == want


def test_empty(no_docs):
    assert mixing.taken(no_docs).count() == 0
    assert mixing.mix(no_docs).columns == no_docs.columns
