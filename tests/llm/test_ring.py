import hashlib
import zlib
from collections import Counter

import pytest

from feedloom.llm import ring
from tests.llm.conftest import documents


def walk(rows, shards, vnodes, slack):
    """Shard of each row: rounds of one step, arcs in ring order, rows of an arc in hash order."""
    nodes = ring.ring(shards, vnodes)
    places = [p for p, _ in nodes]
    at = {}
    for doc, text in rows:
        digest = hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()
        position = int(digest[:15], 16)
        arc = next((i for i, p in enumerate(places) if p >= position), 0)
        raw = (text or "").encode()
        at.setdefault(arc, []).append((position, doc if doc is not None else -1, len(raw) + 1, zlib.crc32(raw)))
    room = ring.capacities(len(rows), shards, slack)
    waiting = [(arc, key, arc) for arc in sorted(at) for key in sorted(at[arc])]
    out = []
    while waiting:
        rest = []
        for arc, key, node in waiting:
            shard = nodes[node][1]
            if room[shard]:
                room[shard] -= 1
                out.append((key, shard))
            else:
                rest.append((arc, key, node))
        waiting = []
        for arc, key, node in rest:
            node = (node + 1) % len(nodes)
            waiting.append((arc, key, node))
    return out


def found(docs, **parameters):
    rows = ring.assign(docs, **parameters).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    return rows


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_bounded(spark, slack):
    docs = documents(spark)
    rows = found(docs, shards=16, vnodes=32, slack=slack)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) <= max(ring.capacities(len(rows), 16, slack))
    if not slack:
        assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_same_as_walking(edge_docs, edge_rows, slack):
    rows = found(edge_docs, shards=4, vnodes=8, slack=slack)
    want = Counter((k[1], k[2], k[3], s) for k, s in walk([r[:2] for r in edge_rows], 4, 8, slack))
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows) == want


def test_limited_movement(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    before = {r["doc_id"]: r["shard"] for r in ring.assign(docs, 16, slack=0.1).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.assign(docs, 17, slack=0.1).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.35 * len(before)


def test_empty(no_docs):
    assert ring.assign(no_docs).count() == 0
