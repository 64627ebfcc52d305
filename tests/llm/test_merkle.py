import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import merkle, queries
from feedloom.session import shared_folder
from tests.llm.conftest import SCHEMA, documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    fields = (row[0], row[3], row[2], row[4], row[1])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """The root of a list of digests, and for each of them the digests left and right of its path."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        subroot, paths = trees[s]
        for (_, _, own, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), paths, strict=True):
            steps = path + top
            claimed = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                claimed = leaf((r[0], None if r[1] is None else r[1].replace("\n", ""), *r[2:]))
            folded = claimed
            for a, b in steps:
                folded = h(a + folded + b)
            out.append((r[0], own, subroot, root, h("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def check(docs, rows, height):
    found = merkle.verify(merkle.proofs(merkle.build(docs, height=height, claimed=merkle.tampered())))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain([r[:5] for r in rows])))


def test_layout():
    for levels in range(1, 10):
        places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.n_nodes(levels)))
    # Four levels: the upper two first, then nine subtrees of two levels, each in one run of four places.
    for i in range(9):
        own = [int(merkle.address(4, 2, np.array(i))), *merkle.address(4, 3, np.arange(3 * i, 3 * i + 3)).tolist()]
        assert own == list(range(4 + 4 * i, 8 + 4 * i))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_subtree(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = merkle.Subtree.build(leaves, merkle._levels(n, 8))
    root, paths = climb(leaves)
    assert tree.root == root and [tree.steps(i) for i in range(n)] == paths
    left, right = tree.all_steps()
    assert [[(a[i], b[i]) for a, b in zip(left, right, strict=True)] for i in range(n)] == paths
    assert all(merkle.fold(x, path) == root for x, path in zip(leaves, paths, strict=True))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_edges(edge_docs, edge_rows, height):
    check(edge_docs.withColumn("tree", F.lit(1)).withColumn("root", F.lit(2)), edge_rows, height)


def rows_of(sizes, seed=1):
    rng, out = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            i = len(out)
            out.append((i * 7 % 100_003, rng.choice(["a\nb", "c", "\n", "", None]) if i % 3 else f"t{i}\n", "en", source, i))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1}, {"a": 82}, {"a": 27, "b": 28, None: 9, "ä": 10, "": 1, "z": 244}, dict.fromkeys(map(str, range(40)), 1)])
def test_sizes_in_several_layers(spark, sizes):
    rows = rows_of(sizes)
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(4)
    check(docs, rows, 2)


def test_a_source_with_most_rows(spark):
    rows = rows_of({"hot": 2500, "b": 30, "c": 1})
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(6)
    check(docs, rows, 3)


def test_rows_of_one_id(spark):
    rows = [(5, f"t{i % 4}", "en", "a", 1) for i in range(60)] + [(None, "x", None, "a", None)] * 3
    check(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(5), rows, 2)


def test_written_manifest_proves_too(spark):
    rows = rows_of({"a": 100, "b": 7})
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    folder = shared_folder(spark)
    first = merkle.proofs(merkle.build(docs, folder, height=2)).collect()
    again = merkle.proofs(merkle.open_manifest(spark, folder, height=2)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == 107
    assert all(merkle.fold(r["leaf"], [tuple(s) for s in r["steps"]]) == r["root"] for r in again)


def test_empty(spark, no_docs):
    assert merkle.manifest_check(no_docs).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in documents(spark).collect()]
    found = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain(rows)))
    assert 0 < sum(r["verified"] for r in found) < len(found)
