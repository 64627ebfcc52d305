import hashlib
import re
from collections import defaultdict

import pytest

from feedloom.llm import radix
from tests.llm.conftest import documents


def check(docs, **parameters):
    groups = defaultdict(list)
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    want = []
    for text, own in groups.items():
        own.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(d, own[0][2], len(own), i == 0, digest) for i, (_, _, d) in enumerate(own)]
    found = [tuple(r) for r in radix.classes(docs.select("doc_id", "text"), **parameters).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


@pytest.mark.parametrize("first", [1, 4, 64])
def test_edges(edge_docs, first):
    check(edge_docs, first_bytes=first)


def test_documents(spark):
    check(documents(spark))


def test_empty(no_docs):
    assert radix.classes(no_docs).count() == 0 and radix.keep(no_docs).columns == no_docs.columns


def test_keep_returns_the_rows(edge_docs):
    kept = radix.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert set(map(tuple, kept.collect())) <= set(map(tuple, edge_docs.collect()))
    assert kept.count() == radix.classes(edge_docs.select("doc_id", "text")).where("kept").count()
