import re
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline
from feedloom.llm import mixing
from tests.llm.conftest import documents
from tests.llm.test_golay import shingle_set
from tests.llm.test_repetition import plain

SF = "/root/testdata/sf0.001"


def passes(text):
    f = plain(text)
    return not f["base_failed"] and f["longest_repeat"] <= 200 and f["repeat_chars"] <= 0.2 * f["word_chars"]


def test_stages_one_by_one(spark):
    docs = documents(spark)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality rules", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]

    def run(name, docs):
        out = corpus_pipeline.written(stages[name](spark, docs, SF))
        return out, [r.asDict() for r in out.collect()]

    rows = [r.asDict() for r in docs.collect()]
    docs, found = run("quality rules", docs)
    rows = [r for r in rows if passes(r["text"])]
    assert docs.columns == columns and sorted(map(repr, found)) == sorted(map(repr, rows))

    docs, found = run("exact dedup", docs)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append(r)
    rows = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]
    assert docs.columns == columns and sorted(map(repr, found)) == sorted(map(repr, rows))

    docs, found = run("SimHash near-dedup", docs)
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    kept = {r["doc_id"] for r in found}

    def alike(a, b):
        return len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    pairs = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    # What went is linked to another text, and what has no link stayed.
    assert docs.columns == columns and set(sets) - kept <= {x for p in pairs for x in p}
    assert {x for x in sets if not any(x in p for p in pairs)} <= kept
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)

    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    docs, found = run("mixing sources to target weights", docs)
    words = Counter()
    for r in found:
        words[r["doc_id"]] += len(r["text"].split())
    assert docs.columns == columns and dict(words) == {d: n for d, n in taken.items() if n}

    texts = Counter(r["text"] for r in found)
    _, found = run("SentencePiece encoding and decoding", docs)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for text, n in texts.items():
        want[tuple(library.encode(text))] += n
    assert Counter(tuple(r["ids"]) for r in found) == want
    assert all(r["n_ids"] == len(r["ids"]) for r in found)
