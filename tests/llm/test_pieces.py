import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from feedloom.llm import pieces
from tests.llm.conftest import documents

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "a", " a", "  a", "a     b", " " * 40 + "x", " " * 17, " " * 300, "é▁b", "日本語 テキスト", "\n\n\n  \t x", "12345 67.89",
    "🤗🤗 ok", "<unk> <s> <0x41>", "a\0b", "x" * 500, "antidisestablishmentarianism " * 3, "   ".join("abc"),
]


def encoded(model, texts):
    ids, counts = model.encode(texts)
    ends = np.cumsum(counts)
    return [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]


def test_same_ids_as_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = ODD + [r["text"] for r in documents(spark, "/root/testdata/sf0.01").where("doc_id % 3 = 0").collect()]
    model = pieces.load(FILE)
    found = encoded(model, texts)
    assert found == library.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert model.decode(ids) == text.replace("▁", " ")


def test_both_merges_agree():
    model = pieces.load(FILE)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("▁aethino ,.é") for _ in range(rng.randrange(1, 100)))
        assert model.merge(text) == model._merge_long(text)


def test_unigram_is_the_best_path():
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(2)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.trainer_spec.unk_surface = " ⁇ "
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.pieces.add(piece="<unk>", score=0, type=2)
    names = sorted({pieces.MARK, *"abc"} | {rng.choice([pieces.MARK, ""]) + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    for name in names:
        proto.pieces.add(piece=name, score=-rng.randrange(1, 4000) / 64, type=1)
    model = pieces.Model(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = {i: p.score for i, p in enumerate(proto.pieces)}

    def best(text):
        found = [0.0]
        for end in range(1, len(text) + 1):
            found.append(max(
                found[start] + score[model.ids[text[start:end]]] for start in range(end) if text[start:end] in model.ids
            ))
        return found[-1]

    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
        (ids,) = encoded(model, [text])
        assert sum(score[i] for i in ids) == best(pieces.MARK + text.replace(" ", pieces.MARK))
        assert ids == library.encode(text)
        assert model.decode(ids) == text


def test_round_trip(edge_docs, edge_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    want = []
    for doc, text, *_ in edge_rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((text or "").encode()).hexdigest(), True))
    found = pieces.round_trip(edge_docs, FILE).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_columns_stay(edge_docs, no_docs):
    both = pieces.decode(pieces.encode(edge_docs.withColumnRenamed("word", "ids"), FILE), FILE)
    assert both.columns == [c for c in edge_docs.columns if c != "word"] + ["ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in both.collect())
    assert pieces.round_trip(no_docs, FILE).count() == 0


@pytest.mark.parametrize("known", [0, 50])
def test_forgetting_changes_nothing(monkeypatch, known):
    monkeypatch.setattr(pieces, "KNOWN", known)
    with open(FILE, "rb") as file:
        model = pieces.Model(file.read())
    texts = [" ".join(["the", "theory", "there", "a" * k, "is"]) for k in range(1, 40)]
    assert [encoded(model, [t])[0] for t in texts] == encoded(pieces.load(FILE), texts)


def test_ids_are_decoded_too(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = [None, "", "one two", " a  b ", "line\nline\ttab", "gämma 中文 🙂", "a▁b", "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source", "1 as other")
    found = pieces.ids_of(docs, FILE).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(text) and r["exact"] == (library.decode(r["ids"]) == text)
    assert {r["exact"] for r in found} == {True, False}


def test_ids_of_uses_one_worker(spark):
    """Ids and whether they decode to the text come from one pass: a task holds the model once."""
    docs = spark.createDataFrame([(1, "a", "one two  three"), (2, None, ""), (3, "b", None)], "doc_id long, source string, text string")
    found = pieces.ids_of(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in rows.values()) and [rows[i]["n_ids"] > 0 for i in (1, 2, 3)] == [True, False, False]
