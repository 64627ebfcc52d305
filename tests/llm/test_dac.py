import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import dac
from feedloom.session import shared_folder
from tests.llm.conftest import documents

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [8, 16])
def test_codes(bits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = dac.Codes(dac.encode_ids(ids, bits))
        assert codes.ids().tolist() == ids.tolist()
        assert [codes[i] for i in range(n)] == ids.tolist()
        for _ in range(20):
            a = rng.integers(0, n + 1)
            b = rng.integers(a, n + 1)
            assert codes.ids(a, b).tolist() == ids[a:b].tolist()


def whole(rows):
    model = Tokenizer.from_file(FILE)
    start, out, everything = 0, [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        everything += ids
    return out, everything


def check(spark, docs, rows):
    folder = shared_folder(spark)
    dac.write(docs, folder, FILE)
    found = [tuple(r) for r in dac.tokens_of(dac.read(spark, folder)).collect()]
    want, everything = whole(rows)
    assert sorted(found, key=lambda r: r[1]) == want
    places = sorted(random.Random(1).sample(range(len(everything)), min(200, len(everything))))
    looked = dac.token_at(spark, folder, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert sorted((r["place"], r["id"]) for r in looked) == [(p, everything[p]) for p in places]


def test_edges(spark, edge_docs, edge_rows):
    check(spark, edge_docs, [r[:2] for r in edge_rows])


def test_documents(spark, monkeypatch):
    docs = documents(spark)
    check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty(spark, no_docs):
    folder = shared_folder(spark)
    dac.write(no_docs, folder, FILE)
    assert dac.tokens_of(dac.read(spark, folder)).count() == 0


def test_words_change_nothing():
    model = Tokenizer.from_file(FILE)
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \t\n\x1c\xa0 abé1.,'s日🤗") for _ in range(rng.randrange(80))) for _ in range(600)]
    texts += ["<|endoftext|> a <|endoftext|>", " lead", "trail ", "a  b", "it's we'll ' s", ""]
    texts += [" ".join(rng.choice(["the", "\x85", "a\nb", "é", "x\x1cy", "word", "Ċ"]) for _ in range(30)) for _ in range(50)]
    encoder = dac.Encoder(FILE)
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    found = [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    assert found == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_found(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "x<|endoftext|"), (4, "'<|endoftext|>s  <|endoftext|> ")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)
    found, _ = dac.Encoder(FILE).encode(["a <|endoftext|> b"])
    assert found.tolist() == [64, 220, 50256, 275]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        dac.Encoder(public_tokenizers.path("word_bpe_49k.json"))
