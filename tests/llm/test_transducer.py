import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from feedloom.llm import queries, transducer
from feedloom.llm.known import Known
from tests.llm.conftest import documents

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=transducer.read_ranks(FILE), special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(transducer.read_ranks(FILE))


ALPHABETS = ["ab", "aeiou nst", " \n", "x", "0123 ", "日本é🤗 ́", "abcdefghijklmnopqrstuvwxyz", "=-_*", "   a", " \t\n\x0b\x1c\x85\xa0 '.s"]


def strings(rng, n):
    for alphabet in ALPHABETS:
        for _ in range(n):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(70)))


def test_same_as_the_library(library):
    own = transducer.Coder(FILE, PATTERN)
    texts = list(strings(random.Random(2), 300))
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)] == [library.encode_ordinary(t) for t in texts]


def test_words_of_joined_tokens(library, machine):
    rng = random.Random(3)
    tokens = list(machine.ranks)
    for _ in range(3000):
        word = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5)))
        assert machine.encode(word) == [machine.ranks[p] for p in machine.merge(word)]


def test_small_vocabularies_with_ties():
    # Every order of ranks of a few short tokens, all words of two letters up to length 7.
    from itertools import permutations, product

    for merged in permutations([b"aa", b"ab", b"ba", b"aaa"]):
        ranks = {**{bytes([i]): i for i in range(256)}, **{t: 256 + i for i, t in enumerate(merged)}}
        machine = transducer.Transducer(ranks)
        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for n in range(1, 8):
            for letters in product("ab", repeat=n):
                assert machine.encode("".join(letters).encode()) == own.encode_ordinary("".join(letters))


def test_stream_in_parts_and_bounded_lookahead(machine):
    rng = random.Random(4)
    longest = max(map(len, machine.ranks))
    for text in [*strings(rng, 20), "x" * 5000, "é" * 3000, "".join(rng.choice("aeiourst") for _ in range(5000))]:
        word, stream, out, at = text.encode(), transducer.Stream(machine), [], 0
        while at < len(word):
            n = rng.randrange(1, 9)
            out += stream.feed(word[at : at + n])
            at += n
            assert stream.waiting <= longest
        assert out + stream.end() == [machine.ranks[p] for p in machine.merge(word)]


def test_starting_anew_changes_nothing(library):
    small = transducer.Transducer(transducer.read_ranks(FILE), kept=50)
    for text in strings(random.Random(5), 10):
        word = text.strip().encode()
        assert small.encode(word) == ([small.ranks[p] for p in small.merge(word)] if word not in small.ranks else [small.ranks[word]])
    assert len(small.moves) <= 51


def test_known_words_are_halved():
    asked = []

    def encode(words):
        asked.append(list(words))
        return [[len(w), 7] for w in words]

    known = Known(encode, limit=3)
    texts = ["a a bb", None, "", "ccc a", "dddd a bb"]
    for _ in range(3):
        ids, counts = known.texts(texts, str.split)
        assert counts.tolist() == [6, 0, 0, 4, 6]
        assert ids.tolist() == [1, 7, 1, 7, 2, 7, 3, 7, 1, 7, 4, 7, 1, 7, 2, 7]
    assert asked[0] == ["a", "bb", "ccc", "dddd"] and asked[1] == ["ccc", "dddd"]


def test_missing_bytes():
    with pytest.raises(ValueError):
        transducer.Transducer({b"a": 0})


def test_utf8_machine():
    rng = random.Random(6)
    good = "aé日🤗ÿ߿ࠀ퟿￿𐀀\U0010ffff".encode()
    for _ in range(4000):
        data = bytes(rng.choice(good) if rng.random() < 0.8 else rng.randrange(256) for _ in range(rng.randrange(12)))
        machine, out, at = transducer.Utf8(), "", 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out += machine.feed(data[at : at + n])
            at += n
        assert out + machine.end() == data.decode("utf-8", "replace")


def test_decoder(library):
    rng = random.Random(7)
    decoder = transducer.Decoder({v: k for k, v in transducer.read_ranks(FILE).items()})
    for _ in range(500):
        ids = [rng.randrange(50256) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(30))]
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids)
        assert decoder.bytes(ids) == library.decode_bytes(ids)


def plain(library, doc, text):
    ids = library.encode_ordinary(text or "")
    return (
        doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(library.decode_bytes(ids)).hexdigest(), True,
    )


def test_edges(spark, edge_docs, edge_rows, library):
    found = [tuple(r) for r in transducer.round_trip(edge_docs, FILE, PATTERN).collect()]
    assert sorted(map(repr, found)) == sorted(repr(plain(library, *r[:2])) for r in edge_rows)


def test_clashing_columns_and_round_trip(spark, edge_docs):
    both = transducer.decode(transducer.encode(edge_docs.selectExpr("*", "1 AS ids", "2 AS decoded"), FILE, PATTERN), FILE, PATTERN)
    assert both.columns == [*edge_docs.columns, "ids", "decoded"]
    rows = both.collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert transducer.decode(none, FILE, PATTERN).collect()[0]["decoded"] == ""


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    row = transducer.round_trip(docs, FILE, PATTERN).collect()[0]
    assert row["decoded_sha256"] == hashlib.sha256("a�b".encode()).hexdigest()


def test_very_long_text(spark, library):
    text = "x" * 100_000 + " é" * 20_000 + "\n" * 5_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in transducer.round_trip(docs, FILE, PATTERN).collect()] == [plain(library, 1, text)]


def test_empty(spark, no_docs):
    assert transducer.round_trip(no_docs, FILE, PATTERN).count() == 0


def test_query(spark, library):
    found = [tuple(r) for r in queries.op12_bpe_transducer(spark, "/root/testdata/sf0.001").collect()]
    want = [plain(library, r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert sorted(found) == sorted(want)


def test_splitter():
    import regex

    from feedloom.llm.known import _latin, splitter

    rng = random.Random(8)
    split, plain = splitter(PATTERN), regex.compile(PATTERN)
    assert _latin(PATTERN) is not None and _latin(r"\d+|\w") is None and _latin(r"\p{Lu}") is None
    for n in range(4000):
        # Latin-1 with its odd letters, numbers and spaces; in every fourth text other characters too.
        more = "日 ١Ⅳ" if n % 4 == 0 else ""
        text = "".join(rng.choice("ab 's'll\n\t\x0b\x1c\x85\xa0ªµº²¼ÿ×é_-1" + more) for _ in range(rng.randrange(25)))
        assert split(text) == plain.findall(text)
    for c in map(chr, range(256)):
        assert split(c * 2 + "a" + c + " " + c) == plain.findall(c * 2 + "a" + c + " " + c)
