import hashlib
import sys
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedloom.llm import alignment, queries
from tests.llm.conftest import SCHEMA, documents

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    # The usual table of byte-level vocabularies.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in shown}
    for x in range(256):
        if x not in shown:
            chars[chr(256 + len(chars) - len(shown))] = x

    def a_tokens(text):
        found = a.encode(text, add_special_tokens=False)
        return [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in found.ids]

    def b_tokens(text):
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]

    return a_tokens, b_tokens


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def one(sides, text):
    """Tokens, groups and links of a text by comparing all pairs that are near."""
    want = (" " + text).encode() if text else b""
    a, b = (sides[0](" " + text), sides[1](text)) if text else ([], [])
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        a, b = [], []
    a, b = spans(a), spans(b)
    links, j = [], 0
    for lo, hi, i in a:
        while j < len(b) and b[j][1] <= lo:
            j += 1
        k = j
        while k < len(b) and b[k][0] < hi:
            links.append((i, b[k][2]))
            k += 1
    ends = sorted({x[1] for x in a} & {x[1] for x in b})
    groups, lo = [], 0
    for hi in ends:
        groups.append(([i for x, y, i in a if lo <= x and y <= hi], [i for x, y, i in b if lo <= x and y <= hi]) if len(a) < 3000 else None)
        lo = hi
    if len(a) >= 3000:
        groups, ia, ib = [], 0, 0
        for hi in ends:
            own = ([], [])
            while ia < len(a) and a[ia][1] <= hi:
                own[0].append(a[ia][2])
                ia += 1
            while ib < len(b) and b[ib][1] <= hi:
                own[1].append(b[ib][2])
                ib += 1
            groups.append(own)
    return len(a), len(b), groups, links


def plain(sides, rows):
    found = [(doc, *one(sides, text)) for doc, text in rows]
    counts, most = Counter(), defaultdict(int)
    for *_, links in found:
        counts.update(set(links))
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            doc, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        ))
    return out


def same(found, want):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


@pytest.mark.parametrize(("block", "piece"), [(alignment.BLOCK, alignment.PIECE), (3000, 500), (1, 50)])
def test_edges(edge_docs, edge_rows, sides, block, piece):
    docs = edge_docs.selectExpr("*", "1 AS block", "2 AS pair")
    same(alignment.align(docs, A, B, PATTERN, block, piece).collect(), plain(sides, [r[:2] for r in edge_rows]))


ODD = [
    "  two  spaces ", " ", "   ", "\n\n a", "tab\tend ", "▁", "a▁b", "x ▁ y", "<s> </s> <unk> <0x0A> <|endoftext|>", "日本語 テスト", "🤗🤗 🤗", "é" * 40,
    "ﬁ ①½ Ⅳ", "\x00\x01 \x7f", "\x1c\x85\xa0　​", "á ퟿ ￿ \U0010ffff", "it's we'll ' s 's", "1234567 8 9.0", "=" * 70, "a" * 3000,
    " ".join("word" for _ in range(500)), "A B\nC D\r\n\r\n  E", "�",
]


def test_odd_texts(spark, sides):
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    want = plain(sides, rows)
    same(alignment.align(docs, A, B, PATTERN).collect(), want)
    same(alignment.align(docs, A, B, PATTERN, piece=40).collect(), want)
    # The mark character is no space: no tokens.
    assert all(want[i][1:] == (0, 0, 0, 0, 0, 0, "") for i, t in rows if "▁" in t) and all(want[i][1] for i, t in rows if "▁" not in t)


def test_bytes_that_are_not_utf8(spark, sides):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF6220C3' AS string) AS text")
    same(alignment.align(docs, A, B, PATTERN).collect(), plain(sides, [(1, "a�b �")]))


def test_groups_and_best_matches(spark, sides):
    texts = [t for t in ODD if "▁" not in t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for piece in (alignment.PIECE, 60):
        found = defaultdict(list)
        for r in sorted(alignment.groups(docs, A, B, PATTERN, piece).collect(), key=lambda r: (r["doc_id"], r["part"], r["nth"])):
            found[r["doc_id"]].append((r["a"], r["b"]))
        assert dict(found) == {i: one(sides, t)[2] for i, t in enumerate(texts)}
    counts = Counter(x for t in texts for x in set(one(sides, t)[3]))
    most = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    want = {(a, b, n) for (a, b), n in counts.items() if n == most[a]}
    assert {tuple(r) for r in alignment.best_matches(docs, A, B, PATTERN).collect()} == want


def test_long_text_in_parts(spark, sides):
    text = " ".join(f"wörd{i % 977}," for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    same(alignment.align(docs, A, B, PATTERN, piece=10_000).collect(), plain(sides, [(1, text), (2, "short")]))


def test_empty(spark, no_docs):
    assert alignment.align(no_docs, A, B, PATTERN).count() == 0


def test_query(spark, sides):
    found = queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect()
    same(found, plain(sides, [(r["doc_id"], r["text"]) for r in documents(spark).collect()]))


def test_blocks_are_packed(spark, monkeypatch):
    """Rows of blocks stay small, and a few are read or written at a time."""
    texts = [" ".join(f"{'abcdefgh'[(i * j) % 8]}or{i % 7 * j % 31}" for j in range(400)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setitem(alignment.GROUPS, "parquet.block.size", "20000")
    aligned = alignment.blocks(docs, A, B, PATTERN, block=20_000, piece=5_000)
    found = alignment.align(docs, A, B, PATTERN).collect()
    # Two numbers for each different link of a document took 8 bytes; no more than a byte a link here, digests and all.
    links = sum(r["n_links"] for r in found)
    assert aligned.count() > 5 and aligned.drop("pairs", "held").toArrow().nbytes < links
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in aligned.inputFiles()]
    assert sum(g.num_row_groups for g in groups) > 2


def test_memory_of_a_worker():
    """What is held while many different words go by is bounded, and little."""
    texts = [" " + " ".join(f"w{i}x{j * 7919 % 1000}" for j in range(100)) for i in range(3600)]
    docs = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": texts})

    class Frame:
        def __getattr__(self, name):
            return lambda *_, **__: self

    class Taken(Frame):
        sparkSession = Frame()

        def mapInArrow(self, run, _):
            self.run = run
            return self

    taken = Taken()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(alignment, "small_batches", lambda _: None)
        patch.setattr(alignment, "durable", lambda frame, **_: frame)
        patch.setattr(alignment, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(int)}))
        alignment.blocks(taken, A, B, PATTERN)
        alignment.aligner.cache_clear()
        rows = sum(batch.num_rows for batch in taken.run(iter([docs])))
        known = [side.known for side in (alignment.aligner(A, B, PATTERN).a, alignment.aligner(A, B, PATTERN).b)]
        alignment.aligner.cache_clear()
    held = sum(
        sys.getsizeof(k.numbers) + sum(map(sys.getsizeof, k.numbers)) + k.ids.nbytes + k.ends.nbytes + k.uses.nbytes for k in known
    ) / 1e6
    assert rows == 1 and held < 50, held


def test_words_that_do_not_give_their_bytes():
    class Swapped(alignment.Side):
        bytes = [b"a", b"b", b""]

    ids = {"a": [0], "b": [1], "ab": [0, 1], "ba": [0], "abb": [1, 0, 1, 1], "aa": [0, 2, 0]}
    side = Swapped(str.split, lambda words: [ids[w] for w in words])
    assert side.known.encode(["a", "b", "ab"]) and not side.bad
    # Together the bytes are right, word by word they aren't.
    side.known.encode(["ba", "abb"])
    assert side.bad == {"ba", "abb"}
    side.known.encode(["aa", "a"])
    assert side.bad == {"ba", "abb", "aa"}


def test_bad_words_are_bounded():
    class Bad(alignment.Side):
        bytes = [b"x"]

    side = Bad(str.split, lambda words: [[0] for _ in words])
    side.known.limit = 100
    for k in range(40):
        texts = ["x", f"y{k}", *(f"w{i}" for i in range(k * 50, k * 50 + 50))]
        for again in range(2):
            assert side.encode(texts)[2].tolist() == [True] + [False] * 51
    assert len(side.bad) <= 300


def test_empty_texts_fill_blocks(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "cast(null AS string) AS text").coalesce(1)
    assert alignment.blocks(docs, A, B, PATTERN, block=50_000).count() > 1
    assert alignment.align(docs, A, B, PATTERN, block=50_000).distinct().count() == 3000
