import hashlib
import math
import random
import re
from collections import Counter

import pytest

from feedloom.llm import entropy
from tests.llm.conftest import documents

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain(text):
    text = text or ""
    base = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if (len(m[2]) >= 6) if name == "assign" else len(m[0]) >= (20 if name == "access" else 24):
                base.append((m.start(), k, m.end()))
    more = set()
    for c in entropy.CLASSES:
        for m in re.finditer(c.pattern, text):
            if any(re.search(a, m[0]) for a in entropy.ALLOWED):
                continue
            runs = []
            for i in range(len(m[0]) - c.window + 1):
                counts = Counter(m[0][i : i + c.window]).values()
                if -sum(n / c.window * math.log2(n / c.window) for n in counts) >= c.bits:
                    if runs and runs[-1][1] >= i:
                        runs[-1][1] = i + c.window
                    else:
                        runs.append([i, i + c.window])
            more |= {(m.start() + a, 3, m.start() + b) for a, b in runs}
    more = [x for x in more if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)]
    write = lambda spans: ",".join(f"{entropy.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], hashlib.sha256(write(base).encode()).hexdigest(), write(base + more)


def check(docs):
    want = [(r["doc_id"], *plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in entropy.scan(docs).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    return want


def test_edges(edge_docs):
    check(edge_docs)


def test_documents(spark):
    check(documents(spark))


def test_made_up(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    parts = ["token", "TOKEN = ", "secret: ", "é🤗", " ", ", ", "api_key='", "apikey=", "password", "abc", "AKIA", "AKIAKIA", "passwd:"]
    texts = []
    for _ in range(150):
        line = ""
        for _ in range(rng.randrange(1, 9)):
            line += rng.choice(parts)
            kind = rng.randrange(4)
            pool = [letters, "0123456789abcdef", "ab1", "ABCDEFGH0123456789"][kind]
            line += "".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 5, 6, 16, 24, 30, 60])))
        texts.append(line)
    texts += ["secret: token: abcdefg", "token=secret:abcdefgh", "0123456789abcdef" * 3, "550e8400-e29b-41d4-a716-446655440000",
              "x" + letters * 3, "a1" * 40, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)


@pytest.mark.parametrize("allow", [(), ("q8Zt5LmX0bVn3Rk7Yw2Hc9Jd",)])
def test_allow_list(spark, allow):
    docs = spark.createDataFrame([(1, "see q8Zt5LmX0bVn3Rk7Yw2Hc9Jd here")], "doc_id long, text string")
    (row,) = entropy.scan(docs, allow=allow).collect()
    assert row["spans"] == ("" if allow else "entropy:4:28")


def test_native_and_empty(spark, no_docs):
    assert entropy.scan(no_docs).count() == 0
    plan = entropy.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_very_many_matches(spark):
    """In chunks, and with time in proportion: 16,000 matches took most of a minute when every match copied the list."""
    import time

    rng = random.Random(9)
    line = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(30))
    texts = [" ".join(line() for _ in range(n)) for n in (1, 255, 256, 257, 600)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    took = []
    for n in (4_000, 16_000):
        docs = spark.createDataFrame([(1, " ".join(line() for _ in range(n)))], "doc_id long, text string")
        begin = time.perf_counter()
        (row,) = entropy.scan(docs).collect()
        took.append(time.perf_counter() - begin)
        assert row["n_hex"] == n
    assert took[1] < 10 * took[0] + 5
