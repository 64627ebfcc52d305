import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, word string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    words = ["alpha", "be", "gämma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mü", "nu"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    passage = prose(60)
    long = prose(3000)
    near = prose(120)
    texts = [None, None, "", " \t\n", "one", "one  ", "o n e", "x" * 400, "x" * 400, "ab " * 300, long, long + " tail",
             long, prose(40), prose(90), prose(40) + "\n" + passage + "\n" + prose(30), prose(20) + " " + passage,
             passage, "é" * 150, "line a\nline a\nline b\n\n\nline a", prose(12), near, near.replace("be", "BE", 1),
             near + " end", "a#b $ % <x> | &", "token = abcdef123 AKIA" + "A1" * 10 + " " + "0af9" * 9]
    rows = []
    for i, text in enumerate(texts):
        rows.append((i * 3 + 1, text, None if i % 7 == 0 else "en", [None, "b", "a", "ä"][i % 4], i, i, None, "w"))
    rows.append(rows[10])
    rows.append(rows[10])
    rows.append((None, "null id", "en", "b", 7, None, "t", None))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, path="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{path}/documents.parquet")
