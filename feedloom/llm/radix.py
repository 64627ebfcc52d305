"""Operator 8, exact dedup: distributed radix partitioning by leading bytes.

Texts are compared with their white space deleted. All documents are split by
their first bytes; a document alone with its bytes is done, documents that end
there are equal, and every other group is split again by its next, eight times
as many, bytes. Groups never meet in one task: a level is a count by (group,
next bytes, whether they are the last), which copies enter combined, and a join
of the repeated ones back to their documents, which AQE splits where one is hot.
Bytes themselves are compared, so equality rests on no digest. The number of
levels grows with the logarithm of the longest repeated text.

Only documents that share their first bytes with another one are written with
the rest of their text, and each level writes what is still undecided.

Defined cases: a null text is empty, and empty texts are equal; of rows with
equal text, length and doc_id exactly one is kept; a null doc_id counts as the
largest; an empty table gives no rows; columns other than ``doc_id`` and
``text`` take no part and ``keep`` returns them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import SPACES, by_size, text_of
from feedloom.session import durable

FIRST_BYTES = 64
GROWTH = 8


def classes(docs: DataFrame, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of ``docs`` but its text."""
    kept_columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = F.translate(text_of(), SPACES, "").cast("binary")
    rows = docs.select(
        "doc_id", F.struct(*kept_columns or [F.lit(1).alias("none")]).alias("__other"),
        F.length(text_of()).cast("long").alias("__chars"), F.sha2(plain, 256).alias("text_sha256"), plain.alias("__rest"),
    )

    # The first level reads the head of every text; texts follow only for the repeated heads.
    head = (F.substring("__rest", 1, first_bytes).alias("__bytes"), (F.octet_length("__rest") <= first_bytes).alias("__last"))
    repeated = rows.select(*head).groupBy("__bytes", "__last").count().where("count > 1")
    repeated = by_size(repeated.select("__bytes", "__last", (F.monotonically_increasing_id() * 64).alias("__class")))
    first = rows.withColumns({"__bytes": head[0], "__last": head[1]}).join(repeated, ["__bytes", "__last"], "left")
    all_rows = durable(first.select(
        F.monotonically_increasing_id().alias("__row"), "doc_id", "__other", "__chars", "text_sha256", "__class",
        F.when(F.col("__class").isNotNull() & ~F.col("__last"), F.substring("__rest", first_bytes + 1, 2**31 - 1))
        .alias("__rest"),
    ))
    level = all_rows.where("__class is not null").select("__row", "__class", "__rest")
    ended, size = [], first_bytes * GROWTH
    while True:
        ended.append(level.where("__rest is null").select("__row", "__class"))
        open_rows = level.where("__rest is not null")
        if open_rows.isEmpty():
            break
        level = _split(open_rows, size, len(ended))
        size *= GROWTH

    group = reduce(DataFrame.unionAll, ended)
    group = by_size(group)
    narrow = all_rows.drop("__class", "__rest")
    found = narrow.join(group, "__row")
    best = F.struct("__chars", -F.coalesce("doc_id", F.lit(2**63 - 1)), -F.col("__row"), "doc_id")
    groups = found.groupBy("__class").agg(F.max(best).alias("__best"), F.count(F.lit(1)).alias("__size"))
    columns = ["text_sha256", *[F.col(f"__other.`{c}`").alias(c) for c in kept_columns]]
    alone = narrow.join(group, "__row", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        *columns,
    )
    return alone.unionAll(found.join(by_size(groups), "__class").select(
        "doc_id", F.col("__best.doc_id").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__best.col3") == -F.col("__row")).alias("kept"), *columns,
    ))


def _split(rows: DataFrame, size: int, level: int) -> DataFrame:
    """One level: (row, class, rest) of the documents whose next bytes repeat within their class.

    ``rest`` is null where the text ended. Classes get new numbers, with the
    level in the low digits.
    """
    rows = rows.select(
        "__row", "__class", F.substring("__rest", 1, size).alias("__bytes"),
        (F.octet_length("__rest") <= size).alias("__last"), "__rest",
    )
    keys = ["__class", "__bytes", "__last"]
    repeated = rows.groupBy(*keys).count().where("count > 1").select(
        *keys, (F.monotonically_increasing_id() * 64 + level).alias("__next")
    )
    found = rows.join(by_size(repeated), keys)
    return durable(found.select(
        "__row", F.col("__next").alias("__class"),
        F.when(~F.col("__last"), F.substring("__rest", size + 1, 2**31 - 1)).alias("__rest"),
    ))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    wide = docs.withColumn("__text", F.col("text"))
    return classes(wide).where("kept").withColumnRenamed("__text", "text").select(*docs.columns)
