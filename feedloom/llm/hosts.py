"""Operator 4, URL filters: host word segmentation, then multinomial naive Bayes.

Urls that a (host, path) rule fits are judged by the longest one. The others are judged by
a naive Bayes model of the words in host and path, learned from the urls that a rule judges.
Host names run words together; a name is split into the words of highest joint unigram
probability (Viterbi), with the counts of all words of all pages, and ``10 / (n * 10^length)``
for a string that is no word of theirs.

Nothing that grows goes to the driver or into a closure. Each different name is listed with its
substrings of the lengths that counted words have, which are joined to the word counts; a name's known
substrings then fill its lattice. Words of any length are counted and found whole. Token weights are joined to the urls' tokens. Counts are combined
before every shuffle, and a token of all urls is split by AQE like any hot key.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and has no
token; with no token, or equal scores, the verdict is ``allow``; without urls judged by rules the model has no
preference; rows with equal page_id are judged one by one; a null html has no word; an empty table
gives no rows; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import by_size
from feedloom.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"\p{L}+"
#: What isn't text of a page.
MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (nulls where none does)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: how often each word (of letters, two or more, lower case) is in the texts of all pages."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), MARKUP, " ")
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))
    return pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words: each different name of ``names`` split into words."""
    total = max(1, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]))
    names = durable(names.where("name != ''").distinct())
    longest = names.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).alias("n")).first()["n"]
    # Numbers up to the length of the longest name.
    sizes = [r["size"] for r in counts.select(F.length("word").alias("size")).where(F.col("size") <= longest).distinct().collect()]
    parts = (
        names.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("name"))))
        .withColumn("size", F.explode(F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>")))
        .where(F.col("start") + F.col("size") <= F.length("name") + 1)
        .withColumn("word", F.substring("name", F.col("start"), F.col("size")))
    )
    found = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))
    lattice = names.join(found, "name", "left").select("name", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            words = [best_words(r["name"], {(k["start"] - 1, k["size"]): k["n"] for k in r["known"] or ()}, total) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return lattice.mapInArrow(run, "name string, words array<string>")


def best_words(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The split of highest probability; of equals the one whose last word is longest, and so on.

    The cost of an unknown word falls by the same for each letter, so its best start for one end stays the best for the
    next ones until a later start does better: one comparison an end, and as many as known words end there.
    """
    ends: dict[int, list[tuple[int, int]]] = {}
    for (start, size), n in known.items():
        ends.setdefault(start + size, []).append((start, n))
    letter, unknown = math.log(10), math.log(10 / total)
    best: list[tuple[float, int]] = [(0.0, 0)]
    open_start, open_score = 0, 0.0
    for end in range(1, len(name) + 1):
        # The start with the highest score before it, each letter from it on counted.
        if best[end - 1][0] + (end - 1) * letter > open_score + 1e-9:
            open_start, open_score = end - 1, best[end - 1][0] + (end - 1) * letter
        found = (best[open_start][0] + (unknown - (end - open_start) * letter), open_start)
        for start, n in sorted(ends.get(end, ())):
            score = best[start][0] + math.log(n / total)
            if score > found[0] or (score == found[0] and start < found[1]):
                found = (score, start)
        best.append(found)
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def token_weights(tokens: DataFrame) -> tuple[DataFrame, float]:
    """From (token, verdict) of judged urls: token, weight (log odds of allow to block); and the weight of any other token."""
    counted = durable(tokens.groupBy("token").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b")
    ).where("token is not null"))
    n = counted.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("v")).first()
    other = math.log((n["b"] + n["v"] + 1) / (n["a"] + n["v"] + 1))
    return counted.select("token", (F.log((F.col("a") + 1) / (F.col("b") + 1)) + other).alias("weight")), other


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the model; null where a rule judged) of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = durable(rows.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", text.alias("rule"), verdict.alias("by_rule")
    ))
    runs = F.regexp_extract_all("host", F.lit(LETTERS), F.lit(0))
    hosts = rows.select("host").distinct().withColumn("runs", runs)
    names = hosts.select(F.explode("runs").alias("name"))
    words = segmented(names, durable(word_counts(pages)))
    host_words = hosts.select("host", F.explode("runs").alias("name")).join(words, "name").select(
        "host", F.explode("words").alias("token")
    )
    host_words = by_size(host_words.groupBy("host").agg(F.collect_list("token").alias("tokens")))
    # Numbers in a path tell pages apart, not kinds of page.
    path_tokens = F.transform(
        F.regexp_extract_all(F.translate("path", UPPER, LOWER), F.lit(rf"{LETTERS}|\d+"), F.lit(0)),
        lambda t: F.concat(F.lit("/"), F.regexp_replace(t, r"^\d+$", "0")),
    )
    tokens = durable(
        rows.join(host_words, "host", "left")
        .select("row", "by_rule", F.explode_outer(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), path_tokens)).alias("token"))
    )
    weights, other = token_weights(tokens.where("by_rule is not null").select("token", F.col("by_rule").alias("verdict")))
    judged = rows.groupBy("by_rule").count().where("by_rule is not null").collect()
    prior = {r["by_rule"]: r["count"] for r in judged}
    odds = math.log((prior.get("allow", 0) + 1) / (prior.get("block", 0) + 1))
    weight = F.when(F.col("token").isNotNull(), F.coalesce("weight", F.lit(other))).otherwise(0.0)
    scores = tokens.where("by_rule is null").join(by_size(weights), "token", "left").groupBy("row").agg(
        (F.round(F.sum(weight) + odds, 9)).alias("score"), F.count("token").alias("n")
    )
    scores = scores.withColumn("score", F.when(F.col("n") > 0, F.col("score")).otherwise(0.0)).drop("n")
    return rows.join(scores, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score",
    )
