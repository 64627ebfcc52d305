"""Headline queries, timed warm, as one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from feedloom.plans import catalog
from feedloom.session import build_session

HEADLINE = (
    "feed_list", "feeds_snr", "daily_stats", "rule_stats", "article_view", "search_tokens", "token_table",
    "match_word", "match_phrase", "rate", "title_link_dups", "ingest_items", "dedupe", "apply_ratings", "expire_items",
    "error_runs", "merge_stats", "link_seen", "clean_articles", "discover_feeds",
)


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="feedloom-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("feed_list")
    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = round(run(name), 3)
    print(json.dumps({
        "metric": "sum of warm query times", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
