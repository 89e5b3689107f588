"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from inkstone.plans.catalog import QUERIES
from inkstone.session import session

HEADLINE = [
    "srs_replay",
    "srs_due",
    "history_top_n",
    "save_dedupe",
    "entry_search",
    "audio_worklist",
    "lexicon_lookup",
    "lexicon_misses",
    "fuzzy_join",
    "to_traditional",
    "segment_longest",
    "known_rate",
    "split_syllables",
    "keyword_tags",
    "page_gate",
    "overlap_pairs",
    "coverage_gaps",
    "nearest_anchor",
    "dedupe_quads",
    "page_reading_order",
    "column_gaps",
    "char_cells",
    "cer_report",
    "known_recall",
    "char_overlap_join",
    "annotate_readings",
    "resolve_queries",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        f"local[{cpus}]",
        "inkstone-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the noop sink runs the whole plan and keeps every output column
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
