"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from geneweft.plans import load_all  # noqa: E402
from geneweft.session import get_spark  # noqa: E402

HEADLINE = (
    "series_metrics",
    "oscillation",
    "viability",
    "mc_verdict",
    "rate_table",
    "netlist_topology",
    "relevant_paragraphs",
    "page_paragraphs",
    "search",
    "retrieve_context",
    "distinct_documents",
    "noisy_parameters",
)


def timed(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__checkpoint__dir=os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(queries)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor before the clock
    times = {}
    for name in names:
        runs = [timed(spark, queries[name], sf_dir) for _ in range(2)]
        times[name] = round(min(runs), 3)
        print(name, [round(r, 3) for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
