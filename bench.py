"""Headline timings.  Prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, of which the median counts (default 1)
BENCH_QUERIES  comma-separated names, or ``all``
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

import recordlake as rl
from recordlake.session import CORPUS_CONF
from workload import tables
from workload.queries import all_queries

HEADLINE = (
    "extract_blocks extract_frontmatter_only preset_and where_cmp where_between filename_like fulltext query_channels "
    "merge_layers merge_hot_keys json_widen fill_rate top_columns section_context compact_digest record_form sanitize "
    "tasks_pending task_counts"
).split()
N_FILES = 10_000


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def write_note_files(spark, sf_dir: str) -> str:
    """Small note files on disk, for the cold scan."""
    root = tempfile.mkdtemp(prefix="notes-", dir="/tmp")
    for row in tables.order_notes(spark, sf_dir).limit(N_FILES).toLocalIterator():
        path = root + row["_note_file"]
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(row["content"])
    return root


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for name, value in {
        **CORPUS_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.files.maxPartitionBytes": "2m",
    }.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE

    smallest = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    drain(queries["extract_blocks"](spark, smallest if os.path.isdir(smallest) else sf_dir))  # start workers, load classes

    seconds = {}

    def timed(name, action) -> None:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            action()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name:28} {seconds[name]:8.2f} s", file=sys.stderr, flush=True)

    for name in names:
        timed(name, lambda: drain(queries[name](spark, sf_dir)))

    if not chosen:
        store = tempfile.mkdtemp(prefix="store-", dir="/tmp") + "/records"
        timed("store_write", lambda: rl.snapshot(rl.extract_records(tables.line_notes(spark, sf_dir)), store))
        clause = "status = 'F' AND qty > 30 AND shipped > '1997-01-01'"
        timed("store_where_inferred", lambda: drain(rl.query(rl.read_records(spark, store), where=clause).rows))
        typed = {"presets": {"p": ["status=F"]}, "where": "qty > 30", "types": tables.LINE_TYPES}
        timed("store_preset_where", lambda: drain(rl.query(rl.read_records(spark, store), **typed).rows))
        notes = write_note_files(spark, sf_dir)
        timed(f"scan_{N_FILES}_files", lambda: drain(rl.extract_records(rl.read_corpus(spark, notes))))

    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)[2:]}))


if __name__ == "__main__":
    main()
