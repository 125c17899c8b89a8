"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row and column
is computed, nothing is collected). Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vintage.plans import catalog  # noqa: E402
from vintage.session import get_spark  # noqa: E402

HEADLINE = [
    "pit_asof", "days_since_filing", "doc_count_window", "forward_returns", "membership_flag",
    "text_novelty", "macro_ffill", "crosssection_targets", "scoreboard_topk", "ranking_metrics",
    "capped_weights", "strategy_metrics", "clean_pages", "refilter_documents", "token_chunks",
    "stockday_vectors", "training_panel", "crosswalk_resolve", "membership_intervals", "panel_build",
]

# Throughput figures next to the reference's pipeline anchors (BASELINE rows 3, 5, 7, 8):
# query -> (input table whose rows are the unit, unit name)
THROUGHPUT = {
    "clean_pages": ("pages", "pages_per_s"),
    "refilter_documents": ("documents", "docs_per_s"),
    "pit_asof": ("lineitem", "input_rows_per_s"),
    "training_panel": ("lineitem", "input_rows_per_s"),
}

# text queries: the column whose uncompressed bytes give MB/s (BASELINE rows 3 and 5 are rates in bytes)
TEXT_COLUMN = {"clean_pages": ("pages", "html"), "refilter_documents": ("documents", "text")}


def _column_mb(sf_dir: str, table: str, column: str) -> float:
    """Uncompressed MB of one column, from the Parquet footer."""
    import pyarrow.parquet as pq
    m = pq.ParquetFile(f"{sf_dir.rstrip('/')}/{table}.parquet").metadata
    at = m.schema.to_arrow_schema().names.index(column)
    return sum(m.row_group(i).column(at).total_uncompressed_size for i in range(m.num_row_groups)) / 1e6


def _rows(sf_dir: str, table: str) -> int:
    import pyarrow.parquet as pq
    return pq.ParquetFile(f"{sf_dir.rstrip('/')}/{table}.parquet").metadata.num_rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", cpus=cpus)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    # warm-up: JVM JIT, generated-code cache and Python workers, on the smallest
    # tables with the same query shapes (set BENCH_WARMUP_DIR= to skip)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir):
        for n in names:
            catalog.QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        catalog.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()  # includes plan construction and any eager step inside the query
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    tput = {f"{q}_{unit}": round(_rows(sf_dir, t) / times[q], 1)
            for q, (t, unit) in THROUGHPUT.items() if q in times and times[q] > 0}
    tput |= {f"{q}_mb_per_s": round(_column_mb(sf_dir, *c) / times[q], 2) for q, c in TEXT_COLUMN.items() if times.get(q)}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "throughput": tput}))
    spark.stop()


if __name__ == "__main__":
    main()
