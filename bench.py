"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores; ``--all`` runs every
registered query. Each query is written to the noop sink, so all of its rows
are computed. ``index`` gives the stored indexes: writing and searching apart.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from scoutmill.catalog import QUERIES  # noqa: E402
from scoutmill.session import discard_kept, local_session  # noqa: E402

HEADLINE = [
    "clean_text", "prepare_documents", "dedup_first_text", "page_text_rows", "url_exists", "corpus_stats", "html_to_markdown",
    "answer_in_text", "snippet", "dense_topk", "sparse_topk", "hybrid_search", "fulltext_search", "grpo", "rloo", "passk",
    "gae", "batch_metrics", "latency_summary", "validation_metrics", "pairwise_accuracy", "remax_tokens", "pair_calls_with_responses",
    "message_blocks", "visit_url_stats", "upsert_by_key", "fan_out", "pad_to_multiple", "pack_batches", "windowed_stats",
]


def index_times(spark, folder: str) -> dict[str, float]:
    """Seconds to write each stored index and to search it, apart."""
    from scoutmill.catalog.base import Tables
    from scoutmill.catalog.table_queries import dense_docs, item_queries, sparse_docs, sparse_queries
    from scoutmill.operators import indexes as I
    from scoutmill.session import kept_path

    t, sparse, cells, took = Tables(spark, folder), kept_path(spark), kept_path(spark), {}
    steps = {
        "sparse_build": lambda: I.write_sparse_index(sparse_docs(t), sparse),
        "sparse_search": lambda: I.sparse_index_topk(sparse_queries(t), I.open_sparse_index(spark, sparse), 10).collect(),
        "cells_build": lambda: I.write_cell_index(dense_docs(t), cells),
        "cells_search": lambda: I.cell_index_topk(item_queries(t), I.open_cell_index(spark, cells), 10).collect(),
    }
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        took[name] = round(time.perf_counter() - start, 3)
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executors
    took = {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001 - one failing query must not hide the other times
            print(f"{name}: {type(error).__name__}: {str(error)[:300]}", file=sys.stderr)
            took[name] = None
    index = index_times(spark, folder)
    discard_kept(spark)
    total = round(sum(t for t in took.values() if t is not None), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "index": index, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
