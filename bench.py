"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Search and answers run on an index that was written before, as in use; building
and syncing it are measured on their own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from lectern.operators import answers, dialog, index, search
from lectern.operators.chunks import chunk_documents
from lectern.plans import answering, catalog, ingest
from lectern.plans.catalog import QUERIES
from lectern.session import clear_work, local_session, materialise, work_path

FROM_TABLES = [
    "documents_from_pages",
    "toc_urls",
    "frontier_distinct",
    "snapshot_diff",
    "chunk_documents",
    "chunk_pages",
    "chunk_function",
    "embed_documents",
    "build_index",
    "sync_stream",
    "topk_vector",
    "topk_lsh",
    "search_query",
    "gate_prompt",
]


def on_index(spark, folder):
    """Queries over tables that exist before: name -> function giving a DataFrame."""
    built = ingest.index_documents(spark, catalog._documents(spark, folder), work_path(spark, "index"))
    then = materialise(index.build_index(chunk_documents(catalog._reviewed_then(spark, folder))), "then")
    now = materialise(chunk_documents(catalog._reviewed_now(spark, folder)), "now")
    asked, turns = catalog._questions(spark, folder), catalog._turns(spark, folder)

    def answer_prompt():
        found = answering.retrieved_dialogs(
            materialise(answering.judged_dialogs(turns, built, catalog.GATE), "judged"), built
        )
        context = answers.format_context(F.col("docs")).alias("context")
        return dialog.prompts(turns, "answer", extra=found.select("conv_id", context))

    return {
        "sync_index": lambda: index.sync_index(then, now),
        "topk_text": lambda: search.topk_text(asked, built),
        "retrieve": lambda: search.retrieve(asked, built),
        "judged_dialogs": lambda: answering.judged_dialogs(turns, built, catalog.GATE),
        "answer_prompt": answer_prompt,
        "answer_all": lambda: answering.answer_all(turns, built, threshold=catalog.GATE),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "12g"), shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: lambda q=QUERIES[name]: q(spark, folder) for name in FROM_TABLES}
    queries |= on_index(spark, folder)
    names = sys.argv[1:] or list(queries)

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name]().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    clear_work(spark)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()
