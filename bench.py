"""Time the headline jobs on one machine and print one JSON line.

The search tables are built and stored first (that is timed too), then the searches run
over the stored tables, as they would in production.  The given tables are first laid out in
several files each, untimed: a file of one row group is a single task whatever the machine.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from quarrylamp import build_session, testbed as tb
from quarrylamp.operators import encode, textmatch, vector
from quarrylamp.operators.postings import chunk_postings, document_postings, write_postings
from quarrylamp.plans.hybrid import document_hybrid, hybrid_search
from quarrylamp.sources.tables import shared_folder
from quarrylamp.workloads import HYBRID_THRESHOLD, PAGE_ROWS, QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Jobs that read the given tables directly.
DIRECT = [
    "token_chunks", "hash_encode", "content_hashes", "page_fields", "page_links",
    "knn_exclude_self", "vector_search_threshold", "reachable_pages", "random_documents",
    "landing_rows", "latency_percentiles", "reassemble_documents", "upsert_status",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": str(2 * int(CPUS)),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, make) -> None:
        started = time.perf_counter()
        make()
        times[name] = round(time.perf_counter() - started, 3)

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    root = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    laid = f"{root}/given"
    for file in sorted(os.listdir(SF)):
        if file.endswith(".parquet"):
            spark.read.parquet(f"{SF}/{file}").repartition(2 * int(CPUS)).write.parquet(f"{laid}/{file}")

    # Start the Python workers and the code generator before measuring.
    run(QUERIES["page_fields"](spark, laid))

    for name in DIRECT:
        timed(name, lambda name=name: run(QUERIES[name](spark, laid)))

    def build_index() -> None:
        documents = tb.documents(spark, laid).join(tb.vectors(spark, laid), "id", "left")
        documents.write.parquet(f"{root}/documents")
        tb.chunks(spark, laid).write.parquet(f"{root}/chunks")
        chunks = spark.read.parquet(f"{root}/chunks")
        write_postings(chunk_postings(chunks), f"{root}/chunk_postings")
        write_postings(document_postings(documents), f"{root}/doc_postings")

    timed("build_index", build_index)
    documents, chunks, found, described = (
        spark.read.parquet(f"{root}/{name}")
        for name in ("documents", "chunks", "chunk_postings", "doc_postings")
    )
    asked = tb.search_queries(spark, laid).withColumns(
        {"result_offset": F.lit(0), "result_limit": F.lit(PAGE_ROWS)}
    )

    timed("vector_chunk_candidates", lambda: run(
        vector.chunk_candidates(asked, chunks, 200, HYBRID_THRESHOLD)))
    timed("text_topk_documents", lambda: run(
        textmatch.top_text(textmatch.rank_cover(described, textmatch.query_literals(asked)), 200)))
    timed("document_hybrid", lambda: run(
        document_hybrid(asked, documents.filter("embedding is not null"), described,
                        HYBRID_THRESHOLD, PAGE_ROWS)))
    timed("hybrid_search", lambda: run(
        hybrid_search(asked, documents, chunks, found, described, HYBRID_THRESHOLD)))
    timed("query_encoding", lambda: run(
        encode.encode_queries(asked.drop("embedding"), encode.hash_encoder(tb.DIMENSIONS))))

    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
