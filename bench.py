"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

rebuild writes an index of all documents to disk; the searches run on it, opened anew for each; churn adds and deletes."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import SparkSession

    from lexispark.api import SearchEngine
    from lexispark.queries import DOCUMENT_SPECS
    from lexispark.sources.writer import IndexWriter

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="lexispark-bench-")
    path, took = f"{folder}/index", {}

    def timed(name: str, f, times: int = 1) -> None:
        runs = []
        for _ in range(times):
            began = time.perf_counter()
            f()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 4)

    def rebuild() -> None:
        shutil.rmtree(path, ignore_errors=True)
        with IndexWriter(spark, path) as w:
            w.add_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), DOCUMENT_SPECS)
            w.commit()

    def churn() -> None:
        with IndexWriter(spark, path) as w:
            for i in range(20):
                w.add_document([{"name": "text", "value": f"a churned document {i}", "kind": "text"}])
                w.delete_document(i)
            w.commit()

    def asked(**request):
        return lambda: SearchEngine(spark, path).search(request).collect()

    timed("rebuild", rebuild)
    for size in (20, 100):
        timed(f"search_many_top{size}", asked(text="the", limit=size), 3)
        timed(f"search_few_top{size}", asked(text="disgusting", limit=size), 3)
        timed(f"search_none_top{size}", asked(text="absenttoken", limit=size), 3)
    timed("search_filtered", asked(text="licensed", **{"in": [{"field": "lang", "values": ["en"]}]}, limit=20), 3)
    more = {"id_field": "n_chars", "id_value": "1000", "fields": ["text"], "size": 20}
    timed("more_like_this", lambda: SearchEngine(spark, path).more_like_this(more).collect(), 2)
    timed("churn", churn)

    def optimize() -> None:
        with IndexWriter(spark, path) as w:
            w.optimize()

    timed("optimize", optimize)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
