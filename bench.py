"""Times the catalog's queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs $BENCH_REPEATS times (once unless set), and its median counts.  $BENCH_LLM=1 adds the operators of gleaner.llm."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from gleaner.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()  # the session starts before the clock
    queries = dict(catalog.QUERIES)
    if os.environ.get("BENCH_LLM") == "1":
        from gleaner.llm import queries as llm_queries

        queries |= llm_queries.QUERIES
    took = {}
    for name, query in queries.items():
        each = []
        for _ in range(int(os.environ.get("BENCH_REPEATS", "1"))):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - start)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
