"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Building the mart
from the star schema is timed as a query of its own. Each query then runs once
cold and BENCH_RUNS times warm; the figure reported is the best warm run.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tendero.plans.registry import QUERIES
from tendero.session import session
from tendero.sources.star import star_mart

HEADLINE = (
    "top_sellers", "sales_by_branch", "family_margin_leaders", "month_kpis", "monthly_profit",
    "sale_vs_purchase_all", "high_sales_low_margin", "top_sellers_with_cost",
    "bestsellers_at_risk", "critical_with_sales", "budget_by_supplier", "alert_kpis",
    "trend_summary", "urgency_index", "tag_conversations", "tag_document_brands", "route_counts",
)


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__adaptive__coalescePartitions__initialPartitionNum=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()  # start of the JVM is not part of any query
    start = time.perf_counter()
    star_mart(spark, folder)
    best = {"build_mart": time.perf_counter() - start}
    cold = {}
    for name in HEADLINE:
        cold[name] = run(spark, name, folder)
        best[name] = min((run(spark, name, folder) for _ in range(runs)), default=cold[name])
    print(json.dumps({
        "metric": "headline queries, warm, with the mart build",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": {name: round(sec, 3) for name, sec in best.items()},
        "cold": {name: round(sec, 3) for name, sec in cold.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
