"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default 8)
--compare      also time the scan as one query per rule and column
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.binding import col
from plumbline.config import SCANNED, open_workspace
from plumbline.plans.registry import QUERIES
from plumbline.plans.scan import scan
from plumbline.session import get_session

HEADLINE = (
    "scan_issues", "health_score", "before_after", "remediation_log",
    "rule_null_check", "rule_duplicate_key", "rule_orphan_reference", "rule_date_ordering", "rule_duplicate_row",
    "rule_case_consistency", "rule_outlier_iqr", "rows_at_risk_distinct", "violations_orphans",
    "profile_columns", "profile_numeric", "profile_text", "profile_top_values", "table_row_counts",
    "fix_whitespace", "fix_date_swap", "fix_amount", "fix_dedup", "inject_defects_orders", "gen_orders",
    "health_by_month", "history_trend", "trust_change", "contracts_eval",
    "stream_rule_counts", "stream_dedup", "stream_orphans", "stream_health",
)
RUNS = 3


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(build) -> float:
    """Seconds from building the query to its last row; the best of three runs."""
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        run(build())
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def one_query_per_rule(spark, directory: str) -> None:
    """The same counters, each by a query of its own, one after another."""
    ws = open_workspace(spark, directory)
    for name in SCANNED:
        table = ws.tables[name]
        table.count()
        for bound in ws.bound([name]):
            if bound.predicate is not None:
                table.where(bound.predicate(col)).count()
        keyed = {b.rule.name for b in ws.bound([name]) if b.predicate is None}
        for rule in sorted(keyed):
            scan(ws, [name], {rule}).counts.collect()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")}
    spark = get_session("plumbline-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["table_row_counts"](spark, directory))
    seconds = {name: timed(lambda name=name: QUERIES[name](spark, directory)) for name in HEADLINE}
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
    }
    if "--compare" in sys.argv:
        start = time.perf_counter()
        one_query_per_rule(spark, directory)
        result["one_query_per_rule"] = round(time.perf_counter() - start, 3)
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
