"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the
data and the cores. Every result is computed in full and discarded. One untimed
run of the largest plan comes first, so that compiling is not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans import scoring, views
from ledgerlens.plans.catalog import REGISTRY
from ledgerlens.session import build_session

HEADLINES = [
    "rolling_features", "rules_without_graph", "rules_with_graph", "live_graph_vector", "cycle_closure", "account_profiles",
    "pagerank", "betweenness", "clustering", "cycle_counts", "communities", "two_hop_capped", "knn",
    "edge_features", "group_risk", "eval_frame", "threshold_sweep", "roc_auc", "average_precision", "latency_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["rules_with_graph"].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        t0 = time.perf_counter()
        REGISTRY[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    chain = {}
    if not sys.argv[1:]:
        txn = views.txn(spark, sf_dir)
        t0 = time.perf_counter()
        artefacts = scoring.fit_artefacts(txn)
        chain["fit_artefacts"] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        scoring.score_transactions(txn, artefacts).write.format("noop").mode("overwrite").save()
        chain["score_transactions"] = round(time.perf_counter() - t0, 3)
        for name, s in chain.items():
            print(f"{name}: {s}", file=sys.stderr, flush=True)
        seconds |= chain
    out = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
           "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus)}
    if seconds.get("rolling_features"):
        out["rolling_rows_per_sec"] = round(rows / seconds["rolling_features"])
    if chain:
        out["score_ms_per_transaction"] = round(1000 * chain["score_transactions"] / rows, 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
