"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full through the ``noop`` sink (every row computed,
nothing collected) and timed; one JSON line is printed at the end.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfcast.plans import catalog, prepare  # noqa: E402
from shelfcast.plans import train as T  # noqa: E402
from shelfcast.session import build_session, checkpoint_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# model settings for the bench (larger than the registered queries' settings)
BENCH_TREES = {"max_iter": 20, "max_depth": 6, "min_instances": 250, "step_size": 0.1, "patience": 10}
BENCH_MLP = {"epochs": 2, "layers": (256, 128), "dropout": 0.2, "batch_size": 1024, "patience": 5}


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(f"local[{CPUS}]", app="shelfcast-bench", shuffle_partitions=int(CPUS) * 2)
    checkpoint_dir(spark)
    q = catalog.queries()
    times = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    # data preparation and reports (registered queries, whole tables)
    timed("prepare_dataset", lambda: catalog._ds(spark, SF_DIR))           # sample + key counts
    timed("zero_fill", lambda: run_noop(q["zero_fill"](spark, SF_DIR)))     # grid + left join + fill
    timed("train_set", lambda: run_noop(q["date_features"](spark, SF_DIR)))  # + dims + calendar
    timed("item_stats_dense", lambda: run_noop(q["item_stats"](spark, SF_DIR)))
    timed("item_stats_sparse", lambda: run_noop(q["item_stats_sparse"](spark, SF_DIR)))
    timed("split_counts", lambda: run_noop(q["segment_day"](spark, SF_DIR)))
    timed("charts", lambda: [run_noop(q[n](spark, SF_DIR))
                             for n in ("sales_by_family", "month_by_family", "dow_by_family", "month_family_pivot")])
    timed("normalise_encode", lambda: run_noop(q["feature_frame"](spark, SF_DIR)))
    timed("baseline_metrics", lambda: run_noop(q["metrics_rollup"](spark, SF_DIR)))
    timed("cv_summary", lambda: run_noop(q["cv_summary"](spark, SF_DIR)))

    # models
    ds = catalog._ds(spark, SF_DIR)
    tf = catalog._frames(spark, SF_DIR, "tree")
    timed("gbt_fit_score", lambda: run_noop(T.trees(tf, "bench_gbt", **BENCH_TREES).scored))
    mf = catalog._frames(spark, SF_DIR, "mlp")
    timed("mlp_fit_score", lambda: run_noop(T.mlp_run(mf, "bench_mlp", **BENCH_MLP).scored))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "grid_rows": ds.counts["date"] * ds.counts["store_nbr"] * ds.counts["item_nbr"],
                      "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
