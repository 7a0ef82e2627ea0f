"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's DataFrame is fully evaluated with the ``noop`` sink (no collect).
``one_session_all_models`` is the published workload's shape — random forest,
perceptron and naive Bayes trained and evaluated on one large session — run
on every sf packet as a single session.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from sigclass.plans import queries as q
    from sigclass.plans import queries_rows as qr
    from sigclass.plans import jobs
    from sigclass.session import get_session
    from sigclass.sources import fixtures as fx

    spark = get_session(f"local[{cpus}]", app="sigclass-bench", shuffle_partitions=2 * cpus,
                        extra={"spark.driver.memory": "16g"})
    # warm-up (not timed): JVM JIT, class loading and Python workers, on the smallest tables;
    # every timed query below builds its own plan and intermediate tables from scratch
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    q.metrics_report(spark, warm if os.path.isdir(warm) else sf).write.format("noop").mode("overwrite").save()

    def one_session(spark, sf):
        cal, pk = fx.single_session(spark, sf)
        run = jobs.train_pending(spark, cal, pk)
        return run.metrics_report()

    headline = {
        "nb_all_sessions_report": q.metrics_report,
        "channel_index_fit": q.channel_index_fit,
        "nb_train": q.nb_train,
        "class_metrics": q.class_metrics,
        "reclassify_pending": q.reclassify_pending,
        "stream_calibration_ingest": qr.stream_calibration_ingest,
        "one_session_all_models": one_session,
    }
    only = [a for a in sys.argv[1:]]
    times = {}
    for name, fn in headline.items():
        if only and name not in only:
            continue
        t = time.time()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
           "cpus": cpus}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
