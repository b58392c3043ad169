"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3)
Each query is run once to warm up, then BENCH_REPEAT times; the median is reported.  Queries are
executed to completion with the no-op sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from seqpool.operators import pooling as P  # noqa: E402
from seqpool.plans import catalog as C  # noqa: E402
from seqpool.plans import params as PR  # noqa: E402
from seqpool.plans import views as V  # noqa: E402
from seqpool.session import local_session  # noqa: E402


def _swe(n_slices, n_ref, layout, project_with):
    def run(spark, sf):
        th = PR.slicers(n_slices, C.DIM)
        return P.pool_swe(V.tokens(spark, sf), th, PR.permuted_reference(n_ref, n_slices), PR.ref_weights(n_ref),
                          layout=layout, project_with=project_with)
    return run


def _many_tokens(spark, sf, copies=512):
    """Over a million tokens: every token set of the table in ``copies`` shifted versions."""
    t = V.tokens(spark, sf)
    x = t.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shifted = F.transform("vec", lambda v: v.cast("double") + F.col("c") / F.lit(float(copies)))
    return x.select((F.col("seq_id") * copies + F.col("c")).alias("seq_id"), "pos", shifted.alias("vec"))


def _swe_many(layout):
    def run(spark, sf):
        return P.pool_swe(_many_tokens(spark, sf), PR.slicers(8, C.DIM), PR.permuted_reference(16, 8), PR.ref_weights(16),
                          layout=layout, project_with="arrow")
    return run


HEADLINE = {
    "pool_swe_1m_tokens_sorted": _swe_many("sorted"),
    "pool_swe_1m_tokens_window": _swe_many("window"),
    "pool_swe_1m_tokens_numpy": _swe_many("numpy"),
    "entry_pool_swe": C.pool_swe,
    "pool_swe_L64_M100_arrays": _swe(64, 100, "arrays", "sql"),
    "pool_swe_L64_M100_window": _swe(64, 100, "window", "sql"),
    "pool_swe_L64_M100_arrow": _swe(64, 100, "numpy", "arrow"),
    "pool_swe_L128_M128_arrow": _swe(128, 128, "numpy", "arrow"),
    "pool_avg": C.pool_avg,
    "pool_max": C.pool_max,
    "pool_topk": C.pool_topk,
    "pair_feature_join": C.pair_feature_join,
    "metric_average_precision": C.metric_average_precision,
    "metric_auroc": C.metric_auroc,
    "metric_f1_max": C.metric_f1_max,
    "metric_binary_confusion": C.metric_binary_confusion,
    "metric_by_identity": C.metric_by_identity,
    "line_average_precision": C.line_average_precision,
    "score_pairs_cosine": C.score_pairs_cosine,
    "encode_distinct": C.encode_distinct,
    "masked_softmax": C.masked_softmax,
    "assign_batches": C.assign_batches,
    "hashed_fingerprint": C.hashed_fingerprint,
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    spark = local_session(cpus, shuffle_partitions=max(2, int(cpus) if cpus.isdigit() else 8), app="seqpool-bench")
    times = {}
    for name, fn in HEADLINE.items():
        if only and name not in only:
            continue

        def once():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up (discarded)
        times[name] = round(statistics.median(once() for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
