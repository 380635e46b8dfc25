"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the threads. Each time
includes the whole result being produced; the JVM and the kernels' first use are warmed up before.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trajectra.plans import catalog
from trajectra.sources import fixtures as fx
from trajectra.sources.session import local_session

QUERIES = (
    "seq_complexity", "seq_turbulence", "seq_integration", "seq_degradation", "xs_entropy", "xs_mean_time", "transition_rates", "subcost_rate_by_time", "prefix_rarity", "first_divergence",
    "dist_om", "dist_om_rates", "dist_lcs", "dist_lcp", "dist_ham", "dist_euclid", "dist_chi2", "dist_omspell", "dist_twed", "dist_omloc", "association", "partition_quality", "clara", "frequent_subsequences",
    "subsequence_counts", "moving_windows", "spell_survival", "distances_summed", "distance_by_structure", "weighted_moments", "gap_decomposition", "hmm_fit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), cpus)
    for name in ("seq_complexity", "dist_ham"):
        catalog.QUERIES[name](spark, os.path.join(os.path.dirname(sf_dir), "sf0.001") if os.path.isdir(os.path.join(os.path.dirname(sf_dir), "sf0.001")) else sf_dir).count()
    times: dict[str, float] = {}
    for name in QUERIES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    shapes = {}
    for source in (fx.ev_all, fx.ev_daily, fx.ord_seq, fx.ord_status):
        row = source(spark, sf_dir).arrays.selectExpr("count(*) AS n", "count(DISTINCT seq) AS u", "max(size(seq)) AS l").first()
        shapes[source.__name__] = {"n": row.n, "unique": row.u, "longest": row.l}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "shapes": shapes}))


if __name__ == "__main__":
    main()
