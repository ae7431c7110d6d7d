"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from furrow.lineage import forget  # noqa: E402
from furrow.queries.registry import REGISTRY  # noqa: E402
from furrow.session import local_session  # noqa: E402

HEADLINE = """
image_histogram mean_histogram histogram_shift_mean histogram_shift_first histogram_shift_by_batch
aligned_mean_histogram flower_fraction drop_bad_frames fill_timestamps interpolate_metric moving_average_60
estimate_metric fraction_by_local_period modal_count_by_period best_frames systematic_sample two_level_fit
daily_report default_area_points lab_b_pixels masked_histogram spot_count frame_analysis pooled_max image_group_used
group_members kmeans_groups prune_taxa smooth_b pearson_edges spearman_edges sparse_pearson_edges
sparse_spearman_edges closeness_centrality betweenness_centrality eigenvector_centrality divergence_curve winnow_loop
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="furrow-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    seconds, failed = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        try:
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the others are still timed; the exit code tells
            failed[name] = str(error)[:300]
        else:
            seconds[name] = round(time.perf_counter() - start, 3)
    forget(spark)
    spark.stop()
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
    } | ({"failed": failed} if failed else {})))
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
