"""Times the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewarden.plans.registry import QUERIES
from tablewarden.session import local_session, shared_dir

HEADLINE = """dq_suite dq_unique dq_quarantine dq_reconciles fn_redact_pii part_mapped_rollup_window7 part_ready part_infer_mapping
lin_ancestors lin_topo_levels lin_impact agg_customer_order_summary agg_job_progress agg_histogram_quantile agg_quantiles
win_ewma win_backlog_rank win_rolling_rate join_backfill_overlap obs_burn_rate obs_rate_limit_audit str_tumbling""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="12g")
    shared_dir(spark)
    QUERIES["agg_count_by_tenant"](spark, folder).write.format("noop").mode("overwrite").save()  # starts executors and the code cache
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
