"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. Each query runs once to warm up and then ``$BENCH_RUNS``
times (default 1) to a sink that discards rows; the median is reported.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolemill.plans import catalog  # noqa: E402
from rolemill.session import local_session  # noqa: E402

HEADLINE = [
    "snk_06_enrich_and_store", "nrm_01_html_to_text", "nrm_13_salary", "ext_02_skill_matches", "ext_11_contacts",
    "dup_02_simhash", "dup_09_verdict", "scr_04_job_score", "flt_06_enums",
    "flt_15_required_skills", "flt_20_custom_fields", "txt_04_boolean", "txt_05_bm25",
    "agg_02_facets", "agg_03_breakdowns", "agg_04_salary_bands", "agg_04b_price_bands",
    "agg_10_company_profile", "agg_16_count_distinct", "eav_02_typed_read",
    "srt_01_salary_desc", "ups_01_job_upsert", "snk_01_export_rows",
]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cores, name="bench", memory="16g")
    seconds = {}
    for name in only:
        times = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode(
                "overwrite").save()
            elapsed = time.perf_counter() - start
            if i:
                times.append(elapsed)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "sf": float(os.path.basename(folder.rstrip("/")).replace("sf", "") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
