"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from quillspark.plans import catalog
from quillspark.session import local_session

HEADLINE = [
    "a01_totals", "a02_message_models", "a05_median", "a08_by_day", "a11_conditional_sums", "a13_top_models", "a16_rollup_total",
    "j02_star", "j08_nest", "j10_full_outer_merge", "j20_as_of", "w01_prune", "w03_denials", "w05_latest", "e02_replay", "e04_project",
    "e12_anchored_window", "r04_bm25", "r06_vector_search", "r18_regex_lines", "t03_keyset_page", "f25_step_cost", "f35_html_text", "d01_upsert",
]
REPEATS = 5


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    times: dict[str, float] = {}
    spread: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            t = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name], spread[name] = round(statistics.median(runs), 3), round(max(runs) - min(runs), 3)
    print(json.dumps({"metric": f"total of the median of {REPEATS} runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "spread": spread}))
    spark.stop()


if __name__ == "__main__":
    main()
