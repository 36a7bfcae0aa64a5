"""Time the headline queries and print one JSON line.

Every result is computed whole and thrown away by the ``noop`` sink. ``BENCH_SF_DIR`` names
the data folder, ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` a comma list of query
names (``all`` for every registered one).
"""

from __future__ import annotations

import json
import os
import re
import time

from sitegrain.runtime import session
from workload.queries import QUERIES

HEADLINE = (
    "subset_country_bbox", "capped_sample", "place_roles", "hex_cells", "area_features_gym", "cell_category_counts",
    "transit_access", "point_in_region", "suburb_labels", "poa_sa2_share", "housing_weighted_mean", "opportunity_poi",
    "opportunity_full", "opportunity_templates", "rank_per_template", "custom_rank_keywords", "metro_summary",
    "top_categories_per_area", "competitor_examples", "complement_breakdown", "metrics_table", "map_points",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [n for n in asked.split(",") if n] or list(HEADLINE)
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so the first query does not pay for starting the session.
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "site_selection_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
