"""Headline queries on the bench tables; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandlake import get_spark  # noqa: E402
from strandlake.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = ["voxel_classes", "border_shell", "branch_components", "rung_severed", "fragment_endpoints", "endpoint_pairs", "bridge_costs",
            "chain_table", "diffuse_flood", "panoptic_metrics", "consensus_matches", "arc_length", "resample_unit", "crossing_dip", "overlap_add",
            "intensity_scores", "gad_points"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["voxel_classes"](spark, folder).count()   # start-up is not part of the numbers
    names = sys.argv[1:] or HEADLINE
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
