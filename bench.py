"""Time the headline queries. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from locusmill.catalog import QUERIES
from locusmill.session import clear_staged, local_session

HEADLINE = (
    "overlap_pairs",
    "enrichment_fold",
    "hypergeometric_screen",
    "shift_permutation",
    "replicate_intersection",
    "signal_sums",
    "signal_enrichment",
    "contact_tallies",
    "shift_tallies",
    "shift_test_distal",
    "within_gene_test",
    "host_classes",
    "containing_innermost",
    "read_counts",
    "bin_covariates",
    "replication_timing",
    "position_table",
    "promoter_contacts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        clear_staged(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
