"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from atomframe.session import local_session  # noqa: E402
from registry import QUERIES  # noqa: E402

HEADLINE = [
    "j1_interface_residues", "j5_pair_distance", "f22_boolean", "p6_conformer_state", "j6_byres",
    "h6_id_runs", "g2_cross_conformer", "g7_pharmacophore", "g5_molecules", "a2_column_entropy",
    "a11_rmsf_residues", "a12_rmsd_series", "a14_volume_stats", "g1_derive_bonds_all", "m4_contacts", "m2_delta_sasa_fine",
    "m14_coulomb_grid_fine", "m9_secondary_structure",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session("bench", cpus, partitions=max(8, cpus))
    QUERIES["f1_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(spent.values()), 3),
                "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
