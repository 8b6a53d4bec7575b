"""Times the headline steps and queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from crateline.operators import corpus as C
from crateline.operators import derive as D
from crateline.operators import serve as V
from crateline.plans import steps
from driver_binding.catalogue import Bound

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def work(b: Bound) -> dict[str, Callable[[], object]]:
    dials = b.dials
    people = lambda: b.derived["release_people"]
    cap = dials.max_people_per_release
    return {
        # The steps write their tables, as a rebuild does.
        "catalogue": lambda: b.cat,
        "seed": lambda: b.seed,
        "expand": lambda: b.corpus,
        "entities": lambda: b.entities,
        "derive": lambda: b.derived,
        "serving_tables": lambda: b.served,
        # Single operators over those tables.
        "label_artist_pairs": lambda: run(C.label_artist_pairs(b.cat, dials)),
        "pair_counts": lambda: run(D.pair_counts(people(), cap)),
        "artist_collaborators": lambda: run(
            D.artist_collaborators(people(), cap, once=b.derived["people_once"])
        ),
        "artist_labels": lambda: run(
            D.artist_labels(b.derived["people_once"], b.corpus["release_labels"], b.corpus["releases"])
        ),
        "artist_coverage": lambda: run(
            steps.measured_coverage(
                b.corpus,
                b.derived["people_once"],
                b.derived["artist_collaborators"],
                b.derived["artist_labels"],
                b.derived["coverage_counts"],
                dials,
            )
        ),
        "top_collaborators": lambda: run(V.top_collaborators(b.tables)),
        "top_roster": lambda: run(V.top_roster(b.tables)),
        "artist_releases": lambda: run(V.artist_releases(b.served)),
        "label_releases": lambda: run(V.label_releases(b.served)),
        "top_lists": lambda: steps.top_lists(b.tables, dials.scene, b.stage),
        "search": lambda: run(V.search(b.served, "red wi")),
    }


def main() -> None:
    spark = session()
    # The same plans over the smallest tables first, so compilation is not what is timed.
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for step in work(Bound(spark, small)).values():
            step()
    times = {}
    for name, step in work(Bound(spark, SF_DIR)).items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "orders": spark.read.parquet(f"{SF_DIR}/orders.parquet").count(),
            }
        )
    )


if __name__ == "__main__":
    main()
