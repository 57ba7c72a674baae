"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is fully executed with the no-op sink (no driver collect);
``value`` is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["page_catalog", "page_fields", "product_path", "robots_filter", "availability_enum",
            "price_parse", "state_upsert", "facet_scalar", "related_ring", "batch_plan", "flat_rows",
            "category_paths", "api_simple", "jsonld_products"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shelfline.plans import QUERIES, load_all
    from shelfline.session import get_session
    load_all()
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    times = {}
    for n in names:
        t0 = time.time()
        df = QUERIES[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    extra = {}
    if "page_catalog" in times:
        # pages.parquet row count comes from parquet metadata (cheap)
        n_pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet")).count()
        extra["page_catalog_pages_per_sec"] = round(n_pages / times["page_catalog"], 2)
    for q in ("api_simple", "jsonld_products"):
        if q in times:
            n_parts = spark.read.parquet(os.path.join(sf_dir, "part.parquet")).count()
            extra[f"{q}_products_per_sec"] = round(n_parts / times[q], 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": int(cpus), "shuffle_partitions": int(cpus) * 2, **extra}))


if __name__ == "__main__":
    main()
