"""Headline queries at one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion into the no-op sink, so all rows and columns are
computed.  A few queries first run untimed on the smallest tables next to the
given ones, so the times are those of a warm JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetaudit.queries import QUERIES  # noqa: E402
from fleetaudit.session import build_session  # noqa: E402

HEADLINE = [
    "sco_7", "sco_8", "set_5", "agg_1", "w_6",
    "all_text_rules", "sec_004", "net_001", "net_007", "net_008", "sto_002", "cry_005",
    "man_001", "man_009", "man_010", "prm_1", "agg_3", "sdk_001", "sdk_002",
    "j_8", "ord_1", "agg_8", "agg_9", "agg_6", "j_12", "agg_11", "adm_3", "adm_5", "src_4", "fn_14",
    "audit",
]


WARM_UP = ["fn_17", "sco_7", "all_text_rules", "agg_11"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in WARM_UP:
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if only:
            print(name, times[name], file=sys.stderr)
    extra: dict[str, float] = {}
    if "all_text_rules" in times:
        texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
            "count(*) AS n", "sum(octet_length(text)) / 1e6 AS mb").first()
        extra = {"targets_per_sec": round(texts["n"] / times["all_text_rules"], 1),
                 "text_mb_per_sec": round(texts["mb"] / times["all_text_rules"], 2)}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **extra,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
