"""Wall-clock of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each is the median of three warm runs into the noop sink.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tidewater.plans import aml, registry
from tidewater.sources import fixture

HEADLINES = ["q1_low_amount", "q2_max_per_bank", "q3_below_avg_fraction", "q4_scatter_gather_accounts", "q5_count_converted"]
EXTRA = ["q4_pair_middles", "agg_argmax_by_bank", "agg_avg_by_format", "multi_client_q4", "multi_client_q5", "limit_top_transfers", "csv_transfers", "routed_q1_q3_q5", "verify_fingerprint"]
STREAMS = ["stream_dedup_messages", "stream_dedup_within", "stream_q4_scatterers"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()

    def timed(run, rounds: int = 4) -> float:
        runs = []
        for _ in range(rounds):
            began = time.perf_counter()
            run()
            runs.append(time.perf_counter() - began)
        return round(statistics.median(runs[1:]), 3)

    def all_shared() -> None:
        got = aml.run_all(fixture.transfers(spark, sf_dir), fixture.banks(spark, sf_dir), fixture.fx_rates(spark))
        for q in ("q1", "q2", "q3", "q4", "q5"):
            noop(got[q])
        got["usd"].unpersist()

    times = {name: timed(lambda n=name: noop(registry.QUERIES[n](spark, sf_dir))) for name in HEADLINES + EXTRA}
    times["q1_to_q5_one_persisted_scan"] = timed(all_shared)
    times["q4_without_reduction"] = timed(lambda: noop(aml.q4(registry.usd(spark, sf_dir), reduce=False)))
    times |= {name: timed(lambda n=name: noop(registry.QUERIES[n](spark, sf_dir)), 2) for name in STREAMS}
    total = round(sum(times[n] for n in HEADLINES), 3)
    sys.stdout.write(json.dumps({"metric": "q1_to_q5_warm_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
