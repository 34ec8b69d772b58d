"""Benchmark the headline flows and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The flows run as one season would: the events are bound once (index per
match, roles, written as a bucketed table) and every later step reads that
table. Each entry is the wall time of one complete action (results fully
computed: written to a no-op sink, collected when small, or written as files):
  bind              events -> indexed canonical rows, laid out and written once
  labels            halves, goal/defence flags, four look-ahead labels
  findings          all data-quality checks of the season
  pair_ranking      value stage on stand-in probabilities, ranked pairs
  prediction_step   4 labels x {GBT, LR}: fit, save models, score, write
  gbt_pair_ranking  value stage on the written GBT predictions, ranked pairs
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tandem.config import TABLE_ROLES as R  # noqa: E402
from tandem.operators import labels as lb  # noqa: E402
from tandem.operators import value as vl  # noqa: E402
from tandem.plans import season  # noqa: E402
from tandem.session import local_session, scratch_path  # noqa: E402


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, app="tandem-bench",
                          checkpoint_dir=tempfile.mkdtemp(prefix="tandem-bench-"))
    out_dir = scratch_path(spark, "bench")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        result = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return result

    # Warm-up (not timed): run the same code paths once on the smallest
    # tables so JVM class loading and code generation are not billed to the
    # first timed flow.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        _noop(lb.labelled(season.bound_events(spark, warm), R))
        season.standin_ranking(spark, warm).collect()
        season.table_findings(spark, warm).groupBy("check").count().collect()

    events = timed("bind", lambda: season.bound_events(spark, sf_dir))
    timed("labels", lambda: _noop(lb.labelled(events, R)))
    timed("findings", lambda: season.table_findings(spark, sf_dir, events=events)
          .groupBy("check").count().collect())
    timed("pair_ranking", lambda: vl.rank_pairs(season.pair_totals(season.standin_input(events), R)).collect())
    written = timed("prediction_step", lambda: season.prediction_step(spark, sf_dir, out_dir, events=events))
    timed("gbt_pair_ranking", lambda: vl.rank_pairs(
        season.pair_totals(spark.read.parquet(written["gbt"]), R)).collect())

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_wall_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
