"""Command line: run a whole season from nested JSON event/lineup files.

    python -m tandem DATA_ROOT OUT_DIR [--matches MATCH_LIST.json] [--kinds gbt,lr]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tandem.operators.model import TREE_ENCODINGS
from tandem.plans.season import run_json_season
from tandem.session import ENGINE_CONF


def main() -> None:
    ap = argparse.ArgumentParser(prog="tandem")
    ap.add_argument("data_root", help="folder with events/<match>.json and lineups/<match>.json")
    ap.add_argument("out_dir")
    ap.add_argument("--matches", help="match list JSON (array of objects with match_id)")
    ap.add_argument("--kinds", default="gbt,lr")
    ap.add_argument("--raw-ids", action="store_true", help="one-hot by raw id, as the original does")
    ap.add_argument("--tree-encoding", default="rates", choices=TREE_ENCODINGS)
    ap.add_argument("--strict", action="store_true", help="report every ill-formed time, not only matches with several forms")
    args = ap.parse_args()
    builder = SparkSession.builder.appName("tandem")
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    out = run_json_season(spark, args.data_root, args.out_dir, args.matches, kinds=tuple(args.kinds.split(",")),
                          index_ids=not args.raw_ids, tree_encoding=args.tree_encoding, strict=args.strict)
    print(json.dumps(out, indent=2))


if __name__ == "__main__":
    main()
