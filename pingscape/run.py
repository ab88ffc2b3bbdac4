"""Run one named analysis over a table folder and write its result.

    python -m pingscape.run poi_visits_by_day /data/tables /data/out/poi_visits
    python -m pingscape.run zone_counts_by_day /data/tables /data/out/fishnet --partition-by day
    python -m pingscape.run heat_tiles /data/tables /data/out/tiles --format parquet --partition-by z

The session comes from `spark-submit` (or a local one when run directly);
results are written by the executors through `sinks.writers`.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES
from .sinks import writers


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="pingscape.run", description=__doc__.split("\n")[0])
    ap.add_argument("analysis", choices=sorted(QUERIES))
    ap.add_argument("tables", help="folder holding the input parquet tables")
    ap.add_argument("output", help="output folder (overwritten)")
    ap.add_argument("--format", choices=["csv", "parquet"], default="csv")
    ap.add_argument("--partition-by", default=None, help="one sub-folder per value of this column (e.g. day, z)")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"pingscape-{args.analysis}").getOrCreate()
    df = QUERIES[args.analysis](spark, args.tables)
    if args.partition_by:
        writers.write_partitioned(df, args.output, args.partition_by, fmt=args.format)
    elif args.format == "csv":
        writers.write_csv(df, args.output)
    else:
        df.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
