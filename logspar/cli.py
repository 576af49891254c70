"""``python -m logspar [--strict] QUERY FILE``, ``--convert JSON AGB``, ``--stream-ingest [DIR] TARGET``.

``--stream-ingest TARGET`` alone takes lines from standard input.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession

from logspar.functions.log_text import cycles_per_record, gigabytes_per_second
from logspar.operators import search
from logspar.sources import agb, files
from logspar.streaming import staging


def main(args: list[str], spark: SparkSession | None = None, lines=None) -> int:
    strict = args[:1] == ["--strict"]
    args = args[strict:]
    if len(args) < 2 or (args[0] == "--convert" and len(args) < 3):
        print(__doc__)
        return 1
    spark = spark or SparkSession.builder.appName("logspar").getOrCreate()
    if args[0] == "--convert":
        print(*(f"{k} {v}" for k, v in agb.convert(spark, args[1], args[2]).items()), sep="\n")
        return 0
    if args[0] == "--stream-ingest":
        target = args[-1].rstrip("/")
        if len(args) == 2:
            print(f"rows {staging.ingest_lines(spark, sys.stdin if lines is None else lines, target, target + '-log')}")
        else:
            staging.ingest(spark, args[1], target, target + "-checkpoint").awaitTermination()
            print(f"rows {spark.read.parquet(target).count()}")
        return 0
    if not os.path.exists(args[1]) and "://" not in args[1]:
        print(f"no such file: {args[1]}", file=sys.stderr)
        return 1
    began = time.time()
    matches = search.run_query(spark, args[0], args[1], strict=strict)
    took = time.time() - began
    print(f"TOTAL MATCHING RECORDS : {matches}")
    print(f"SECONDS                : {took:.3f}")
    print(f"GB PER SECOND          : {gigabytes_per_second(files.length(spark, args[1]), took):.3f}")
    print(f"CYCLES PER MATCH       : {cycles_per_record(took, matches):.0f}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
