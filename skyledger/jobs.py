"""Jobs for spark-submit: ``python -m skyledger.jobs flights|weather|split ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from skyledger.operators import sampling
from skyledger.operators.weather import build_hourly, null_rates
from skyledger.sources import flights, lookups


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skyledger.jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    f = jobs.add_parser("flights", help="monthly CSV or ZIP files to Parquet by month")
    f.add_argument("--raw", nargs="+", required=True)
    f.add_argument("--out", required=True)
    f.add_argument("--force", action="store_true", help="replace months that exist")
    f.add_argument("--sample", help="also write a stratified sample here")
    f.add_argument("--sample-rows", type=int, default=50_000)
    w = jobs.add_parser("weather", help="observations by airport to the hourly table")
    w.add_argument("--raw", nargs="+", required=True)
    w.add_argument("--out", required=True)
    w.add_argument("--first", default="2024-01-01 00:00:00")
    w.add_argument("--last", default="2026-05-31 23:00:00")
    s = jobs.add_parser("split", help="rows of a split with the target")
    s.add_argument("--months", required=True)
    s.add_argument("--split", choices=sorted(flights.SPLITS), required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--model-only", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"skyledger {args.job}").getOrCreate()
    if args.job == "flights":
        # ZIP files go first: a month that both kinds hold is theirs, and with --force that of the plain files
        zips, plain = [p for p in args.raw if p.endswith(".zip")], [p for p in args.raw if not p.endswith(".zip")]
        for rows in [flights.read_zips(spark, *zips)] * bool(zips) + [flights.read_csv(spark, *plain)] * bool(plain):
            flights.write_months(flights.typed(rows), args.out, overwrite=args.force)
        if args.sample:
            keys = ["FlightDate", "Flight_Number_Reporting_Airline", "Origin", "Dest", "CRSDepTime"]
            sampling.stratified(spark.read.parquet(args.out), ["Month", "Reporting_Airline"], keys, args.sample_rows).write.mode("overwrite").parquet(args.sample)
    elif args.job == "weather":
        build_hourly(lookups.read_metar(spark, *args.raw), args.first, args.last).write.mode("overwrite").option("compression", "snappy").parquet(args.out)
        null_rates(spark.read.parquet(args.out)).show(truncate=False)
    else:
        flights.load_split(spark, args.months, args.split, model_only=args.model_only).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
