"""Run a capture job from the shell: ``spark-submit ... palimpsest/__main__.py --last LISTING ROOT``."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from palimpsest.operators.versions import MODES
from palimpsest.plans.job import CaptureJob


def _listed(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split(",") if part.strip())


def parse(args: list[str] | None = None) -> argparse.Namespace:
    cli = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    cli.add_argument("listing", help="file or folder of capture listings")
    cli.add_argument("root", help="shared folder for stage tables and results")
    mode = cli.add_mutually_exclusive_group(required=True)
    for name in MODES:
        mode.add_argument(f"--{name}", dest="mode", action="store_const", const=name)
    cli.add_argument("--url", help="only this address and what lies below it")
    cli.add_argument("--explicit", action="store_true", help="only the address itself")
    cli.add_argument("--years", type=int, help="only captures since so many years ago")
    cli.add_argument("--start", help="first timestamp, any prefix")
    cli.add_argument("--end", help="last timestamp, any prefix")
    cli.add_argument("--limit", type=int, help="only the first lines")
    cli.add_argument("--filetype", type=_listed, default=(), help="file endings, comma separated")
    cli.add_argument("--statuscode", type=_listed, default=(), help="status codes, comma separated")
    cli.add_argument("--keep-www", action="store_true", help="tell www hosts apart")
    cli.add_argument("--no-redirect", action="store_true", help="do not follow redirects")
    cli.add_argument("--skip-first", action="store_true", help="set 301 and 404 aside before choosing versions")
    cli.add_argument("--embedded", choices=("cut", "keep"), default="cut", help="what to do with addresses inside addresses")
    cli.add_argument("--as-of", type=date.fromisoformat, help="day that --years counts back from")
    cli.add_argument("--payloads", help="table name of payloads")
    cli.add_argument("--results", help="result file of an earlier run")
    return cli.parse_args(args)


def job_of(opts: argparse.Namespace) -> CaptureJob:
    return CaptureJob(
        url=opts.url,
        mode=opts.mode,
        explicit=opts.explicit,
        range_years=opts.years,
        start=opts.start,
        end=opts.end,
        limit=opts.limit,
        filetype=opts.filetype,
        statuscode=opts.statuscode,
        merge_www=not opts.keep_www,
        redirects=not opts.no_redirect,
        skip_first=opts.skip_first,
        embedded=opts.embedded,
        as_of=opts.as_of,
    )


def main(args: list[str] | None = None) -> None:
    opts = parse(args)
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    payloads = spark.table(opts.payloads) if opts.payloads else None
    job = job_of(opts)
    tables = job.run(spark, opts.listing, opts.root, payloads, opts.results)
    tables.funnel().show(truncate=False)
    tables.status().show(truncate=False)
    tables.summary().show(truncate=False)


if __name__ == "__main__":
    main()
