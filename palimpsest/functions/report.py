"""Columns for progress and outcome texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.archive import archive_timestamp, capture_time


def progress_pct(handled: Column, total: Column) -> Column:
    """Whole percent, half to even; ``'0'`` when there is nothing to do."""
    pct = F.bround(handled.cast("double") * 100 / F.nullif(total, F.lit(0)), 0).cast("int")
    return F.when(total > 0, F.concat(pct.cast("string"), F.lit("%"))).otherwise(F.lit("0"))


def progress_text(done: Column, total: Column) -> Column:
    return F.concat(F.format_number(done, 0), F.lit(" / "), F.format_number(total, 0))


def outcome_line(counter: Column, total: Column, outcome: Column, timestamp: Column, url: Column) -> Column:
    head = F.concat(counter.cast("string"), F.lit("/"), total.cast("string"))
    return F.concat_ws(" - ", head, outcome, timestamp, url)


def save_age_minutes(location: Column, request_ts: Column) -> Column:
    """Age of the capture a save request was answered with, in whole minutes."""
    taken = capture_time(archive_timestamp(location))
    seconds = F.unix_timestamp(F.date_trunc("second", request_ts)) - F.unix_timestamp(taken)
    return F.bround(seconds / 60, 0).cast("long")


def classify_save_response(status: Column, location: Column, request_ts: Column) -> Column:
    """Outcome of a save request from its logged response."""
    age = save_age_minutes(location, request_ts)
    return (
        F.when((status == 302) & (age < 1), "new")
        .when((status == 302) & (age >= 1), "existing")
        .when(status == 429, "rate_limited")
        .when(status == 520, "job_failed")
        .when(status == 404, "not_found")
        .otherwise("unhandled")
    )


def save_wait_minutes(status: Column, location: Column, request_ts: Column) -> Column:
    """Minutes until an existing capture may be renewed; 0 once an hour has passed."""
    age = save_age_minutes(location, request_ts)
    return F.when((status == 302) & (age >= 1), F.greatest(F.lit(60) - age, F.lit(0)))
