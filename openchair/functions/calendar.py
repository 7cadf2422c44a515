from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def micros_to_hours(micros: Column) -> Column:
    return micros / F.lit(1e6) / F.lit(3600)


def hours_between(start: Column, end: Column) -> Column:
    return micros_to_hours(micros_between(start, end))


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def time_bucket(ts: Column, boundaries: Sequence[int]) -> Column:
    """Label ``HH-HH`` of the half-open hour range holding ``ts``; 0 and 24 always bound the day."""
    edges = sorted({0, 24} | {h for h in boundaries if 0 <= h <= 24})
    labels = [f"{a:02d}-{b:02d}" for a, b in zip(edges, edges[1:])]
    label = F.lit(labels[-1])
    for edge, text in reversed(list(zip(edges[1:], labels[:-1]))):
        label = F.when(F.hour(ts) < edge, F.lit(text)).otherwise(label)
    return label


def lead_time_band(hours: Column) -> Column:
    """Bands closed on the right: exactly 24 hours is still the nearest band."""
    return (
        F.when(hours <= 24, "lt_24h")
        .when(hours <= 72, "24_72h")
        .when(hours <= 168, "72_168h")
        .otherwise("gt_168h")
    )


def in_trailing_days(ts: Column, as_of: Column, days: int) -> Column:
    """Both ends belong to the window."""
    return ts.between(as_of - F.expr(f"INTERVAL {int(days)} DAYS"), as_of)


def snapshot_version(effective_ts: Column) -> Column:
    return F.concat(F.lit("fsv_"), F.date_format(effective_ts, "yyyyMMdd'T'HHmmss'Z'"))
