"""Cohort baselines over (day name, time bucket, service).

Every group measure is first summed per cell, the finest combination any later grouping
uses. All cohort, provider, business and pattern statistics are then sums over the cell
table, which is far smaller than the slots. Counts and durations are exact integers, so a
recomputed task after a lost executor gives bit-for-bit the same rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.functions import calendar, numbers
from openchair.params import RUN_KEY, Settings
from openchair.schemas import COHORT_BASELINE_COLUMNS, TRAILING_DAYS

COHORT_KEY = ("day_of_week", "time_of_day_bucket", "service_type")
CELL_KEY = (*RUN_KEY, "business_id", "provider_id", *COHORT_KEY)

PATTERN_EVENTS = {"cancel": "canceled", "no_show": "no_show", "reschedule": "rescheduled"}


def slot_cells(base: DataFrame) -> DataFrame:
    """Sums per (business, provider, day, bucket, service) of a run.

    Durations are added as wide integers: no rounding, and no overflow over any number of slots.
    """
    measures = [
        "count(*) AS n_slots",
        "sum(booked_flag) AS n_booked",
        "sum(completed_flag) AS n_completed",
        "sum(CAST(lead_time_micros AS DECIMAL(18, 0))) AS lead_micros",
        "sum(CAST(active_micros AS DECIMAL(18, 0))) AS active_micros",
        "sum(observed_booking_pace_per_day) AS pace_total",
        "count_if(slot_start_at >= effective_ts) AS n_future",
    ]
    for name, event_type in PATTERN_EVENTS.items():
        measures.append(f"count_if(first_event_type = '{event_type}') AS n_first_{name}")
    for days in TRAILING_DAYS:
        inside = f"BETWEEN effective_ts - INTERVAL {days} DAYS AND effective_ts"
        measures += [
            f"count_if(slot_start_at {inside}) AS n_started_{days}d",
            f"sum(IF(slot_start_at {inside}, booked_or_completed, 0)) AS n_kept_{days}d",
            f"count_if(first_booked_at {inside}) AS n_fresh_{days}d",
        ]
    # The version is one per run; as a key, not a maximum of text, it allows hash aggregation.
    return base.groupBy(*CELL_KEY, "feature_snapshot_version").agg(*[F.expr(m) for m in measures])


def cohort_baselines(cells: DataFrame, settings: Settings) -> DataFrame:
    """Fill, pace, lead time and completion of each cohort; a null service is its own cohort."""
    totals = cells.groupBy(*RUN_KEY, *COHORT_KEY, "feature_snapshot_version").agg(
        F.sum("n_slots").alias("observation_count"),
        F.sum("n_booked").alias("n_booked"),
        F.sum("n_completed").alias("n_completed"),
        F.sum("lead_micros").cast("double").alias("lead_micros"),
        F.sum("active_micros").cast("double").alias("active_micros"),
    )
    n = F.col("observation_count")
    active_days = calendar.micros_to_hours(F.col("active_micros")) / F.lit(24.0)
    labels = [F.coalesce(F.col(c), F.lit("None")) for c in COHORT_KEY]
    return totals.withColumns(
        {
            "fill_rate": F.col("n_booked") / n,
            "completion_rate": F.col("n_completed") / n,
            "avg_lead_time_hours": calendar.micros_to_hours(F.col("lead_micros")) / n,
            "expected_booking_pace_per_day": numbers.safe_rate(F.col("n_booked"), active_days),
            "is_sparse": n < settings.min_cohort_observations,
            "cohort_id": F.concat_ws("|", *labels),
        }
    ).select(*COHORT_BASELINE_COLUMNS)
