"""What is known about each slot at the snapshot time of its run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.functions import calendar, numbers
from openchair.functions.calendar import instant
from openchair.operators.availability import derive_availability, join_history
from openchair.operators.history import event_history
from openchair.operators.joins import FANOUT
from openchair.params import SLOT_KEY, RunSpec, Settings

HOUR_MICROS = 3_600_000_000


def assign_runs(df: DataFrame, runs: Sequence[RunSpec]) -> DataFrame:
    """Every row once per run. The runs are a short list of the caller, no table.

    The run columns come out of an explode, also for a single run. As plain literals they
    would be folded out of some join and grouping keys but not out of others, and a table
    grouped by run and slot would be shuffled again before its join by slot. Rows of a feed
    are given their runs as late as possible, after everything that is the same for all runs.
    """
    described = [
        F.struct(
            F.lit(r.scenario_id).alias("scenario_id"),
            F.lit(r.run_id).alias("run_id"),
            instant(str(r.effective_ts)).alias("effective_ts"),
        )
        for r in runs
    ]
    return df.select("*", F.explode(F.array(*described)).alias("_run")).select(
        *df.columns, "_run.*"
    )


def visible_slots(slots: DataFrame) -> DataFrame:
    """Slots published by the snapshot, future starts included."""
    return slots.where(F.col("visible_at") <= F.col("effective_ts"))


def events_asof(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_at") <= F.col("effective_ts"))


def first_booking(events: DataFrame) -> DataFrame:
    booked = events_asof(events).where(F.col("event_type") == "booked")
    return booked.groupBy(*SLOT_KEY).agg(F.min("event_at").alias("first_booked_at"))


def first_event(events: DataFrame) -> DataFrame:
    """Type of the earliest event per slot; at equal times the lowest event id decides."""
    return event_history(events_asof(events)).select(
        *SLOT_KEY, "first_event_type", "first_event_at"
    )


def slot_event_rollup(events: DataFrame) -> DataFrame:
    """Per slot: whether and when it was booked and whether it was completed by the snapshot."""

    def seen(event_type: str):
        return F.max(F.col("event_type") == event_type)

    return (
        events_asof(events)
        .groupBy(*SLOT_KEY)
        .agg(
            F.count("*").alias("event_count"),
            F.min(F.when(F.col("event_type") == "booked", F.col("event_at"))).alias(
                "first_booked_at"
            ),
            seen("booked").alias("was_booked"),
            seen("completed").alias("was_completed"),
        )
    )


def trailing_window(slots: DataFrame, days: int) -> DataFrame:
    """Slots whose start lies in the window of ``days`` days ending at the snapshot."""
    inside = calendar.in_trailing_days(F.col("slot_start_at"), F.col("effective_ts"), days)
    return slots.where(inside)


def add_cohort_key(slots: DataFrame, settings: Settings) -> DataFrame:
    start = F.col("slot_start_at")
    return slots.withColumns(
        {
            "day_of_week": calendar.day_name(start),
            "time_of_day_bucket": calendar.time_bucket(start, settings.bucket_boundaries),
            "service_type": F.col("service_id"),
        }
    )


def add_calendar(slots: DataFrame, settings: Settings) -> DataFrame:
    hours = calendar.hours_between(F.col("effective_ts"), F.col("slot_start_at"))
    return add_cohort_key(slots, settings).withColumn("hours_until_slot", hours).withColumns(
        {
            "days_until_slot": F.col("hours_until_slot") / F.lit(24),
            "effective_lead_time_band": calendar.lead_time_band(F.col("hours_until_slot")),
        }
    )


def add_event_flags(slots: DataFrame) -> DataFrame:
    """As-of flags from history columns.

    The first time of a type up to the snapshot is its overall first time when that is
    not later than the snapshot, so later events never leak in. Intervals are not negative,
    and an empty one counts as an hour.
    """
    replaced = ("first_event_type", "first_booked_at", "first_completed_at")
    known = slots.selectExpr(
        *[c for c in slots.columns if c not in replaced],
        "IF(first_event_at <= effective_ts, first_event_type, NULL) AS first_event_type",
        "IF(first_booked_at <= effective_ts, first_booked_at, NULL) AS first_booked_at",
        "IF(first_completed_at <= effective_ts, first_completed_at, NULL) AS first_completed_at",
    )
    closed = "least(coalesce(unavailable_at, slot_start_at), effective_ts)"

    def span(start: str, end: str) -> str:
        return f"timestampdiff(MICROSECOND, {start}, {end})"

    def floored(micros: str) -> str:
        return f"IF({micros} <= 0, {HOUR_MICROS}L, {micros})"

    measured = known.selectExpr(
        "*",
        "CAST(first_booked_at IS NOT NULL AS INT) AS booked_flag",
        "CAST(first_completed_at IS NOT NULL AS INT) AS completed_flag",
        "CAST(first_booked_at IS NOT NULL OR first_completed_at IS NOT NULL AS INT)"
        " AS booked_or_completed",
        f"coalesce({span('first_booked_at', 'slot_start_at')}, 0L) AS lead_time_micros",
        f"{floored(span('visible_at', closed))} AS active_micros",
        f"{floored(span('visible_at', 'effective_ts'))} AS elapsed_micros",
    )
    elapsed_days = calendar.micros_to_hours(F.col("elapsed_micros")) / F.lit(24.0)
    return measured.withColumns(
        {
            "lead_time_hours": calendar.micros_to_hours(F.col("lead_time_micros")),
            "active_days": calendar.micros_to_hours(F.col("active_micros")) / F.lit(24.0),
            "observed_booking_pace_per_day": numbers.safe_rate(
                F.col("booked_flag").cast("double"), elapsed_days
            ),
        }
    )


BASE_COLUMNS = (
    *SLOT_KEY,
    "feature_snapshot_version",
    "effective_ts",
    "business_id",
    "provider_id",
    "service_id",
    "service_type",
    "standard_price",
    "slot_duration_minutes",
    "slot_start_at",
    "visible_at",
    "unavailable_at",
    "current_status",
    "day_of_week",
    "time_of_day_bucket",
    "hours_until_slot",
    "days_until_slot",
    "effective_lead_time_band",
    "first_event_type",
    "first_booked_at",
    "booked_flag",
    "completed_flag",
    "booked_or_completed",
    "lead_time_micros",
    "lead_time_hours",
    "active_micros",
    "active_days",
    "observed_booking_pace_per_day",
)


def is_feed(slots: DataFrame) -> bool:
    """Whether the rows are given once for all runs."""
    return "effective_ts" not in slots.columns


def known_at_runs(
    slots: DataFrame, events: DataFrame, runs: Sequence[RunSpec], fanout: int = FANOUT
) -> DataFrame:
    """Visible slots of every run with their event history.

    A feed is aggregated and joined once, without slots that no run sees yet; only the joined
    rows are multiplied by the runs, so events and slots are shuffled once for all snapshots.
    """
    if not is_feed(slots):
        return join_history(visible_slots(slots), events, fanout)
    latest = instant(str(max(run.effective_ts for run in runs)))
    joined = join_history(slots.where(F.col("visible_at") <= latest), events, fanout)
    return visible_slots(assign_runs(joined, runs))


def snapshot_base(
    slots: DataFrame,
    events: DataFrame,
    settings: Settings,
    derive: bool = True,
    runs: Sequence[RunSpec] = (),
    joined: DataFrame | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per visible slot with calendar, availability and as-of event columns.

    Pass ``derive=False`` for slots whose availability columns are already stored, and the runs
    with a feed, whose rows have none. ``joined`` takes the slots of every run with their history
    where a caller has them already.
    """
    known = known_at_runs(slots, events, runs, fanout) if joined is None else visible_slots(joined)
    if derive:
        known = derive_availability(known)
    known = known.withColumn(
        "feature_snapshot_version", calendar.snapshot_version(F.col("effective_ts"))
    )
    return add_event_flags(add_calendar(known, settings)).select(*BASE_COLUMNS)

