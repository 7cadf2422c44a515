"""Small hand-made inputs: one business, provider, service and location unless stated."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from openchair.params import RunSpec, Settings
from openchair.plans.snapshot_job import SnapshotJob

SLOT_SCHEMA = """scenario_id string, run_id string, effective_ts timestamp_ntz, slot_id string,
  business_id string, provider_id string, service_id string, location_id string,
  standard_price double, slot_duration_minutes int, slot_start_at timestamp_ntz,
  slot_end_at timestamp_ntz, visible_at timestamp_ntz, unavailable_at timestamp_ntz,
  current_status string"""
EVENT_SCHEMA = """scenario_id string, run_id string, effective_ts timestamp_ntz, slot_id string,
  event_id string, event_type string, event_at timestamp_ntz"""


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def run_at(text: str, run_id: str = "run_1") -> RunSpec:
    return RunSpec("scn", run_id, at(text))


def slots_of(spark: SparkSession, run: RunSpec, rows: list[dict]) -> DataFrame:
    """Each row needs ``slot_id``, ``start`` and ``visible``; the rest has defaults."""
    data = []
    for row in rows:
        start = at(row["start"])
        data.append(
            (
                run.scenario_id,
                run.run_id,
                run.effective_ts,
                row["slot_id"],
                row.get("business_id", "b1"),
                row.get("provider_id", "p1"),
                row.get("service_id", "svc1"),
                "l1",
                float(row.get("price", 100.0)),
                60,
                start,
                start + timedelta(hours=1),
                at(row["visible"]),
                None,
                row.get("status", "open"),
            )
        )
    return spark.createDataFrame(data, SLOT_SCHEMA)


def events_of(spark: SparkSession, run: RunSpec, rows: list[tuple]) -> DataFrame:
    """Rows ``(slot_id, event_type, time)`` or with an event id as fourth value."""
    data = [
        (
            run.scenario_id,
            run.run_id,
            run.effective_ts,
            row[0],
            row[3] if len(row) > 3 else f"e{i:05d}",
            row[1],
            at(row[2]),
        )
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def job_of(spark, run, slots, events, settings=None, derive=False, scarcity=True) -> SnapshotJob:
    return SnapshotJob(
        slots_of(spark, run, slots),
        events_of(spark, run, events),
        [run],
        settings or Settings(),
        derive_availability=derive,
        scarcity=scarcity,
    )


def by_slot(df: DataFrame) -> dict[str, dict]:
    return {row["slot_id"]: row.asDict() for row in df.collect()}
