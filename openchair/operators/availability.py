from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openchair.operators.history import event_history
from openchair.operators.joins import FANOUT
from openchair.params import slot_key
from openchair.schemas import TERMINAL_EVENT_TYPES


def join_history(slots: DataFrame, events: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Slots with their event history. Both sides are unique per slot, so no key is hot."""
    return slots.join(event_history(events, fanout), list(slot_key(events.columns)), "left")


def unavailable_at() -> Column:
    """When a slot stops being bookable: its first end, standing booking or start. No snapshot time enters."""
    ends = [F.col(f"first_{t}_at") for t in TERMINAL_EVENT_TYPES]
    return F.least(*ends, F.col("effective_booking_at"), F.col("slot_start_at"))


def derive_availability(slots: DataFrame) -> DataFrame:
    """``unavailable_at`` and ``current_status`` from the history columns of ``join_history``."""
    start, snapshot = F.col("slot_start_at"), F.col("effective_ts")
    latest = F.col("latest_event_type")
    status = (
        F.when((latest == "canceled") & (start > snapshot), "open")
        .when(latest.isNotNull(), latest)
        .when(start <= snapshot, "expired")
        .otherwise("open")
    )
    return slots.withColumns(
        {
            "unavailable_at": unavailable_at(),
            "current_status": status,
        }
    )


def availability(
    slots: DataFrame, events: DataFrame, asof: bool = False, joined: DataFrame | None = None
) -> DataFrame:
    """Stored slots with both availability columns filled.

    Status and end time use every event of the slot, also those after the snapshot;
    ``asof=True`` looks only at events up to it. ``joined`` takes the rows of ``join_history`` where
    a caller has them already.
    """
    if asof:
        events = events.where(F.col("event_at") <= F.col("effective_ts"))
    derived = derive_availability(join_history(slots, events) if joined is None else joined)
    kept = [c for c in slots.columns if c not in ("unavailable_at", "current_status")]
    return derived.select(*kept, "unavailable_at", "current_status")
