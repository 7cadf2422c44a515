"""One row per slot with everything the later steps need to know about its events.

The first and last time of each event type are twelve fixed-width values, so one hash
aggregate with map-side combining covers all events in a single shuffle, whatever the
number of events of a slot. They settle almost everything: first booking, completion,
first and latest type, and which bookings a cancellation undid. Two cases stay open and
are read once more, for their slots only: two types at the same first or last time
(the event id decides) and a booking made again after an earlier one was canceled.

Nothing here depends on a snapshot time, so a feed without run columns is aggregated once
for all snapshots that look at it, and read as of each of them afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from openchair.operators.joins import FANOUT, salt_copies, salt_of
from openchair.params import slot_key
from openchair.schemas import EVENT_TYPES


def _first(event_type: str) -> str:
    return f"first_{event_type}_at"


def _last(event_type: str) -> str:
    return f"last_{event_type}_at"


FIRST_TIMES = tuple(_first(t) for t in EVENT_TYPES)
LAST_TIMES = tuple(_last(t) for t in EVENT_TYPES)


# Columns of the history that settle others and tell nothing more about a slot.
WORKING = (*LAST_TIMES, "first_canceled_at", "latest_event_at")


def _of_type(function: str, event_type: str, name: str) -> str:
    return f"{function}(event_at) FILTER (WHERE event_type = '{event_type}') AS {name}"


_EXTREMES = (
    *[_of_type("min", t, _first(t)) for t in EVENT_TYPES],
    *[_of_type("max", t, _last(t)) for t in EVENT_TYPES],
)
_OVERALL = (
    f"least({', '.join(FIRST_TIMES)}) AS first_event_at",
    f"greatest({', '.join(LAST_TIMES)}) AS latest_event_at",
)


def _keyed(events: DataFrame) -> DataFrame:
    # The key is required. Saying so keeps the plan of the extremes equal in the branches
    # that use them, so that their shuffle is computed once and reused.
    return events.where(" AND ".join(f"{c} IS NOT NULL" for c in slot_key(events.columns)))


def event_extremes(events: DataFrame) -> DataFrame:
    """First and last time of each event type per slot."""
    extremes = _keyed(events).groupBy(*slot_key(events.columns)).agg(*map(F.expr, _EXTREMES))
    return extremes.selectExpr("*", *_OVERALL)


def _types_at(time: str, columns: tuple[str, ...]) -> str:
    """How many event types share the given extreme time."""
    return " + ".join(f"IF({c} = {time}, 1, 0)" for c in columns)


def _type_at(time: str, columns: tuple[str, ...]) -> str:
    options = " ".join(f"WHEN {c} = {time} THEN '{t}'" for c, t in zip(columns, EVENT_TYPES))
    return f"CASE {options} END"


# Slots whose extremes leave something open.
UNDECIDED = (
    "(first_booked_at < last_canceled_at AND last_booked_at >= last_canceled_at)"
    f" OR {_types_at('first_event_at', FIRST_TIMES)} > 1"
    f" OR {_types_at('latest_event_at', LAST_TIMES)} > 1"
)


# What the single events of a slot settle, beside its limits.
_STANDS = "event_type = 'booked' AND event_at >= last_canceled_at"
_SETTLED = (
    f"min(event_at) FILTER (WHERE {_STANDS}) AS _rebooked_at",
    "min_by(event_type, event_id) FILTER (WHERE event_at = first_event_at) AS _first_type",
    "max_by(event_type, event_id) FILTER (WHERE event_at = latest_event_at) AS _latest_type",
)


def _reread(events: DataFrame, undecided: DataFrame, fanout: int) -> DataFrame:
    """Look at the single events of the undecided slots, salted so that no slot is one task."""
    key = slot_key(events.columns)
    limits = undecided.selectExpr(
        *key,
        "last_canceled_at",
        "first_event_at",
        "latest_event_at",
        f"{salt_copies(fanout)} AS _salt",
    )
    found = events.selectExpr(
        *key,
        "event_id",
        "event_type",
        "event_at",
        f"{salt_of(['event_id'], fanout)} AS _salt",
    ).join(limits, [*key, "_salt"])
    return found.groupBy(*key).agg(*map(F.expr, _SETTLED))


def _one_pass(events: DataFrame) -> DataFrame:
    """Extremes and what the undecided slots need, from one pass over the events of each slot.

    A slot is read by one task, without salts. Where events lie by slot already nothing is shuffled.
    """
    key = slot_key(events.columns)
    own = Window.partitionBy(*key)
    known = "event_type IN ({})".format(", ".join(f"'{t}'" for t in EVENT_TYPES))

    def over(function: str, condition: str):
        return F.expr(f"{function}(IF({condition}, event_at, NULL))").over(own)

    limits = {
        "last_canceled_at": over("max", "event_type = 'canceled'"),
        "first_event_at": over("min", known),
        "latest_event_at": over("max", known),
    }
    beside = _keyed(events).select(*key, "event_id", "event_type", "event_at").withColumns(limits)
    # The limit of a slot is also one of its extremes, under the same name.
    found = beside.groupBy(*key).agg(*map(F.expr, (*_EXTREMES, *_SETTLED)))
    return found.selectExpr("*", *_OVERALL)


def event_history(events: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Event extremes plus first and latest type and the earliest booking still standing.

    A booking stands when no cancellation of the slot is strictly later. Testing for the
    undecided slots again after the join makes both branches need the same extremes, so
    that the plan computes them once, whichever result columns a caller keeps.

    Events that lie by slot, as those of a feed joined by slot do, take ``fanout=1``: one pass,
    no second look.
    """
    if fanout == 1:
        settled = _one_pass(events)
    else:
        extremes = event_extremes(events)
        reread = _reread(events, extremes.where(UNDECIDED), fanout)
        settled = extremes.join(reread, list(slot_key(events.columns)), "left")
    never_undone = "last_canceled_at IS NULL OR first_booked_at >= last_canceled_at"
    return settled.selectExpr(
        *slot_key(events.columns),
        *FIRST_TIMES,
        *LAST_TIMES,
        "first_event_at",
        "latest_event_at",
        f"IF({UNDECIDED}, _first_type, {_type_at('first_event_at', FIRST_TIMES)})"
        " AS first_event_type",
        f"IF({UNDECIDED}, _latest_type, {_type_at('latest_event_at', LAST_TIMES)})"
        " AS latest_event_type",
        f"IF({never_undone}, first_booked_at, _rebooked_at) AS effective_booking_at",
    )


def effective_bookings(events: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The booked events that no later cancellation of their slot undid."""
    key = slot_key(events.columns)
    last_cancel = (
        events.where("event_type = 'canceled'")
        .groupBy(*key)
        .agg(F.max("event_at").alias("last_canceled_at"))
        .selectExpr("*", f"{salt_copies(fanout)} AS _salt")
    )
    booked = events.where("event_type = 'booked'").selectExpr(
        *key, "event_id", "event_at", f"{salt_of(['event_id'], fanout)} AS _salt"
    )
    return (
        booked.join(last_cancel, [*key, "_salt"], "left")
        .where("last_canceled_at IS NULL OR last_canceled_at <= event_at")
        .select(*key, "event_id", "event_at")
    )
