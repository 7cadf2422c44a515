"""Cell statistics at any number of snapshots out of dated changes, read once.

What a slot adds to a sum over its cell changes at a few times only: when it is published, first booked, completed or
closed, when a trailing window first holds it and when it leaves again. Each of these is one dated change. The sums at a
snapshot are the totals of all changes up to it, so changes between two snapshots are added first, with map-side combining,
and a running total over the snapshots of a cell does the rest. Slots and events are read once, and what is shuffled does
not grow with the number of snapshots beyond one row for each cell and snapshot.

An open slot's time on offer grows with the snapshot; it is kept as a slope and a constant. All sums are whole numbers, so
the results equal those of adding up the slots at each snapshot anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from openchair.functions import calendar
from openchair.operators.availability import join_history, unavailable_at
from openchair.operators.baselines import COHORT_KEY, PATTERN_EVENTS
from openchair.operators.features import DAY_MICROS, GROUP_STATISTICS
from openchair.operators.snapshot import HOUR_MICROS, add_cohort_key
from openchair.params import RUN_KEY, RunSpec, Settings
from openchair.schemas import TRAILING_DAYS

PLACE = ("business_id", "provider_id", *COHORT_KEY)
_EPOCH = datetime(1970, 1, 1)
# Times of a slot as microseconds; a slot without the event has null.
_TIMES = {
    "v": "visible_at",
    "s": "slot_start_at",
    "b": "first_booked_at",
    "c": "first_completed_at",
    "e": "first_event_at",
    "u": "unavailable_at",
}

Change = tuple[str, str, str]  # measure, time, amount


def _micros(ts: datetime) -> int:
    return round((ts - _EPOCH).total_seconds() * 1_000_000)


def _once(measure: str, at: str, amount: str = "1") -> list[Change]:
    """From a time on, once the slot is published; never where the time is null."""
    return [(measure, f"IF({at} IS NULL, NULL, greatest(v, {at}))", amount)]


def _while(measure: str, begin: str, last: str) -> list[Change]:
    """From a time to another one, both included."""
    since = f"IF({begin} IS NULL, NULL, greatest(v, {begin}))"
    held = f"{since} <= {last}"
    return [(measure, f"IF({held}, {since}, NULL)", "1"), (measure, f"IF({held}, {last} + 1, NULL)", "-1")]


def cohort_changes() -> list[Change]:
    """Slots, bookings, completions, lead time and time on offer. Without time on offer a slot counts an hour of it."""
    closed = "coalesce(u, s)"
    open_while = f"{closed} > v"
    return [
        *_once("n_slots", "v"),
        *_once("n_booked", "b"),
        *_once("n_completed", "c"),
        *_once("lead_micros", "b", "s - b"),
        ("active_constant", "v", str(HOUR_MICROS)),
        ("active_constant", f"IF({open_while}, v + 1, NULL)", f"-v - {HOUR_MICROS}"),
        ("active_slope", f"IF({open_while}, v + 1, NULL)", "1"),
        ("active_constant", f"IF({open_while}, {closed}, NULL)", closed),
        ("active_slope", f"IF({open_while}, {closed}, NULL)", "-1"),
    ]


def window_changes() -> list[Change]:
    """Slots started, started and kept, and first booked within the trailing windows."""
    changes = []
    for days in TRAILING_DAYS:
        length = days * DAY_MICROS
        changes += _while(f"n_started_{days}d", "s", f"s + {length}")
        # Kept by the snapshot: booked or completed, whichever is first.
        changes += _while(f"n_kept_{days}d", "IF(least(b, c) IS NULL, NULL, greatest(s, least(b, c)))", f"s + {length}")
        changes += _while(f"n_fresh_{days}d", "b", f"b + {length}")
    return changes


def pattern_changes() -> list[Change]:
    """Slots by their first event, and slots still to start."""
    changes = _while("n_future", "v", "s")
    for name, event_type in PATTERN_EVENTS.items():
        changes += _once(f"n_first_{name}", f"IF(first_event_type = '{event_type}', e, NULL)")
    return changes


def _index_of(at: str, times: Sequence[int]) -> str:
    """SQL: the number of snapshots before ``at``, that is the place of the first one that sees it.

    A table by days since the first snapshot leaves only those of one day to compare with.
    """
    first, last = times[0], times[-1]
    days = (last - first) // DAY_MICROS + 2
    before = [sum(t < first + k * DAY_MICROS for t in times) for k in range(days + 1)]
    listed = f"array({', '.join(f'{t}L' for t in times)})"
    table = f"array({', '.join(map(str, before))})"
    day = f"CAST(({at} - {first}L) div {DAY_MICROS}L AS INT)"
    low, high = f"element_at({table}, {day} + 1)", f"element_at({table}, {day} + 2)"
    within = f"size(filter(slice({listed}, {low} + 1, {high} - {low}), t -> t < {at}))"
    return f"CASE WHEN {at} <= {first}L THEN 0 WHEN {at} > {last}L THEN {len(times)} ELSE {low} + {within} END"


def cells_at_runs(
    slots: DataFrame,
    events: DataFrame,
    runs: Sequence[RunSpec],
    settings: Settings,
    changes: Sequence[Change],
    place: Sequence[str] = PLACE,
) -> DataFrame:
    """The sums of ``changes`` for every run and ``place`` with a published slot, from feeds without run columns.

    Columns are named as in ``baselines.slot_cells``, so all that is built on cells can be built on these.
    """
    known = add_cohort_key(join_history(slots, events), settings)
    known = known.withColumn("unavailable_at", unavailable_at())
    return _sums_at_runs(known, runs, changes, place, _TIMES)


def _sums_at_runs(
    known: DataFrame,
    runs: Sequence[RunSpec],
    changes: Sequence[Change],
    place: Sequence[str],
    clocks: Mapping[str, str],
    having: str = "true",
) -> DataFrame:
    """Running totals of ``changes``; ``having`` drops totals before they are spread over the runs that see them."""
    ordered = sorted(runs, key=lambda run: (run.effective_ts, run.scenario_id, run.run_id))
    times = [_micros(run.effective_ts) for run in ordered]
    measures = list(dict.fromkeys(measure for measure, _, _ in changes))
    known = known.where("visible_at IS NOT NULL")
    epoch = f"TIMESTAMP_NTZ '{_EPOCH}'"
    timed = known.selectExpr(
        *place,
        *(["first_event_type"] if "first_event_type" in known.columns else []),
        *[f"timestampdiff(MICROSECOND, {epoch}, {column}) AS {name}" for name, column in clocks.items()],
    )
    listed = ", ".join(
        f"named_struct('measure', {measures.index(measure)}, 'at', {at}, 'amount', CAST({amount} AS DECIMAL(20, 0)))"
        for measure, at, amount in changes
    )
    dated = timed.selectExpr(*place, f"inline(array({listed}))").where(f"at <= {times[-1]}L")
    added = dated.selectExpr(*place, f"{_index_of('at', times)} AS _index", "measure", "amount")
    sums = added.groupBy(*place, "_index").agg(
        *[F.expr(f"coalesce(sum(IF(measure = {i}, amount, NULL)), 0) AS {m}") for i, m in enumerate(measures)]
    )
    so_far = Window.partitionBy(*place).orderBy("_index")
    totals = sums.select(
        *place,
        "_index",
        F.lead("_index", 1, len(ordered)).over(so_far).alias("_next"),
        *[F.sum(m).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias(m) for m in measures],
    )
    described = ", ".join(
        f"named_struct('scenario_id', '{run.scenario_id}', 'run_id', '{run.run_id}', 'feature_snapshot_version',"
        f" '{run.feature_snapshot_version}', '_ts', {ts}L)"
        for run, ts in zip(ordered, times)
    )
    every = totals.where(having).selectExpr("*", "explode(sequence(_index, _next - 1)) AS _run").selectExpr(
        *place, *measures, f"element_at(array({described}), _run + 1) AS _run"
    )
    every = every.selectExpr(*place, "_run.*", *measures)
    plain = [m for m in measures if not m.startswith("active_")]
    whole = [f"CAST({m} AS {'DECIMAL(38, 0)' if m == 'lead_micros' else 'BIGINT'}) AS {m}" for m in plain]
    if "active_slope" in measures:
        whole.append("CAST(active_slope * _ts + active_constant AS DECIMAL(38, 0)) AS active_micros")
    return every.selectExpr(*RUN_KEY, "feature_snapshot_version", *place, *whole)


def provider_windows(
    slots: DataFrame, events: DataFrame, runs: Sequence[RunSpec], settings: Settings
) -> DataFrame:
    """Utilization and booking volume of every provider in the trailing windows of every run."""
    changes = [*_once("n_slots", "v"), *window_changes()]
    cells = cells_at_runs(slots, events, runs, settings, changes, ("provider_id",))
    keys, measures = GROUP_STATISTICS["provider"]
    return cells.groupBy(*RUN_KEY, *keys).agg(*[F.expr(m) for m in measures])


def remaining_slots(
    slots: DataFrame, runs: Sequence[RunSpec], settings: Settings, place: Sequence[str]
) -> DataFrame:
    """Slots still to come at every run for each ``place``: published by then and not yet started.

    ``place`` names columns of the slots, of their cohort, or ``slot_date``. A slot counts from its publication to its start,
    two dated changes, so what is left at a snapshot is a running total and slots are grouped once for all runs. Places with
    nothing left have no row: a date that has passed is not carried on to later runs.
    """
    known = add_cohort_key(slots, settings).withColumn("slot_date", F.to_date("slot_start_at"))
    clocks = {name: _TIMES[name] for name in ("v", "s")}
    changes = _while("n_future", "v", "s")
    left = _sums_at_runs(known, runs, changes, place, clocks, having="n_future > 0")
    return left.select(*RUN_KEY, *place, F.col("n_future").alias("remaining_slots"))
