"""Running totals over dated changes against adding up the slots of each snapshot anew."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from openchair.operators import baselines, timeline
from openchair.operators.snapshot import assign_runs, is_feed, snapshot_base
from openchair.params import RunSpec, Settings
from openchair.plans import catalog
from openchair.plans.snapshot_job import SnapshotJob
from openchair.schemas import EVENT_TYPES
from openchair.sources import commerce

SLOTS = (
    "slot_id string, provider_id string, business_id string, service_id string, location_id string,"
    " slot_start_at timestamp_ntz, slot_end_at timestamp_ntz, visible_at timestamp_ntz, standard_price double,"
    " slot_duration_minutes int"
)
EVENTS = "event_id string, slot_id string, event_type string, event_at timestamp_ntz"
BEGIN = datetime(2024, 1, 1)


def feeds(spark, n=150, seed=1):
    """Slots and events on a coarse grid of times, so that changes and snapshots often fall on the same instant."""
    rng = random.Random(seed)

    def at(low, high):
        return BEGIN + timedelta(hours=6 * rng.randint(low, high))

    slots, events = [], []
    for i in range(n):
        # A third of all slots belong to one provider; some have no service.
        provider = "p0" if rng.random() < 0.34 else f"p{rng.randint(1, 4)}"
        service = rng.choice(["x", "y", None])
        start, shown = at(0, 200), at(0, 200)
        slots.append((f"s{i}", provider, "b" + provider[1], service, "l", start, start, shown, 1.0, 60))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            events.append((f"e{len(events)}", f"s{i}", rng.choice(EVENT_TYPES), at(0, 220)))
    events.append(("lost", "s_none", "booked", BEGIN))
    return spark.createDataFrame(slots, SLOTS), spark.createDataFrame(events, EVENTS)


def runs_of(hours):
    return [RunSpec("scn", f"run_{i}", BEGIN + timedelta(hours=h)) for i, h in enumerate(hours)]


GRIDS = {
    "many": [6 * i for i in range(0, 210, 5)],
    "one": [600],
    "equal and unordered": [900, 300, 300, 301, 2000, -50],
    "several a day": [600, 603, 606, 612, 618, 624, 625],
}


@pytest.mark.parametrize("name", GRIDS)
def test_totals_equal_the_cells_of_each_snapshot(spark, name):
    slots, events = feeds(spark)
    runs, settings = runs_of(GRIDS[name]), Settings()
    changes = [*timeline.cohort_changes(), *timeline.window_changes(), *timeline.pattern_changes()]
    found = timeline.cells_at_runs(slots, events, runs, settings, changes)
    base = snapshot_base(slots, events, settings, runs=runs)
    plain = baselines.slot_cells(base).select(*found.columns)
    assert plain.count() > 0
    assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


def test_a_feed_gives_the_rows_of_tables_with_runs(spark):
    slots, events = feeds(spark, seed=2)
    runs, settings = runs_of([200, 600, 900]), Settings()
    assert is_feed(slots)
    shared = snapshot_base(slots, events, settings, runs=runs)
    single = snapshot_base(assign_runs(slots, runs), assign_runs(events, runs), settings)
    assert shared.exceptAll(single).count() == 0 and single.exceptAll(shared).count() == 0


def test_no_slots_and_no_runs_in_sight(spark):
    slots, events = feeds(spark)
    changes = timeline.cohort_changes()
    assert timeline.cells_at_runs(slots.limit(0), events, runs_of([600]), Settings(), changes).count() == 0
    assert timeline.cells_at_runs(slots, events, runs_of([-1000]), Settings(), changes).count() == 0


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_events_are_aggregated_before_the_runs_come_in(spark, sf_dir):
    job = SnapshotJob(*catalog._feeds(spark, sf_dir), catalog.BACKFILL, Settings(use_model=False))
    run_copies = 0
    for node in nodes(plan_of(job.base)):
        if node.nodeName() == "Aggregate":
            below = [n for n in nodes(node) if n.nodeName() == "Generate" and "_run" in n.toString().splitlines()[0]]
            assert not below
        run_copies += node.nodeName() == "Generate" and "_run" in node.toString().splitlines()[0]
    assert run_copies == 1


def test_many_snapshots_read_the_slots_once(spark, sf_dir):
    """The plan for a year of snapshots has the scans, joins and exchanges of the plan for one."""

    def shape(runs):
        df = timeline.provider_windows(*catalog._feeds(spark, sf_dir), runs, Settings())
        return [node.nodeName().split(" ")[0] for node in nodes(plan_of(df))]

    one, year = shape(catalog.YEAR[-1:]), shape(catalog.YEAR)
    assert [n for n in year if n not in ("Project", "Filter")] == [n for n in one if n not in ("Project", "Filter")]


def test_what_is_summed_by_cell_does_not_grow_with_the_snapshots(spark, sf_dir):
    """Changes that reach the cells are the same few for each slot, however many snapshots look at them."""
    slots, events = catalog._feeds(spark, sf_dir)
    n = slots.count()
    changes = timeline.cohort_changes()
    for runs in (catalog.YEAR[-1:], catalog.YEAR):
        cells = timeline.cells_at_runs(slots, events, runs, Settings(), changes, ("business_id",))
        final = cells.groupBy("run_id").agg(F.sum("n_slots").alias("n")).where(F.col("run_id") == runs[-1].run_id).first()
        seen = slots.where(F.col("visible_at") <= F.lit(str(runs[-1].effective_ts)).cast("timestamp_ntz")).count()
        assert final.n == seen <= n


def test_the_adapter_gives_feeds_without_runs(spark, sf_dir):
    assert is_feed(commerce.slot_feed(spark, sf_dir))
    assert "run_id" not in commerce.event_feed(spark, sf_dir).columns


@pytest.mark.parametrize("name", GRIDS)
@pytest.mark.parametrize("place", [("provider_id", "slot_date"), ("business_id", "service_type", "time_of_day_bucket")])
def test_remaining_slots_equal_counting_at_each_snapshot(spark, name, place):
    slots, events = feeds(spark)
    runs, settings = runs_of(GRIDS[name]), Settings()
    found = timeline.remaining_slots(slots, runs, settings, place)
    base = snapshot_base(slots, events, settings, runs=runs).withColumn("slot_date", F.to_date("slot_start_at"))
    left = base.where("slot_start_at >= effective_ts")
    plain = left.groupBy("scenario_id", "run_id", *place).agg(F.count("*").alias("remaining_slots")).select(*found.columns)
    assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


def test_remaining_slots_of_many_runs_read_and_group_the_slots_once(spark):
    slots, _ = feeds(spark)
    plans = []
    for count in (2, 40):
        runs = runs_of([6 * i for i in range(count)])
        df = timeline.remaining_slots(slots, runs, Settings(), ("provider_id", "slot_date"))
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    # One exchange adds the changes by place and snapshot, one brings these sums in order.
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2, 2]
    assert [p.count("Scan ") for p in plans] == [1, 1]
