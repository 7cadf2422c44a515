"""Jobs over large tables: events are shuffled once, and slots keep their layout to the stored tables."""

from __future__ import annotations

import uuid

import pytest
from cases import by_slot
from test_scale import NO_BROADCAST, brute_history, conf, executed_plan, random_events

from openchair.operators import availability, history
from openchair.plans import catalog
from openchair.plans.staging import staged
from openchair.plans.stored import RunTables
from openchair.sources import commerce


def lines(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [4, 5])
def test_one_pass_equals_brute_force_and_the_salted_history(spark, seed):
    data, events = random_events(spark, seed, slots=60, rows=900)
    found = history.event_history(events, fanout=1)
    assert {
        r["slot_id"]: (r["first_event_type"], r["latest_event_type"], r["effective_booking_at"])
        for r in found.collect()
    } == brute_history(data)
    # Null keys, types, times and ids, an unknown type, and events that come twice.
    names = events.columns
    odd = [
        tuple(None if (i + j) % 7 == 0 and names[j] in ("slot_id", "event_id", "event_type", "event_at") else v
              for j, v in enumerate(row))
        for i, row in enumerate(data)
    ] + data[:50] + [(*row[:4], f"{row[4]}x", "unknown", row[6]) for row in data[50:90]]
    events = spark.createDataFrame(odd, events.schema)
    salted = history.event_history(events)
    assert lines(history.event_history(events, fanout=1).select(*salted.columns)) == lines(salted)


def test_events_are_shuffled_once_for_their_history(spark, sf_dir):
    slots, events = commerce.slot_feed(spark, sf_dir), commerce.event_feed(spark, sf_dir)
    with conf(spark, **NO_BROADCAST):
        joined = availability.join_history(slots, events, fanout=1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    # Line items, their orders, and the slots.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("lineitem.parquet") == 1


def test_slots_and_base_rows_come_from_one_join(spark, sf_dir):
    job = catalog._job(spark, sf_dir, runs=catalog.BACKFILL, slots_too=True)
    for df in (job.available, job.base):
        plan = executed_plan(df)
        assert "Exchange" not in plan and "lineitem" not in plan
    plain = catalog._job(spark, sf_dir, runs=catalog.BACKFILL)
    assert lines(job.base) == lines(plain.base)
    assert lines(job.available) == lines(availability.availability(plain.slots, plain.events))


def test_stored_runs_shuffle_no_slots_after_their_join(spark, sf_dir, tmp_path):
    job = catalog._job(spark, sf_dir, runs=catalog.BACKFILL, scarcity=True, slots_too=True, buckets=8)
    for df in (job.available, job.features, job.flagged):
        written = df.repartition(8, "slot_id")
        assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    stored = RunTables(spark, f"t_{uuid.uuid4().hex}", 8, str(tmp_path))
    stored.write(job)
    plain = catalog._job(spark, sf_dir, runs=catalog.BACKFILL, scarcity=True)
    assert job.features.count() == plain.features.count() > 0
    kept = [c for c in stored.decisions(catalog.RUN).columns if c in plain.decisions.columns]
    expected = plain.decisions.where(f"run_id = '{catalog.RUN.run_id}'").select(*kept)
    found = catalog._rounded(stored.decisions(catalog.RUN).select(*kept))
    assert by_slot(found) == by_slot(catalog._rounded(expected)) != {}


def test_partitioned_writes_sort_no_rows(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(100).selectExpr("concat('s', id) AS slot_id", "id % 3 AS run_id")
    kept = staged(rows, "rows", ("run_id",), 4)
    assert lines(kept) == lines(rows)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
