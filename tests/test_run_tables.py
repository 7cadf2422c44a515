"""Stored tables laid out for joins: scopes, layout and plans."""

from __future__ import annotations

import uuid

import pytest
from cases import by_slot, job_of, run_at

from openchair.operators import explorer
from openchair.plans.stored import RunTables
from openchair.sources import run_tables

RUN_A = run_at("2026-01-10 00:00:00", "run_a")
RUN_B = run_at("2026-01-11 00:00:00", "run_b")
SLOTS = [
    {"slot_id": "a", "start": "2026-01-12 12:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "b", "start": "2026-01-12 15:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "old", "start": "2026-01-05 12:00:00", "visible": "2026-01-01 00:00:00"},
]
EVENTS = [("a", "booked", "2026-01-02 00:00:00"), ("old", "completed", "2026-01-05 13:00:00")]


def name() -> str:
    return f"t_{uuid.uuid4().hex}"


def facts(spark, run, values):
    rows = [(f"s{v}", v, run.feature_snapshot_version, run.scenario_id, run.run_id) for v in values]
    return spark.createDataFrame(
        rows, "slot_id string, v int, feature_snapshot_version string, scenario_id string, run_id string"
    )


def values(spark, table):
    return {(r["run_id"], r["v"]) for r in spark.table(table).collect()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_write_replaces_the_runs_it_holds(spark, tmp_path):
    table = name()
    run_tables.write_runs(facts(spark, RUN_A, [1, 2]).union(facts(spark, RUN_B, [3])), table, 4, str(tmp_path / "t"))
    run_tables.write_runs(facts(spark, RUN_A, [5]), table, 4)
    assert values(spark, table) == {("run_a", 5), ("run_b", 3)}
    run_tables.write_runs(facts(spark, RUN_A, []), table, 4)
    assert values(spark, table) == {("run_a", 5), ("run_b", 3)}
    run_tables.clear_run(spark, table, RUN_A)
    run_tables.clear_run(spark, table, RUN_A)
    assert values(spark, table) == {("run_b", 3)}
    run_tables.write_runs(facts(spark, RUN_A, [7]), table, 4)
    assert values(spark, table) == {("run_a", 7), ("run_b", 3)}


def test_columns_go_by_name_and_other_layouts_are_refused(spark, tmp_path):
    table = name()
    rows = facts(spark, RUN_A, [1, 2])
    run_tables.write_runs(rows, table, 4, str(tmp_path / "t"))
    run_tables.write_runs(rows.select(*reversed(rows.columns)), table, 4)
    assert values(spark, table) == {("run_a", 1), ("run_a", 2)}
    with pytest.raises(ValueError, match="has columns"):
        run_tables.write_runs(rows.withColumnRenamed("v", "w"), table, 4)
    with pytest.raises(ValueError, match="has 4 buckets, not 8"):
        run_tables.write_runs(rows, table, 8)
    assert values(spark, table) == {("run_a", 1), ("run_a", 2)}


def test_a_version_that_is_not_the_run_s_is_not_read(spark, tmp_path):
    table = name()
    other = facts(spark, RUN_A, [2]).replace(RUN_A.feature_snapshot_version, "fsv_other")
    run_tables.write_runs(facts(spark, RUN_A, [1]).union(other), table, 4, str(tmp_path / "t"))
    assert [r["v"] for r in run_tables.read_run(spark, table, RUN_A).collect()] == [1]


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_joins_of_a_run_read_its_partitions_and_shuffle_nothing(spark, tmp_path, no_broadcast):
    job = job_of(spark, RUN_A, SLOTS, EVENTS, derive=True)
    stored = RunTables(spark, name(), 4, str(tmp_path))
    stored.write(job)
    joined, decisions = stored.decision_input(RUN_A), stored.decisions(RUN_A)
    for df, tables in ((joined, 4), (decisions, 5)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert plan.count("SelectedBucketsCount: 4 out of 4") == tables
        assert plan.count("(run_id#") >= tables and "PartitionFilters: []" not in plan
    columns = [c for c in joined.columns if c in job.decisions.columns]
    assert by_slot(joined.select(*columns)) == by_slot(job.decisions.select(*columns)) != {}
    assert by_slot(explorer.recommendations(decisions)) == by_slot(explorer.recommendations(job.decisions))


def test_a_run_that_became_empty_is_cleared_and_others_stay(spark, tmp_path):
    stored = RunTables(spark, name(), 4, str(tmp_path))
    stored.write(job_of(spark, RUN_A, SLOTS, EVENTS, derive=True))
    stored.write(job_of(spark, RUN_B, SLOTS, EVENTS, derive=True))
    assert [(r["run_id"], r["slot_count"]) for r in stored.runs().collect()] == [("run_b", 3), ("run_a", 3)]
    stored.write(job_of(spark, RUN_B, [], [], derive=True))
    assert [r["run_id"] for r in stored.runs().collect()] == ["run_a"]
    assert stored.decisions(RUN_B).count() == 0
    assert stored.decisions(RUN_A).count() > 0


def test_the_run_list_reads_only_the_snapshot_time(spark, tmp_path):
    stored = RunTables(spark, name(), 4, str(tmp_path))
    stored.write(job_of(spark, RUN_A, SLOTS, EVENTS, derive=True))
    assert "ReadSchema: struct<effective_ts:timestamp_ntz>" in plan_of(stored.runs())
