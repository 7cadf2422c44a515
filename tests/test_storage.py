"""Contracts, quality rules and writing."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from cases import by_slot, job_of, run_at
from pyspark.sql import functions as F

from openchair.operators import normalize, quality, recommend, scoring, underbooking
from openchair.operators.availability import availability
from openchair.operators.evaluation import evaluation, metrics_of_run
from openchair.operators.features import feature_snapshots
from openchair.params import RunSpec, Settings
from openchair.plans import catalog, staging
from openchair.plans.loading import load_batch
from openchair.plans.writing import write_run
from openchair.schemas import SLOTS
from openchair.sources import commerce, tables

RUN_A = run_at("2026-01-10 00:00:00", "run_a")
RUN_B = run_at("2026-01-11 00:00:00", "run_b")


def facts(spark, run_id: str, values: list[int]):
    return spark.createDataFrame(
        [("scn", run_id, f"s{v}", v) for v in values],
        "scenario_id string, run_id string, slot_id string, v int",
    )


def stored(spark, path):
    return {(r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()}


def test_schema_contract(spark):
    slots = spark.createDataFrame([], SLOTS)
    allowed = slots.drop("unavailable_at", "current_status", "effective_ts", "config_hash")
    quality.validate_schema(allowed, "slots")
    with pytest.raises(ValueError, match="missing required columns: \\['slot_id'\\]"):
        quality.validate_schema(allowed.drop("slot_id"), "slots")
    extra = allowed.withColumn("surprise", F.lit(1))
    with pytest.raises(ValueError, match="unexpected columns: \\['surprise'\\]"):
        quality.validate_schema(extra, "slots")
    quality.validate_schema(extra, "slots", strict=False)


def test_write_replaces_only_the_runs_it_holds(spark, tmp_path):
    path = str(tmp_path / "facts")
    tables.write_scoped(facts(spark, "run_a", [1, 2]), path)
    tables.write_scoped(facts(spark, "run_b", [3]), path)
    tables.write_scoped(facts(spark, "run_a", [4]), path)
    assert stored(spark, path) == {("run_a", 4), ("run_b", 3)}
    tables.write_scoped(facts(spark, "run_a", [4]), path)
    assert stored(spark, path) == {("run_a", 4), ("run_b", 3)}


def test_empty_result_clears_its_scope(spark, tmp_path):
    path = str(tmp_path / "facts")
    tables.write_scoped(facts(spark, "run_a", [1]), path)
    tables.write_scoped(facts(spark, "run_b", [3]), path)
    scope = {"scenario_id": "scn", "run_id": "run_a"}
    tables.replace_scope(facts(spark, "run_a", []), path, scope)
    assert stored(spark, path) == {("run_b", 3)}


def test_scan_reads_only_the_partitions_of_a_run(spark, tmp_path):
    path = str(tmp_path / "facts")
    tables.write_scoped(facts(spark, "run_a", [1]), path)
    tables.write_scoped(facts(spark, "run_b", [3]), path)
    rows = tables.read_scoped(spark, path, [RunSpec("scn", "run_b", RUN_B.effective_ts)])
    assert [r["v"] for r in rows.collect()] == [3]
    assert len(rows.inputFiles()) >= 1
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_rejected_batch_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = facts(spark, "run_a", [1, 1])
    rules = quality.duplicate_rules({"facts": (df, ("slot_id",))})
    with pytest.raises(ValueError, match="facts: 1"):
        tables.write_checked(rules, {path: df}, {path: ("scenario_id", "run_id")})
    assert not (tmp_path / "facts").exists()
    clean = df.distinct()
    rules = quality.duplicate_rules({"facts": (clean, ("slot_id",))})
    tables.write_checked(rules, {path: clean}, {path: ("scenario_id", "run_id")})
    assert stored(spark, path) == {("run_a", 1)}


def batch(spark, sf_dir, run):
    raw = commerce.raw_dimensions(spark, sf_dir)
    slots = normalize.normalize_slots(commerce.raw_slots(spark, sf_dir), run, "feed", "feed_1")
    events = normalize.normalize_events(
        commerce.raw_events(spark, sf_dir), slots, run, "feed", "feed_1"
    )
    return normalize.normalize_dimensions(raw, run.scenario_id), slots, events


def table_sizes(spark, root):
    names = ("businesses", "providers", "services", "locations", "customers")
    names += ("slots", "booking_events")
    return {n: spark.read.parquet(f"{root}/{n}").count() for n in names}


def test_loading_again_changes_nothing_and_runs_live_side_by_side(spark, sf_dir, tmp_path):
    root = str(tmp_path / "warehouse")
    load_batch(*batch(spark, sf_dir, RUN_A), RUN_A, "cfg", root)
    first = table_sizes(spark, root)
    load_batch(*batch(spark, sf_dir, RUN_A), RUN_A, "cfg", root)
    assert table_sizes(spark, root) == first
    load_batch(*batch(spark, sf_dir, RUN_B), RUN_B, "cfg", root)
    both = table_sizes(spark, root)
    assert both["slots"] == 2 * first["slots"]
    assert both["booking_events"] == 2 * first["booking_events"]
    assert both["customers"] == first["customers"]
    stored_slots = tables.read_scoped(spark, f"{root}/slots", [RUN_B])
    assert stored_slots.select("effective_ts").distinct().first()[0] == RUN_B.effective_ts


def test_an_empty_reload_clears_the_run(spark, sf_dir, tmp_path):
    root = str(tmp_path / "warehouse")
    dims, slots, events = batch(spark, sf_dir, RUN_A)
    load_batch(dims, slots, events, RUN_A, "cfg", root)
    load_batch(dims, slots, events.limit(0), RUN_A, "cfg", root)
    assert spark.read.parquet(f"{root}/booking_events").count() == 0


def test_doubled_slots_and_orphan_events_are_rejected(spark, sf_dir, tmp_path):
    root = tmp_path / "warehouse"
    dims, slots, events = batch(spark, sf_dir, RUN_A)
    with pytest.raises(ValueError, match="slot id is duplicated"):
        load_batch(dims, slots.unionAll(slots), events, RUN_A, "cfg", str(root))
    lost = events.withColumn("source_slot_id", F.lit("nope"))
    with pytest.raises(ValueError, match="event has unknown slot"):
        load_batch(dims, slots, lost, RUN_A, "cfg", str(root))
    assert not root.exists()


def test_bad_batches_leave_no_table(spark, sf_dir, tmp_path):
    root = tmp_path / "warehouse"
    dims, slots, events = batch(spark, sf_dir, RUN_A)
    with pytest.raises(ValueError, match="missing required columns"):
        load_batch(dims, slots.drop("slot_id"), events, RUN_A, "cfg", str(root))
    with pytest.raises(ValueError, match="no slots"):
        load_batch(dims, slots.limit(0), events, RUN_A, "cfg", str(root))
    unknown = events.withColumn("event_type", F.lit("teleported"))
    with pytest.raises(ValueError, match="event_type is unknown"):
        load_batch(dims, slots, unknown, RUN_A, "cfg", str(root))
    assert not root.exists()


def test_rows_that_lose_a_value_refuse_the_batch_or_go_to_the_rejects(spark, sf_dir, tmp_path):
    root, rejects = tmp_path / "warehouse", str(tmp_path / "rejects")
    dims, slots, events = batch(spark, sf_dir, RUN_A)
    spare = dims["services"].limit(1).withColumns(
        {"service_id": F.lit("svc_spare"), "source_service_id": F.lit("spare"), "duration_minutes": F.lit("1 hour")}
    )
    nameless = dims["customers"].limit(1).withColumns(
        {"customer_id": F.lit(None).cast("string"), "source_customer_id": F.lit("nobody")}
    )
    text = dims["services"].withColumn("duration_minutes", F.col("duration_minutes").cast("string"))
    faulty = dims | {"services": text.unionByName(spare), "customers": dims["customers"].unionByName(nameless)}
    with pytest.raises(ValueError, match="cannot be stored: 1"):
        load_batch(faulty, slots, events, RUN_A, "cfg", str(root))
    assert not root.exists()
    load_batch(faulty, slots, events, RUN_A, "cfg", str(root), rejects=rejects)
    kept = {(r["dimension"], r["column"], r["value"]) for r in spark.read.parquet(rejects).collect()}
    assert kept == {("services", "duration_minutes", "1 hour"), ("customers", "customer_id", None)}
    stored_services = spark.read.parquet(f"{root}/services")
    assert dict(stored_services.dtypes)["duration_minutes"] == "int"
    assert stored_services.count() == dims["services"].count()
    # A parent that facts need may not be rejected.
    needed = dims | {"services": text.withColumn("duration_minutes", F.lit("long"))}
    with pytest.raises(ValueError, match="slot has unknown service"):
        load_batch(needed, slots, events, RUN_A, "cfg", str(root), rejects=rejects)
    load_batch(dims, slots, events, RUN_A, "cfg", str(root), rejects=rejects)
    assert spark.read.parquet(rejects).count() == 0


def test_rows_of_another_scope_and_missing_dimensions_refuse_the_batch(spark, sf_dir, tmp_path):
    dims, slots, events = batch(spark, sf_dir, RUN_A)
    strangers = dims | {"customers": dims["customers"].withColumn("scenario_id", F.lit("scn_other"))}
    with pytest.raises(ValueError, match="customers row is of another scope"):
        load_batch(strangers, slots, events, RUN_A, "cfg", str(tmp_path / "warehouse"))
    with pytest.raises(ValueError, match="missing required dimensions: \\['customers'\\]"):
        load_batch({k: v for k, v in dims.items() if k != "customers"}, slots, events, RUN_A, "cfg", str(tmp_path))
    assert not (tmp_path / "warehouse").exists()


def rules_of(df):
    return {r["rule"]: r["bad_rows"] for r in df.collect()}


def test_integrity_rules_find_planted_errors(spark, sf_dir):
    dims = commerce.raw_dimensions(spark, sf_dir)
    slots, events = commerce.raw_slots(spark, sf_dir), commerce.raw_events(spark, sf_dir)
    assert set(rules_of(quality.integrity_rules(dims, slots, events)).values()) == {0}
    lost = slots.limit(1).withColumns(
        {
            "source_provider_id": F.lit("prov_none"),
            "visible_at": F.lit("2999-01-01 00:00:00"),
        }
    )
    strange = events.limit(2).withColumns(
        {"source_slot_id": F.lit("slot_none"), "source_customer_id": F.lit("cust_none")}
    )
    broken = rules_of(
        quality.integrity_rules(dims, slots.unionByName(lost), events.unionByName(strange))
    )
    assert broken["slot id is duplicated"] == 1
    assert broken["slot has unknown provider"] == 1
    assert broken["slot is visible after its start"] == 1
    assert broken["event has unknown slot"] == 2
    assert broken["event has unknown customer"] == 2
    assert broken["event id is duplicated"] == 2


def test_null_and_type_rules_find_planted_errors(spark):
    events = spark.createDataFrame(
        [("e1", None, "booked", "2026-01-01"), ("e2", "s", "teleported", "someday")],
        "event_id string, slot_id string, event_type string, event_at string",
    ).withColumns({"scenario_id": F.lit("scn"), "run_id": F.lit("r")})
    assert rules_of(quality.null_rules(events, "booking_events"))["booking_events.slot_id is null"] == 1
    assert rules_of(quality.event_type_rules(events)) == {
        "booking_events.event_at is no timestamp": 1,
        "booking_events.event_type is unknown": 1,
    }
    gate = quality.gate(quality.event_type_rules(events)).first()
    assert (gate["failed_rules"], gate["bad_rows"], gate["accepted"]) == (2, 2, False)


def test_policy_rules_find_planted_errors(spark):
    settings = Settings(excluded_services=("svc_x",))
    rows = spark.createDataFrame(
        [
            ("a", 20.0, [0, 5], False, False, "svc_1", 100.0, 0.9),
            ("b", 5.0, [0, 5], True, False, "svc_x", 100.0, 0.1),
            ("c", 40.0, [0, 40], True, False, "svc_1", 100.0, 0.05),
        ],
        "slot_id string, action_value double, eligible array<int>, underbooked boolean, "
        "was_exploration boolean, service_id string, standard_price double, shortfall_score double",
    ).withColumns(
        {
            "scenario_id": F.lit("scn"),
            "run_id": F.lit("r"),
            "action_type": F.lit("discount_pct"),
            "decision_timestamp": F.lit("2026-01-01").cast("timestamp_ntz"),
            "confidence_score": F.lit(None).cast("double"),
            "rationale_codes": F.lit("[]"),
        }
    )
    found = rules_of(quality.policy_rules(rows, settings))
    assert found["required field is missing"] == 3
    assert found["action is not permitted"] == 2
    assert found["healthy slot is discounted"] == 1
    assert found["excluded service is discounted"] == 1
    assert found["price is below the floor"] == 1


def test_normalization_is_repeatable_and_keeps_absent_customers(spark, sf_dir):
    first = sorted(catalog.normalize_events(spark, sf_dir).select("event_id", "customer_id").collect(), key=str)
    second = sorted(catalog.normalize_events(spark, sf_dir).select("event_id", "customer_id").collect(), key=str)
    assert first == second
    assert any(r["customer_id"] is None for r in first)


def test_loaded_slots_have_the_stored_layout(spark, sf_dir):
    loaded = normalize.load_slots(catalog.normalize_slots(spark, sf_dir), catalog.RUN, "cfg")
    assert [(f.name, f.dataType) for f in loaded.schema] == [(f.name, f.dataType) for f in SLOTS]


def test_stored_tables_rebuild_decisions_and_metrics(spark, sf_dir, tmp_path):
    """Write every table of a run, read it back, and get the same view and metrics."""
    job = catalog._job(spark, sf_dir)
    slots = availability(job.slots, job.events)
    written = {
        "slots": slots,
        "features": feature_snapshots(catalog._job(spark, sf_dir, scarcity=True).features_once),
        "underbooking": underbooking.underbooking_outputs(job.flagged),
        "scores": scoring.scoring_outputs(job.scored),
        "actions": recommend.pricing_actions(job.decisions),
    }
    read = {}
    for name, df in written.items():
        tables.write_scoped(df, str(tmp_path / name))
        read[name] = tables.read_scoped(spark, str(tmp_path / name), [catalog.RUN])
    view = recommend.decision_view(
        read["actions"], read["slots"], read["features"], read["underbooking"], read["scores"]
    )
    columns = ("slot_id", "severity_score", "shortfall_score", "eligible", "rationale", "service_id")
    assert by_slot(view.select(*columns)) == by_slot(job.decisions.select(*columns))
    from_stored = evaluation(read["slots"], read["underbooking"], read["scores"], view)
    direct = evaluation(job.slots, job.flagged, job.scored, job.decisions)
    values = {r["metric_name"]: r["metric_value"] for r in direct.collect()}
    again = metrics_of_run(from_stored, catalog.RUN.scenario_id, catalog.RUN.run_id).collect()
    assert {r["metric_name"]: r["metric_value"] for r in again} == pytest.approx(values)
    rejoined = recommend.decision_input(
        read["slots"], read["features"], read["underbooking"], read["scores"]
    )
    redone = recommend.pricing_actions(recommend.decide(rejoined, job.settings))
    assert by_slot(redone) == by_slot(recommend.pricing_actions(job.decisions))


def test_staging_follows_the_cluster_setting(spark):
    """The setting is fixed when a session starts, so only the choice of folder is tested."""

    def session_with(**settings):
        return SimpleNamespace(conf={k.replace("__", "."): v for k, v in settings.items()})

    shared = session_with(spark__checkpoint__dir="hdfs://shared/tmp", spark__master="yarn")
    assert staging.staging_root(shared) == "hdfs://shared/tmp"
    unset = session_with(spark__sql__warehouse__dir="hdfs://shared/warehouse")
    assert staging.staging_root(unset) == "hdfs://shared/warehouse/_staged"
    rows = facts(spark, "run_a", [1, 2])
    by_run = staging.staged(rows, "facts", ("run_id",))
    assert by_run.columns == rows.columns
    assert sorted(by_run.collect(), key=str) == sorted(rows.collect(), key=str)


def test_small_job_runs_end_to_end_with_derived_availability(spark):
    slots = [
        {"slot_id": "a", "start": "2026-01-12 12:00:00", "visible": "2026-01-01 00:00:00"},
        {"slot_id": "b", "start": "2026-01-12 15:00:00", "visible": "2026-01-01 00:00:00"},
        {"slot_id": "old", "start": "2026-01-05 12:00:00", "visible": "2026-01-01 00:00:00"},
    ]
    events = [("a", "booked", "2026-01-02 00:00:00"), ("old", "completed", "2026-01-05 13:00:00")]
    job = job_of(spark, RUN_A, slots, events, derive=True)
    assert [r["slot_id"] for r in job.decisions.collect()] == ["b"]


WRITTEN = [
    {"slot_id": "a", "start": "2026-01-12 12:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "b", "start": "2026-01-12 15:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "old", "start": "2026-01-05 12:00:00", "visible": "2026-01-01 00:00:00"},
]
WRITTEN_EVENTS = [
    ("a", "booked", "2026-01-02 00:00:00"),
    ("old", "completed", "2026-01-05 13:00:00"),
]


def actions_of(spark, root):
    rows = spark.read.parquet(f"{root}/pricing_actions").collect()
    return sorted((r["run_id"], r["slot_id"], r["action_value"]) for r in rows)


def test_a_run_is_written_whole_and_replaced(spark, tmp_path):
    root = str(tmp_path)
    job = job_of(spark, RUN_A, WRITTEN, WRITTEN_EVENTS, derive=True)
    write_run(job, root)
    sizes = {name.name: spark.read.parquet(str(name)).count() for name in tmp_path.iterdir()}
    metrics = sizes.pop("evaluation_results")
    assert metrics == job_metrics(job)
    assert sizes == {
        "cohort_baselines": job.baselines.count(),
        "feature_snapshots": 3,
        "underbooking_outputs": 3,
        "business_calibrations": 1,
        "scoring_outputs": 1,
        "pricing_actions": 1,
    }
    assert [row[:2] for row in actions_of(spark, root)] == [("run_a", "b")]
    # All slots are taken now, so the run keeps no score and no action.
    taken = [*WRITTEN_EVENTS, ("b", "booked", "2026-01-03 00:00:00")]
    write_run(job_of(spark, RUN_A, WRITTEN, taken, derive=True), root)
    with_b = job_of(spark, RUN_B, WRITTEN, WRITTEN_EVENTS, derive=True)
    write_run(with_b, root)
    assert [row[:2] for row in actions_of(spark, root)] == [("run_b", "b")]


def job_metrics(job) -> int:
    slots = availability(job.slots, job.events)
    return evaluation(slots, job.flagged, job.decisions, job.decisions).count()


def test_a_run_that_breaks_a_rule_leaves_the_old_tables(spark, tmp_path):
    root = str(tmp_path)
    write_run(job_of(spark, RUN_A, WRITTEN, WRITTEN_EVENTS, derive=True), root)
    before = actions_of(spark, root)

    def refused(message, **changes):
        job = job_of(spark, RUN_A, WRITTEN, WRITTEN_EVENTS, derive=True)
        job.decisions = job.decisions.withColumns(changes) if changes else job.decisions.limit(0)
        with pytest.raises(ValueError, match=message):
            write_run(job, root)
        assert actions_of(spark, root) == before

    refused("action is not permitted", action_value=F.lit(99.0))
    refused("confidence_score outside 0 to 1", confidence_score=F.lit(1.5))
    refused("scoring_complete")
    job = job_of(spark, RUN_A, WRITTEN, WRITTEN_EVENTS, derive=True)
    job.decisions = job.decisions.unionAll(job.decisions)
    with pytest.raises(ValueError, match="pricing_actions"):
        write_run(job, root)
    job.runs = [RUN_A, RUN_B]
    with pytest.raises(ValueError, match="run_b is not complete: slots_loaded"):
        write_run(job, root)
    assert actions_of(spark, root) == before


def test_every_integrity_rule_fails_on_the_faulty_batch_and_reads_each_table_once(spark, sf_dir):
    from openchair.plans import catalog

    found = rules_of(catalog.dq_integrity_faults(spark, sf_dir))
    assert len(found) == 13 and all(n > 0 for n in found.values())
    plan = catalog.dq_integrity(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # Five dimensions, slots, and events with the orders they take their times from.
    assert plan.count("Relation [") == 8


def test_null_names_and_references(spark):
    """A null reference is unknown even where a null name exists; null names that come twice are duplicates."""
    def one(columns, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))

    dims = {
        "businesses": one("source_business_id", ("b",), (None,)),
        "providers": one("source_provider_id source_business_id source_location_id", ("p", "b", "l")),
        "services": one("source_service_id source_business_id", ("s", None)),
        "locations": one("source_location_id source_business_id", ("l", "b")),
        "customers": one("source_customer_id source_business_id", ("c", "b")),
    }
    slot = "source_slot_id source_provider_id source_service_id source_location_id visible_at slot_start_at"
    slots = one(slot, (None, "p", "s", "l", "1", "2"), (None, "p", "s", "l", "2", "2"), ("x", None, "s", "l", "3", "2"))
    events = one("source_event_id source_slot_id source_customer_id", ("e", "x", None), ("e", None, "c"), ("f", "x", "d"))
    found = {rule: n for rule, n in rules_of(quality.integrity_rules(dims, slots, events)).items() if n}
    assert found == {
        "service has unknown business": 1, "slot id is duplicated": 1, "slot has unknown provider": 1,
        "slot is visible after its start": 1, "event id is duplicated": 1, "event has unknown slot": 1,
        "event has unknown customer": 1,
    }
