"""Hot keys, shuffled joins and many snapshots: same results as the plain case or brute force."""

from __future__ import annotations

import io
import random
import re
from contextlib import contextmanager, redirect_stdout
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import EVENT_SCHEMA, by_slot, job_of, run_at
from openchair.functions.ids import stable_id
from openchair.operators import features, history
from openchair.operators.joins import attach
from openchair.params import RunSpec, Settings
from openchair.plans import catalog
from openchair.plans.snapshot_job import SnapshotJob
from openchair.schemas import EVENT_TYPES, MODEL_FEATURES

SNAPSHOT = run_at("2026-01-10 00:00:00")
EPOCH = datetime(2026, 1, 1)


@contextmanager
def conf(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    try:
        for key, name in names.items():
            spark.conf.set(name, values[key])
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


NO_BROADCAST = {"spark__sql__autoBroadcastJoinThreshold": "-1"}


def random_events(spark, seed: int, slots: int, rows: int):
    """A third of all events belong to slot 0, and times collide often."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        slot = 0 if rng.random() < 1 / 3 else rng.randrange(slots)
        when = EPOCH + timedelta(hours=rng.randrange(60))
        data.append(
            (
                SNAPSHOT.scenario_id,
                SNAPSHOT.run_id,
                SNAPSHOT.effective_ts,
                f"s{slot}",
                f"e{i:06d}",
                rng.choice(EVENT_TYPES),
                when,
            )
        )
    return data, spark.createDataFrame(data, EVENT_SCHEMA)


def brute_history(data):
    out = {}
    for slot in {row[3] for row in data}:
        own = sorted((row[6], row[4], row[5]) for row in data if row[3] == slot)
        standing = [
            t
            for t, _, kind in own
            if kind == "booked"
            and not any(k == "canceled" and other > t for other, _, k in own)
        ]
        out[slot] = (own[0][2], own[-1][2], min(standing, default=None))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_equals_brute_force_with_a_hot_slot(spark, seed):
    data, events = random_events(spark, seed, slots=120, rows=1500)
    found = {
        r["slot_id"]: (r["first_event_type"], r["latest_event_type"], r["effective_booking_at"])
        for r in history.event_history(events).collect()
    }
    assert found == brute_history(data)


def test_effective_bookings_equal_brute_force(spark):
    data, events = random_events(spark, 7, slots=60, rows=900)
    expected = {
        row[4]
        for row in data
        if row[5] == "booked"
        and not any(
            o[3] == row[3] and o[5] == "canceled" and o[6] > row[6] for o in data
        )
    }
    with conf(spark, **NO_BROADCAST):
        found = history.effective_bookings(events).collect()
    assert sorted(r["event_id"] for r in found) == sorted(expected)


def test_attach_spreads_one_key_over_many_partitions(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("slot_id"))
    groups = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    with conf(
        spark, **NO_BROADCAST, spark__sql__adaptive__coalescePartitions__enabled="false"
    ):
        joined = attach(rows, groups, ("k",), ("slot_id",))
        assert joined.where("v = 1").count() == 4000
        used = joined.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= 4


def executed_plan(df) -> str:
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


SMALL_SKEW = NO_BROADCAST | {
    "spark__sql__shuffle__partitions": "40",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "100KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "100KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
}


def test_attach_lets_the_engine_split_a_hot_key(spark):
    """Joined plainly to its own group table, the hot key would stay in one task."""
    rows = spark.range(600_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id % 5000)) AS k", "id AS slot_id", "uuid() AS payload"
    )
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    with conf(spark, **SMALL_SKEW):
        joined = attach(rows, groups, ("k",), ("slot_id",)).selectExpr("sum(n)", "max(payload)")
        assert "skew=true" in executed_plan(joined)
        plain = rows.join(groups, "k", "left").selectExpr("sum(n)", "max(payload)")
        assert "skew=true" not in executed_plan(plain)


def test_extremes_are_shuffled_once(spark, sf_dir):
    """One hash aggregate feeds both branches, whatever columns the caller keeps."""
    events = catalog._events(spark, sf_dir)
    for kept in ("latest_event_type", "first_event_type"):
        found = history.event_history(events).selectExpr("count(*)", f"max({kept})")
        assert "ReusedExchange [scenario_id" in executed_plan(found)
    known = catalog.slot_availability(spark, sf_dir)
    assert "ReusedExchange [scenario_id" in executed_plan(known)


def test_attach_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "slot_id int, k string")
    groups = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    plain = {r["slot_id"]: r["v"] for r in attach(rows, groups, ("k",), ("slot_id",)).collect()}
    safe = attach(rows, groups, ("k",), ("slot_id",), null_safe=("k",)).collect()
    assert plain == {1: None, 2: 20}
    assert {r["slot_id"]: r["v"] for r in safe} == {1: 10, 2: 20}


def brute_density(starts):
    window = timedelta(hours=2)
    return {
        slot: float(sum(1 for other in starts.values() if abs(other - start) <= window))
        for slot, start in starts.items()
    }


def test_density_equals_brute_force(spark):
    rng = random.Random(5)
    starts = {
        f"s{i}": datetime(2026, 1, 11) + timedelta(minutes=15 * rng.randrange(400))
        for i in range(300)
    }
    slots = [
        {"slot_id": s, "start": str(t), "visible": "2026-01-01 00:00:00"}
        for s, t in starts.items()
    ]
    base = job_of(spark, SNAPSHOT, slots, []).base
    found = {
        r["slot_id"]: r["inventory_density_2h"]
        for r in features.add_density(base, base).collect()
    }
    assert found == brute_density(starts)


def rounded_features(spark, sf_dir):
    return sorted(map(tuple, catalog.feature_snapshots(spark, sf_dir).collect()))


def test_features_do_not_depend_on_join_strategy_or_partitions(spark, sf_dir):
    expected = rounded_features(spark, sf_dir)
    with conf(spark, **NO_BROADCAST, spark__sql__shuffle__partitions="13"):
        assert rounded_features(spark, sf_dir) == expected


def test_decisions_survive_shuffled_joins(spark, sf_dir):
    expected = sorted(map(tuple, catalog.pricing_actions(spark, sf_dir).collect()))
    with conf(spark, **NO_BROADCAST):
        assert sorted(map(tuple, catalog.pricing_actions(spark, sf_dir).collect())) == expected


def test_plans_have_no_cross_join_and_no_python(spark, sf_dir):
    with conf(spark, **NO_BROADCAST):
        for name in ("recommendations", "feature_snapshots", "evaluation", "dq_integrity"):
            out = io.StringIO()
            with redirect_stdout(out):
                catalog.QUERIES[name](spark, sf_dir).explain()
            for node in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
                assert node not in out.getvalue(), (name, node)


def test_open_slots_are_filtered_in_the_scan(spark, sf_dir):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.recommendations(spark, sf_dir).explain("formatted")
    assert "EqualTo(current_status,open)" in out.getvalue()


def test_many_snapshots_at_once_equal_single_jobs(spark, sf_dir):
    together = catalog._job(spark, sf_dir, runs=catalog.BACKFILL).decisions
    together = by_run(together.select("run_id", "slot_id", "action_value", "rationale_codes"))
    assert {run for run, _ in together} == {r.run_id for r in catalog.BACKFILL}
    single = {}
    for run in catalog.BACKFILL:
        rows = catalog._job(spark, sf_dir, runs=(run,)).decisions
        single |= by_run(rows.select("run_id", "slot_id", "action_value", "rationale_codes"))
    assert together == single


def by_run(df):
    return {(r["run_id"], r["slot_id"]): (r[2], r[3]) for r in df.collect()}


def test_models_are_fitted_per_run(spark, sf_dir):
    runs = catalog.BACKFILL[:2]
    job = catalog._job(spark, sf_dir, Settings(), runs=runs)
    rows = job.scored.select("run_id", "used_fallback", "booking_probability").collect()
    assert {r["run_id"] for r in rows} == {r.run_id for r in runs}
    assert not any(r["used_fallback"] for r in rows)
    assert all(0.0 <= r["booking_probability"] <= 1.0 for r in rows)


def test_model_learns_from_its_features(spark, sf_dir):
    """Booked history must raise the fitted probability of started slots."""
    from openchair.operators import scoring

    job = catalog._job(spark, sf_dir, Settings())
    rated = scoring.with_model_probability(job.training, job.models)
    means = dict(
        (r["label"], r["p"])
        for r in rated.groupBy("label").agg(F.avg("model_probability").alias("p")).collect()
    )
    assert means[1] > means[0]
    (model,) = job.models.values()
    assert_optimal(model, job.training, job.settings.l2_c)


def assert_optimal(model, training, l2_c):
    """The slope of the penalized loss must vanish at the fitted weights, and Newton steps of numpy end there too."""
    rows = np.array(training.select(*MODEL_FEATURES, "label").collect(), dtype=float)
    x, y = np.column_stack([rows[:, :-1], np.ones(len(rows))]), rows[:, -1]
    weights = np.array([*model.coefficients, model.intercept])
    penalty = np.append(np.ones(len(MODEL_FEATURES)), 0.0)

    def parts(w):
        p = 1.0 / (1.0 + np.exp(-(x @ w)))
        curvature = l2_c * (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        return l2_c * x.T @ (p - y) + penalty * w, curvature

    slope, curvature = parts(weights)
    assert np.abs(slope / np.sqrt(np.diag(curvature))).max() < 1e-5
    plain = weights.copy()
    for _ in range(5):
        slope, curvature = parts(plain)
        plain = plain - np.linalg.solve(curvature, slope)
    assert np.abs(x @ plain - x @ weights).max() < 1e-5
    assert model.rows == len(y) and model.steps < 30


def test_logistic_of_many_groups_in_one_search(spark):
    """Every group ends at its own optimum, also separable, shifted and badly scaled ones; a fit cut short raises."""
    from openchair.operators import logistic

    rng = np.random.default_rng(2)
    rows = []
    for g, (n, scale) in enumerate([(200, 1.0), (50, 1e4), (30, 1e-3), (12, 1.0)]):
        x = rng.standard_normal((n, 2)) * [scale, 1.0] + [5 * scale, 0.0]
        y = x[:, 1] + (0 if g == 3 else rng.standard_normal(n)) > 0.3
        rows += [(f"g{g}", float(a), float(b), int(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, a double, b double, label int")
    groups = [(f"g{i}",) for i in range(4)]
    found = logistic.fit(df, groups, ("a", "b"), ("g",), ("a", "b"), 1.0, 100, 1e-9)
    assert set(found) == set(groups)
    for (name,), model in found.items():
        own = np.array([r[1:] for r in rows if r[0] == name])
        x, y = np.column_stack([own[:, :2], np.ones(len(own))]), own[:, 2]
        w = np.array([*model.coefficients, model.intercept])
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) + w * [1, 1, 0]
        assert np.abs(slope).max() <= 1e-6 * np.abs(x).sum(axis=0).max()
    with pytest.raises(RuntimeError, match="did not converge"):
        logistic.fit(df, groups, ("a", "b"), ("g",), ("a", "b"), 1.0, 1, 1e-9)


def test_a_run_without_rows_changes_nothing(spark, sf_dir):
    early = RunSpec("scn_main", "run_before", datetime(1990, 1, 1))
    with_empty = catalog._job(spark, sf_dir, runs=(catalog.RUN, early))
    alone = catalog._job(spark, sf_dir)
    assert by_slot(with_empty.decisions.select("slot_id", "action_value")) == by_slot(
        alone.decisions.select("slot_id", "action_value")
    )


def test_severity_grows_with_both_gaps(spark, sf_dir):
    rows = catalog.underbooking_outputs(spark, sf_dir).collect()
    ordered = sorted(rows, key=lambda r: 0.6 * r["pace_gap_normalized"] + 0.4 * r["fill_gap_normalized"])
    severities = [r["severity_score"] for r in ordered]
    assert all(a <= b + 1e-5 for a, b in zip(severities, severities[1:]))
    assert all(0.0 <= s <= 1.0 for s in severities)


def test_the_job_wants_utc(spark, sf_dir):
    slots, events = catalog._slots(spark, sf_dir), catalog._events(spark, sf_dir)
    with conf(spark, spark__sql__session__timeZone="America/New_York"):
        with pytest.raises(ValueError, match="timeZone"):
            SnapshotJob(slots, events, (catalog.RUN,))


def test_stable_id_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    ids = [r["i"] for r in df.select(stable_id("slot", F.lit("scn"), F.col("x")).alias("i")).collect()]
    assert ids[0].startswith("slot_") and len(ids[0]) == len("slot_") + 16
    assert ids[1] is None


def test_settings_change_only_what_they_name(spark, sf_dir):
    slots, events = catalog._slots(spark, sf_dir), catalog._events(spark, sf_dir)
    capped = replace(catalog.CONSTANT_RATE, max_discount_pct=10)
    job = SnapshotJob(slots, events, (catalog.RUN,), capped)
    assert max(r["action_value"] for r in job.decisions.collect()) <= 10


def test_model_that_does_not_converge_is_refused(spark, sf_dir):
    from openchair.operators import scoring

    job = catalog._job(spark, sf_dir, Settings(model_max_iter=1))
    with pytest.raises(RuntimeError, match="did not converge"):
        scoring.fit_models(job.training, job.training_summary, job.settings)


@pytest.mark.parametrize("name", ["visible_slots", "events_asof", "trailing_window"])
def test_snapshot_bounds_reach_the_scan(spark, sf_dir, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: [^\n]*LessThanOrEqual\(o_orderdate", plan)
