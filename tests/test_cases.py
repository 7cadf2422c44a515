"""Semantics on hand-made inputs."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from cases import at, by_slot, events_of, job_of, run_at, slots_of
from pyspark.sql import functions as F

from openchair.functions import calendar
from openchair.operators import availability, evaluation, explorer, history, recommend
from openchair.operators.features import feature_snapshots
from openchair.operators.scoring import validate_features
from openchair.params import Settings

SNAPSHOT = run_at("2026-01-10 00:00:00")


def one_slot(spark, run, events, start="2026-02-01 10:00:00", visible="2026-01-01 10:00:00"):
    slots = slots_of(spark, run, [{"slot_id": "s", "start": start, "visible": visible}])
    return availability.availability(slots, events_of(spark, run, events)).first()


def test_canceled_slot_opens_again(spark):
    row = one_slot(
        spark,
        run_at("2026-01-01 00:00:00"),
        [("s", "booked", "2026-02-01 08:00:00"), ("s", "canceled", "2026-02-01 08:30:00")],
        visible="2026-01-25 10:00:00",
    )
    assert row["current_status"] == "open"
    assert row["unavailable_at"] == at("2026-02-01 10:00:00")


def test_booking_after_cancellation_stands(spark):
    row = one_slot(
        spark,
        SNAPSHOT,
        [
            ("s", "booked", "2026-01-05 08:00:00"),
            ("s", "canceled", "2026-01-06 08:00:00"),
            ("s", "booked", "2026-01-07 08:00:00"),
            ("s", "booked", "2026-01-08 08:00:00"),
        ],
    )
    assert row["current_status"] == "booked"
    assert row["unavailable_at"] == at("2026-01-07 08:00:00")


def test_cancellation_at_the_booking_time_does_not_undo_it(spark):
    row = one_slot(
        spark,
        SNAPSHOT,
        [("s", "booked", "2026-01-05 08:00:00", "b"), ("s", "canceled", "2026-01-05 08:00:00", "a")],
    )
    assert row["unavailable_at"] == at("2026-01-05 08:00:00")
    assert row["current_status"] == "booked"


def test_event_id_decides_between_types_at_one_time(spark):
    events = events_of(
        spark,
        SNAPSHOT,
        [
            ("s", "no_show", "2026-01-05 08:00:00", "e2"),
            ("s", "completed", "2026-01-05 08:00:00", "e3"),
            ("s", "removed", "2026-01-05 08:00:00", "e1"),
        ],
    )
    row = history.event_history(events).first()
    assert row["first_event_type"] == "removed"
    assert row["latest_event_type"] == "completed"


def test_slots_without_events_are_expired_or_open(spark):
    slots = slots_of(
        spark,
        SNAPSHOT,
        [
            {"slot_id": "past", "start": "2026-01-10 00:00:00", "visible": "2026-01-01 00:00:00"},
            {"slot_id": "next", "start": "2026-01-10 00:00:01", "visible": "2026-01-01 00:00:00"},
        ],
    )
    rows = by_slot(availability.availability(slots, events_of(spark, SNAPSHOT, [])))
    assert rows["past"]["current_status"] == "expired"
    assert rows["next"]["current_status"] == "open"
    assert rows["next"]["unavailable_at"] == at("2026-01-10 00:00:01")


def test_availability_uses_later_events_unless_asked_not_to(spark):
    slots = slots_of(
        spark,
        SNAPSHOT,
        [{"slot_id": "s", "start": "2026-02-01 10:00:00", "visible": "2026-01-01 00:00:00"}],
    )
    events = events_of(spark, SNAPSHOT, [("s", "booked", "2026-01-20 00:00:00")])
    assert availability.availability(slots, events).first()["current_status"] == "booked"
    assert availability.availability(slots, events, asof=True).first()["current_status"] == "open"


@pytest.mark.parametrize(
    "time, label", [("11:59", "00-12"), ("12:00", "12-17"), ("17:00", "17-24"), ("00:00", "00-12")]
)
def test_bucket_edges(spark, time, label):
    ts = calendar.instant(f"2026-01-05 {time}:00")
    df = spark.range(1).select(calendar.time_bucket(ts, (0, 12, 17, 24)).alias("b"))
    assert df.first()["b"] == label


def test_bucket_boundaries_out_of_range_are_dropped(spark):
    ts = calendar.instant("2026-01-05 23:00:00")
    df = spark.range(1).select(calendar.time_bucket(ts, (-3, 8, 40)).alias("b"))
    assert df.first()["b"] == "08-24"


@pytest.mark.parametrize(
    "hours, band",
    [(-5, "lt_24h"), (24, "lt_24h"), (24.01, "24_72h"), (72, "24_72h"), (168, "72_168h"), (169, "gt_168h")],
)
def test_lead_bands_are_closed_on_the_right(spark, hours, band):
    df = spark.range(1).select(calendar.lead_time_band(F.lit(float(hours))).alias("b"))
    assert df.first()["b"] == band


def test_later_completion_does_not_leak(spark):
    job = job_of(
        spark,
        SNAPSHOT,
        [{"slot_id": "s", "start": "2026-01-09 10:00:00", "visible": "2026-01-05 00:00:00"}],
        [("s", "booked", "2026-01-09 09:00:00"), ("s", "completed", "2026-01-10 01:00:00")],
    )
    row = job.baselines.first()
    assert row["completion_rate"] == 0.0
    assert row["fill_rate"] == 1.0
    assert row["is_sparse"]


def test_event_at_the_snapshot_counts(spark):
    job = job_of(
        spark,
        SNAPSHOT,
        [{"slot_id": "s", "start": "2026-01-12 10:00:00", "visible": "2026-01-05 00:00:00"}],
        [("s", "booked", "2026-01-10 00:00:00")],
    )
    assert job.base.first()["booked_flag"] == 1


def test_trailing_windows(spark):
    job = job_of(
        spark,
        SNAPSHOT,
        [
            {"slot_id": "d1", "start": "2026-01-09 10:00:00", "visible": "2026-01-01 00:00:00"},
            {"slot_id": "d10", "start": "2025-12-31 10:00:00", "visible": "2025-12-20 00:00:00"},
            {"slot_id": "d20", "start": "2025-12-21 10:00:00", "visible": "2025-12-10 00:00:00"},
        ],
        [
            ("d1", "booked", "2026-01-09 09:00:00"),
            ("d10", "booked", "2025-12-30 09:00:00"),
            ("d20", "booked", "2025-12-20 09:00:00"),
        ],
    )
    row = feature_snapshots(job.features).first()
    assert [row[f"provider_utilization_{d}d"] for d in (7, 14, 28)] == [1.0, 1.0, 1.0]
    assert [row[f"booking_volume_{d}d"] for d in (7, 14, 28)] == [1.0, 2.0, 3.0]


def test_remaining_slots_count_only_the_future(spark):
    run = run_at("2026-01-10 10:00:00")
    job = job_of(
        spark,
        run,
        [
            {"slot_id": "a", "start": "2026-01-10 08:00:00", "visible": "2026-01-01 00:00:00"},
            {"slot_id": "b", "start": "2026-01-10 12:00:00", "visible": "2026-01-01 00:00:00"},
        ],
        [],
    )
    rows = by_slot(job.features)
    assert rows["a"]["remaining_provider_slots_same_day"] == 0
    assert rows["b"]["remaining_provider_slots_same_day"] == 1
    assert rows["a"]["remaining_service_slots_window"] == 0
    assert rows["b"]["remaining_service_slots_window"] == 1


def test_density_window_is_inclusive_and_crosses_midnight(spark):
    starts = {
        "a": "2026-01-11 22:30:00",
        "b": "2026-01-12 00:30:00",
        "c": "2026-01-12 02:30:00",
        "d": "2026-01-12 02:31:00",
    }
    job = job_of(
        spark,
        SNAPSHOT,
        [{"slot_id": k, "start": v, "visible": "2026-01-01 00:00:00"} for k, v in starts.items()],
        [],
    )
    rows = by_slot(job.features)
    density = {k: r["inventory_density_2h"] for k, r in rows.items()}
    assert density == {"a": 2.0, "b": 3.0, "c": 3.0, "d": 2.0}


def test_sparse_cohort_takes_the_configured_rate(spark):
    settings = Settings(sparse_baseline_fill_rate=0.8, underbooking_threshold=0.2)
    job = job_of(
        spark,
        SNAPSHOT,
        [{"slot_id": "s", "start": "2026-01-10 12:00:00", "visible": "2026-01-09 00:00:00"}],
        [],
        settings,
    )
    row = job.flagged.first()
    assert row["detection_reason"] == "sparse_cohort_fallback"
    assert row["pace_gap"] == 0.0
    assert row["fill_gap"] == pytest.approx(0.8)
    assert row["severity_score"] == pytest.approx(0.4)
    assert row["underbooked"]


def test_missing_baselines_fall_back(spark):
    job = job_of(
        spark,
        SNAPSHOT,
        [{"slot_id": "s", "start": "2026-01-12 12:00:00", "visible": "2026-01-09 00:00:00"}],
        [("s", "booked", "2026-01-09 12:00:00")],
    )
    from openchair.operators.features import build_features

    none = job.baselines.where("false")
    row = build_features(job.base, Settings(), baselines=none).first()
    assert row["cohort_fill_rate"] == row["hist_fill_rate_similar"] == 1.0
    assert row["expected_booking_pace_per_day"] == row["observed_booking_pace_per_day"]
    assert row["avg_lead_time_hours"] == row["lead_time_hours"] == 72.0
    assert row["cohort_completion_rate"] == 0.0
    assert row["cohort_is_sparse"]


def test_null_service_forms_a_cohort_but_no_history(spark):
    slots = [
        {"slot_id": f"s{i}", "start": "2026-01-05 12:00:00", "visible": "2026-01-01 00:00:00", "service_id": None}
        for i in range(3)
    ]
    job = job_of(spark, SNAPSHOT, slots, [("s0", "booked", "2026-01-02 00:00:00")])
    row = by_slot(job.features)["s0"]
    assert row["cohort_fill_rate"] == pytest.approx(1 / 3)
    assert row["hist_fill_rate_similar"] is None
    assert row["inventory_density_2h"] == 0.0
    assert job.training.count() == 0


FALLBACK_SLOTS = [
    {"slot_id": "past", "start": "2026-01-08 10:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "future", "start": "2026-01-11 10:00:00", "visible": "2026-01-01 00:00:00"},
]
FALLBACK_EVENTS = [
    ("past", "booked", "2026-01-07 10:00:00"),
    ("future", "booked", "2026-01-10 12:00:00"),
]


def test_scoring_fallback(spark):
    settings = Settings(training_min_rows=5, sparse_baseline_fill_rate=0.7)
    job = job_of(spark, SNAPSHOT, FALLBACK_SLOTS, FALLBACK_EVENTS, settings)
    (row,) = job.scored.collect()
    assert row["slot_id"] == "future"
    assert row["training_row_count"] == 1
    assert row["used_fallback"]
    assert row["booking_probability"] == 1.0
    assert row["calibration_factor"] == 1.0
    assert row["severity_score"] == pytest.approx(0.4)
    assert row["shortfall_score"] == 0.0
    assert row["confidence_score"] == 1.0
    assert row["predicted_fill_by_start"] == pytest.approx(0.5)


def test_no_history_gives_even_odds(spark):
    job = job_of(spark, SNAPSHOT, FALLBACK_SLOTS[1:], [])
    row = job.scored.first()
    assert (row["booking_probability"], row["training_row_count"]) == (0.5, 0)
    assert row["used_fallback"]


def test_slot_at_the_snapshot_is_scored_and_not_trained_on(spark):
    slots = [{"slot_id": "s", "start": "2026-01-10 00:00:00", "visible": "2026-01-01 00:00:00"}]
    job = job_of(spark, SNAPSHOT, slots, [])
    assert job.training.count() == 0
    assert [r["slot_id"] for r in job.scored.collect()] == ["s"]


def test_lead_time_limit_blocks_discounts(spark):
    settings = Settings(
        action_ladder=(0, 5, 10),
        max_discount_lead_time_hours=12,
        discount_steps=(5, 10, 10),
        severity_breakpoints=(0.2, 0.4),
        healthy_zero_only=False,
        training_min_rows=5,
    )
    job = job_of(spark, SNAPSHOT, FALLBACK_SLOTS, FALLBACK_EVENTS, settings)
    row = recommend.pricing_actions(job.decisions).first()
    assert row["action_value"] == 0.0
    assert row["eligible_action_set"] == "[0]"


def test_excluded_service_gets_nothing(spark):
    settings = Settings(excluded_services=("svc1",), price_floor_pct=0.95, training_min_rows=5)
    job = job_of(spark, SNAPSHOT, FALLBACK_SLOTS, FALLBACK_EVENTS, settings)
    assert {r["action_value"] for r in job.decisions.collect()} == {0.0}


def test_price_floor_at_exact_equality_is_allowed(spark):
    settings = Settings(price_floor_pct=0.9)
    rows = spark.createDataFrame([("svc", 10.0, 100.0)], "service_id string, hours_until_slot double, standard_price double")
    assert rows.select(recommend.eligible_actions(settings).alias("e")).first()["e"] == [0, 5, 10]


@pytest.mark.parametrize(
    "severity, step", [(0.0, 5), (0.2, 5), (0.2000001, 10), (0.4, 10), (0.7, 15), (0.9, 20), (None, 5)]
)
def test_severity_steps(spark, severity, step):
    rows = spark.createDataFrame(
        [(True, severity, None)], "underbooked boolean, shortfall_score double, severity_score double"
    )
    assert rows.select(recommend.target_discount(Settings()).alias("t")).first()["t"] == step


EXPLORE_SLOTS = [
    {"slot_id": "a", "start": "2026-01-12 12:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "b", "start": "2026-01-11 09:00:00", "visible": "2026-01-01 00:00:00"},
    {"slot_id": "past", "start": "2026-01-09 09:00:00", "visible": "2026-01-01 00:00:00"},
]
EXPLORE_EVENTS = [
    ("past", "booked", "2026-01-08 08:00:00"),
    ("past", "completed", "2026-01-09 10:00:00"),
]


def test_decisions_repeat_exactly(spark):
    settings = Settings(exploration_share=0.6, random_seed=123, price_floor_pct=0.8)

    def decide():
        job = job_of(spark, SNAPSHOT, EXPLORE_SLOTS, EXPLORE_EVENTS, settings)
        return sorted(recommend.pricing_actions(job.decisions).collect())

    first = decide()
    assert first == decide()
    assert [r["slot_id"] for r in sorted(first, key=lambda r: r["slot_id"])] == ["a", "b"]
    for row in first:
        assert json.loads(row["rationale_codes"])
        assert int(row["action_value"]) in json.loads(row["eligible_action_set"])


def exploring_rows(spark, n=4000):
    rows = spark.range(n).select(
        F.concat(F.lit("slot_"), "id").alias("slot_id"),
        F.lit("run").alias("run_id"),
        F.lit(True).alias("underbooked"),
        F.array(*[F.lit(v) for v in (0, 5, 10)]).alias("eligible"),
        F.lit(5).alias("chosen"),
    )
    return recommend.explore(rows, Settings(exploration_share=0.3))


def test_exploration_share_and_choice(spark):
    rows = exploring_rows(spark).collect()
    explored = [r for r in rows if r["was_exploration"]]
    assert abs(len(explored) / len(rows) - 0.3) < 0.03
    picks = [r["final_discount"] for r in explored]
    assert set(picks) == {0, 10}
    assert abs(picks.count(0) / len(picks) - 0.5) < 0.06
    assert {r["final_discount"] for r in rows if not r["was_exploration"]} == {5}


def rationale_of(spark, settings=Settings(), **values):
    row = {
        "underbooked": True,
        "hours_until_slot": 12.0,
        "provider_utilization_7d": 0.2,
        "day_of_week": "tue",
        "time_of_day_bucket": "afternoon",
        "pace_deviation": -0.3,
        "final_discount": 15,
    } | values
    df = spark.createDataFrame([tuple(row.values())], list(row))
    return recommend.add_rationale(df, settings).first()["rationale"]


def test_rationale_evidence_is_sorted(spark):
    assert rationale_of(spark) == [
        "booking_pace_below_baseline",
        "historically_underbooked_weekday_afternoon",
        "provider_utilization_below_target",
        "short_lead_time_low_fill",
    ]


CALM = {
    "hours_until_slot": 100.0,
    "provider_utilization_7d": 0.8,
    "day_of_week": "sun",
    "pace_deviation": 0.2,
    "final_discount": 0,
}


def test_rationale_general_codes(spark):
    assert rationale_of(spark, **CALM, underbooked=False) == ["healthy_slot_no_discount"]
    assert rationale_of(spark, **CALM) == ["underbooked_slot_flagged"]
    discounted = CALM | {"final_discount": 5}
    assert rationale_of(spark, **discounted, underbooked=False) == ["discount_applied"]


def test_weekday_afternoon_needs_mapped_labels(spark):
    full = {"day_of_week": "Tuesday", "time_of_day_bucket": "12-17"}
    code = "historically_underbooked_weekday_afternoon"
    assert code not in rationale_of(spark, **full)
    mapped = replace(Settings(), weekday_labels=("Tuesday",), afternoon_labels=("12-17",))
    assert code in rationale_of(spark, mapped, **full)


def test_sorting_and_ties(spark):
    rows = spark.createDataFrame(
        [("s1", 0.6, 10.0), ("s2", 0.8, 5.0), ("s3", 0.8, 20.0), ("s4", None, 1.0)],
        "slot_id string, severity_score double, recommended_discount double",
    )

    def order(**options):
        return [r["slot_id"] for r in explorer.sort_recommendations(rows, **options).collect()]

    assert order() == ["s3", "s2", "s1", "s4"]
    assert order(sort_field="unknown") == ["s3", "s2", "s1", "s4"]
    assert order(sort_field="recommended_discount", descending=False) == ["s4", "s2", "s1", "s3"]


def test_constant_discounts_have_no_correlation(spark):
    job = job_of(spark, SNAPSHOT, EXPLORE_SLOTS, EXPLORE_EVENTS, Settings(training_min_rows=5))
    slots = job.slots
    metrics = {
        r["metric_name"]: r["metric_value"]
        for r in evaluation.evaluation(slots, job.flagged, job.scored, job.decisions).collect()
    }
    assert len(metrics) == 14
    assert metrics["core_slots_count"] == 3
    assert metrics["discount_shortfall_correlation"] == 0.0
    assert metrics["eligible_discount_compliance_rate"] == 1.0
    assert metrics["similar_slot_action_consistency"] == 1.0


def test_settings_and_feature_contract_are_checked(spark):
    with pytest.raises(ValueError):
        Settings(exploration_share=1.5)
    with pytest.raises(ValueError):
        Settings(discount_steps=(5, 10))
    with pytest.raises(ValueError, match="missing required scoring features"):
        validate_features(spark.range(1))
    assert Settings(action_ladder=(10, 5, 50, 5)).ladder == (0, 5, 10)
