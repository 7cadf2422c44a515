"""Table layouts and vocabularies.

All names and lists in this module are fixed values: they must stay equal to what
existing consumers of these tables expect.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

EVENT_TYPES = ("booked", "canceled", "removed", "completed", "no_show", "rescheduled")
TERMINAL_EVENT_TYPES = ("removed", "completed", "no_show", "rescheduled")

_S, _I, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SLOTS = _schema(
    slot_id=_S,
    provider_id=_S,
    business_id=_S,
    service_id=_S,
    location_id=_S,
    standard_price=_D,
    slot_duration_minutes=_I,
    integration_id=_S,
    external_slot_id=_S,
    source_slot_id=_S,
    source_provider_id=_S,
    source_business_id=_S,
    source_service_id=_S,
    source_location_id=_S,
    slot_start_at=_TS,
    slot_end_at=_TS,
    visible_at=_TS,
    unavailable_at=_TS,
    current_status=_S,
    created_at=_TS,
    source_system=_S,
    source_run_id=_S,
    scenario_id=_S,
    run_id=_S,
    effective_ts=_TS,
    config_hash=_S,
)

BOOKING_EVENTS = _schema(
    event_id=_S,
    slot_id=_S,
    customer_id=_S,
    business_id=_S,
    provider_id=_S,
    service_type=_S,
    source_event_id=_S,
    source_slot_id=_S,
    source_customer_id=_S,
    event_type=_S,
    event_at=_TS,
    source_system=_S,
    source_run_id=_S,
    scenario_id=_S,
    run_id=_S,
    effective_ts=_TS,
)

# Every dimension holds its own id first.
DIMENSIONS = {
    "businesses": _schema(business_id=_S, source_business_id=_S, name=_S, scenario_id=_S),
    "providers": _schema(
        provider_id=_S,
        business_id=_S,
        location_id=_S,
        source_provider_id=_S,
        source_location_id=_S,
        source_business_id=_S,
        name=_S,
        scenario_id=_S,
    ),
    "services": _schema(
        service_id=_S,
        business_id=_S,
        source_service_id=_S,
        source_business_id=_S,
        name=_S,
        duration_minutes=_I,
        scenario_id=_S,
    ),
    "locations": _schema(
        location_id=_S,
        business_id=_S,
        source_location_id=_S,
        source_business_id=_S,
        name=_S,
        scenario_id=_S,
    ),
    "customers": _schema(
        customer_id=_S,
        business_id=_S,
        source_customer_id=_S,
        source_business_id=_S,
        first_name=_S,
        last_name=_S,
        scenario_id=_S,
    ),
}

# Columns that load derives; an input that already carries them breaks the contract.
_SLOT_DERIVED = {"unavailable_at", "current_status", "effective_ts", "config_hash"}
SLOT_REQUIRED = ("slot_id", "provider_id", "business_id", "slot_start_at", "scenario_id", "run_id")
EVENT_REQUIRED = ("event_id", "slot_id", "event_type", "event_at", "scenario_id", "run_id")
SLOT_INPUT_COLUMNS = tuple(c for c in SLOTS.names if c not in _SLOT_DERIVED)
EVENT_INPUT_COLUMNS = tuple(c for c in BOOKING_EVENTS.names if c != "effective_ts")

FEATURE_SNAPSHOT_COLUMNS = (
    "slot_id",
    "feature_snapshot_version",
    "run_id",
    "scenario_id",
    "day_of_week",
    "time_of_day_bucket",
    "service_type",
    "slot_duration_minutes",
    "effective_lead_time_band",
    "hours_until_slot",
    "days_until_slot",
    "hist_fill_rate_similar",
    "fill_rate_provider_service",
    "fill_rate_business_service",
    "expected_booking_pace_per_day",
    "observed_booking_pace_per_day",
    "pace_deviation",
    "avg_lead_time_hours",
    "remaining_provider_slots_same_day",
    "remaining_service_slots_window",
    "inventory_density_2h",
    "provider_utilization_7d",
    "provider_utilization_14d",
    "provider_utilization_28d",
    "booking_volume_7d",
    "booking_volume_14d",
    "booking_volume_28d",
    "cancel_rate_pattern",
    "no_show_rate_pattern",
    "reschedule_rate_pattern",
    "business_fill_trend",
    "business_booking_trend",
    "cohort_fill_rate",
    "cohort_completion_rate",
    "cohort_is_sparse",
)

COHORT_BASELINE_COLUMNS = (
    "cohort_id",
    "day_of_week",
    "time_of_day_bucket",
    "service_type",
    "observation_count",
    "fill_rate",
    "expected_booking_pace_per_day",
    "avg_lead_time_hours",
    "completion_rate",
    "is_sparse",
    "feature_snapshot_version",
    "run_id",
    "scenario_id",
)

UNDERBOOKING_COLUMNS = (
    "slot_id",
    "feature_snapshot_version",
    "run_id",
    "scenario_id",
    "pace_gap",
    "pace_gap_normalized",
    "fill_gap",
    "fill_gap_normalized",
    "severity_score",
    "underbooked",
    "detection_reason",
)

SCORING_COLUMNS = (
    "run_id",
    "slot_id",
    "scenario_id",
    "feature_snapshot_version",
    "business_id",
    "booking_probability",
    "calibrated_booking_probability",
    "predicted_fill_by_start",
    "shortfall_score",
    "confidence_score",
    "score_margin",
    "training_row_count",
    "positive_label_rate",
    "used_fallback",
    "label_definition",
    "feature_contract_hash",
    "model_version",
)

CALIBRATION_COLUMNS = (
    "run_id",
    "scenario_id",
    "feature_snapshot_version",
    "business_id",
    "calibration_factor",
    "training_row_count",
    "positive_label_rate",
    "used_fallback",
    "label_definition",
    "feature_contract_hash",
    "model_version",
)

PRICING_ACTION_COLUMNS = (
    "action_id",
    "slot_id",
    "action_type",
    "action_value",
    "eligible_action_set",
    "decision_reason",
    "was_exploration",
    "exploration_policy",
    "decision_timestamp",
    "feature_snapshot_version",
    "confidence_score",
    "score_margin",
    "rationale_codes",
    "run_id",
    "scenario_id",
)

# Model inputs in their frozen order.
MODEL_FEATURES = (
    "hours_until_slot",
    "hist_fill_rate_similar",
    "fill_rate_provider_service",
    "fill_rate_business_service",
    "expected_booking_pace_per_day",
    "observed_booking_pace_per_day",
    "pace_deviation",
    "provider_utilization_7d",
    "provider_utilization_14d",
    "provider_utilization_28d",
    "business_fill_trend",
    "cohort_fill_rate",
)
LABEL_DEFINITION = "booked_or_completed_as_of_effective_ts_for_started_slots"

METRIC_NAMES = (
    "core_slots_count",
    "feature_snapshot_count",
    "scoring_output_count",
    "pricing_action_count",
    "underbooked_rate",
    "discounted_action_rate",
    "healthy_zero_rate",
    "rationale_coverage",
    "eligible_discount_compliance_rate",
    "discount_shortfall_correlation",
    "low_demand_flag_rate",
    "healthy_overflag_rate",
    "eligible_underbooked_discount_rate",
    "similar_slot_action_consistency",
)

TRAILING_DAYS = (7, 14, 28)


def model_contract_hash() -> str:
    return hashlib.sha256("|".join(MODEL_FEATURES).encode()).hexdigest()[:16]
