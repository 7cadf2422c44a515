"""One bounded discount per open future slot. Row-local column expressions throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openchair.functions import ids, text
from openchair.params import SLOT_KEY, VERSIONED_SLOT_KEY, Settings
from openchair.schemas import PRICING_ACTION_COLUMNS

# Policy names, reasons and rationale codes (codes in sorted order).
POLICY_NONE = "none"
POLICY_EXPLORE = "epsilon_greedy_deterministic"
REASON_EXPLORE = "exploration_override"
REASON_UNDERBOOKED = "underbooked_optimizer"
REASON_HEALTHY = "healthy_no_discount"
CODE_PACE = "booking_pace_below_baseline"
CODE_AFTERNOON = "historically_underbooked_weekday_afternoon"
CODE_UTILIZATION = "provider_utilization_below_target"
CODE_SHORT_LEAD = "short_lead_time_low_fill"
CODE_FLAGGED = "underbooked_slot_flagged"
CODE_DISCOUNT = "discount_applied"
CODE_HEALTHY = "healthy_slot_no_discount"

_SCORE_COLUMNS = ("shortfall_score", "score_margin", "confidence_score")


def decision_input(
    slots: DataFrame,
    features: DataFrame,
    underbooking: DataFrame,
    scores: DataFrame,
    key: Sequence[str] = VERSIONED_SLOT_KEY,
) -> DataFrame:
    """Join the stored tables of a run into one row per open future slot.

    All four tables are unique per slot and version, so every join shuffles evenly. A job
    that has just computed the features needs no join: the scored rows carry all columns.
    Tables that hold a single run may be joined on ``slot_id`` alone, which keeps their buckets.
    """
    slot_key = [name for name in key if name in SLOT_KEY]
    chosen = (F.col("current_status") == "open") & (
        F.col("slot_start_at") >= F.col("effective_ts")
    )
    slot_part = slots.where(chosen).select(
        *slot_key,
        "effective_ts",
        "business_id",
        "provider_id",
        "service_id",
        "standard_price",
        "slot_start_at",
    )
    feature_part = features.select(
        *key,
        "hours_until_slot",
        "provider_utilization_7d",
        "day_of_week",
        "time_of_day_bucket",
        "effective_lead_time_band",
        "pace_deviation",
    )
    flag_part = underbooking.select(*key, "underbooked", "severity_score", "pace_gap_normalized")
    return (
        slot_part.join(feature_part, slot_key)
        .join(flag_part, list(key), "left")
        .join(scores.select(*key, *_SCORE_COLUMNS), list(key), "left")
    )


def eligible_actions(settings: Settings) -> Column:
    """Ladder steps the rules allow, ascending; never empty."""
    price = F.col("standard_price")
    allowed_service = ~F.coalesce(
        F.col("service_id").isin(list(settings.excluded_services)), F.lit(False)
    )
    near_enough = ~F.coalesce(
        F.col("hours_until_slot") > settings.max_discount_lead_time_hours, F.lit(False)
    )
    steps = []
    for step in settings.ladder:
        above_floor = price * F.lit(1 - step / 100.0) >= price * F.lit(settings.price_floor)
        allowed = above_floor if step == 0 else allowed_service & near_enough & above_floor
        steps.append(F.when(allowed, F.lit(step)))
    kept = F.array_compact(F.array(*steps))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(0)))


def target_discount(settings: Settings) -> Column:
    """Step wanted by severity: the first breakpoint not below it, else the last step."""
    severity = F.coalesce("shortfall_score", "severity_score", F.lit(0.0))
    step = F.lit(settings.discount_steps[-1])
    pairs = list(zip(settings.severity_breakpoints, settings.discount_steps))
    for limit, discount in reversed(pairs):
        step = F.when(severity <= limit, F.lit(discount)).otherwise(step)
    if settings.healthy_zero_only:
        step = F.when(~F.col("underbooked"), F.lit(0)).otherwise(step)
    return step


def choose_discount(rows: DataFrame, settings: Settings) -> DataFrame:
    """``eligible`` steps, the ``target`` and the largest eligible step up to it."""
    rows = rows.withColumn("underbooked", F.coalesce("underbooked", F.lit(False))).withColumns(
        {"eligible": eligible_actions(settings), "target": target_discount(settings)}
    )
    within = F.filter("eligible", lambda step: step <= F.col("target"))
    return rows.withColumn("chosen", F.coalesce(F.array_max(within), F.array_min("eligible")))


def explore(rows: DataFrame, settings: Settings) -> DataFrame:
    """Replace a share of the choices by another eligible step, the same one on every run."""
    gate, pick = ids.uniform_draws(
        F.lit(str(settings.random_seed)), F.col("run_id"), F.col("slot_id")
    )
    open_choice = F.col("underbooked") & (F.size("eligible") > 1)
    explored = open_choice & (gate < settings.exploration_share)
    others = F.filter("eligible", lambda step: step != F.col("chosen"))
    position = (F.floor(pick * F.size(others)) + 1).cast("int")
    reason = (
        F.when(F.col("was_exploration"), REASON_EXPLORE)
        .when(F.col("underbooked"), REASON_UNDERBOOKED)
        .otherwise(REASON_HEALTHY)
    )
    return (
        rows.withColumn("was_exploration", explored)
        .withColumn(
            "final_discount",
            F.when(explored, F.get(others, position - 1)).otherwise(F.col("chosen")),
        )
        .withColumns(
            {
                "exploration_policy": F.when(
                    F.col("was_exploration"), POLICY_EXPLORE
                ).otherwise(POLICY_NONE),
                "decision_reason": reason,
            }
        )
    )


def add_rationale(rows: DataFrame, settings: Settings) -> DataFrame:
    """Sorted evidence codes; a single general code where no evidence applies."""
    flagged, discounted = F.col("underbooked"), F.col("final_discount") > 0
    afternoon = F.col("day_of_week").isin(list(settings.weekday_labels)) & F.col(
        "time_of_day_bucket"
    ).isin(list(settings.afternoon_labels))
    utilization = F.coalesce("provider_utilization_7d", F.lit(0.0))
    evidence = F.array_compact(
        F.array(
            F.when(flagged & (F.col("pace_deviation") < 0), CODE_PACE),
            F.when(flagged & discounted & afternoon, CODE_AFTERNOON),
            F.when(flagged & (utilization < 0.5), CODE_UTILIZATION),
            F.when(flagged & (F.col("hours_until_slot") <= 24), CODE_SHORT_LEAD),
        )
    )
    general = F.when(flagged, CODE_FLAGGED).when(discounted, CODE_DISCOUNT).otherwise(CODE_HEALTHY)
    return rows.withColumn(
        "rationale", F.when(F.size(evidence) > 0, evidence).otherwise(F.array(general))
    )


def decide(rows: DataFrame, settings: Settings) -> DataFrame:
    """All decision columns beside the input rows (``decision_input`` or scored rows)."""
    chosen = add_rationale(explore(choose_discount(rows, settings), settings), settings)
    confidence = F.coalesce("confidence_score", F.lit(0.0))
    return chosen.withColumns(
        {
            "action_id": ids.stable_id(
                "act", F.col("run_id"), F.col("feature_snapshot_version"), F.col("slot_id")
            ),
            "action_type": F.lit("discount_pct"),
            "action_value": F.col("final_discount").cast("double"),
            "eligible_action_set": text.number_list(F.array_sort(F.array_distinct("eligible"))),
            "rationale_codes": text.string_list(F.col("rationale")),
            "decision_timestamp": F.col("effective_ts"),
            "score_margin": F.coalesce("score_margin", confidence),
            "confidence_score": confidence,
        }
    )


def pricing_actions(decisions: DataFrame) -> DataFrame:
    return decisions.select(*PRICING_ACTION_COLUMNS)


def decision_view(
    actions: DataFrame,
    slots: DataFrame,
    features: DataFrame,
    underbooking: DataFrame,
    scores: DataFrame,
    key: Sequence[str] = VERSIONED_SLOT_KEY,
) -> DataFrame:
    """Rebuild the columns evaluation and explorer read from stored tables of earlier runs."""
    key = list(key)
    slot_key = [name for name in key if name in SLOT_KEY]
    slot_part = slots.select(
        *slot_key, "business_id", "provider_id", "service_id", "standard_price"
    )
    parsed = actions.withColumns(
        {
            "eligible": F.from_json("eligible_action_set", "array<int>"),
            "rationale": F.from_json("rationale_codes", "array<string>"),
        }
    )
    flag_part = underbooking.select(*key, "underbooked", "severity_score", "pace_gap_normalized")
    return (
        parsed.join(slot_part, slot_key)
        .join(
            features.select(*key, "effective_lead_time_band", "time_of_day_bucket"), key, "left"
        )
        .join(flag_part, key, "left")
        .join(scores.select(*key, "shortfall_score"), key, "left")
    )
