from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.functions.numbers import at_least, at_most, clamp, one_if_zero
from openchair.params import Settings
from openchair.schemas import UNDERBOOKING_COLUMNS

# Hours over which urgency rises and the weights of the projected fill.
HORIZON_HOURS = 168.0
PACE_SHARE, HISTORY_SHARE = 0.7, 0.3


def add_underbooking(features: DataFrame, settings: Settings) -> DataFrame:
    """Gaps, severity, flag and reason beside the feature columns. Row-local, no shuffle."""
    hours = F.col("hours_until_slot")
    expected_pace = F.col("expected_booking_pace_per_day")
    observed_pace = F.col("observed_booking_pace_per_day")
    sparse = F.coalesce("cohort_is_sparse", F.lit(True))

    pace_gap = at_least(expected_pace - observed_pace, 0.0)
    urgency = F.coalesce(
        F.lit(1.0) - clamp(hours / F.lit(HORIZON_HOURS), 0.0, 1.0), F.lit(1.0)
    )
    from_pace = at_most(observed_pace * (at_least(hours, 0.0) / F.lit(24.0)), 1.0)
    blended = clamp(
        F.lit(PACE_SHARE) * from_pace + F.lit(HISTORY_SHARE) * F.col("hist_fill_rate_similar"),
        0.0,
        1.0,
    )
    cohort_fill = F.coalesce("cohort_fill_rate", F.lit(0.0))
    projected = blended * urgency + cohort_fill * (F.lit(1.0) - urgency)
    expected_fill = F.when(sparse, F.lit(settings.sparse_baseline_fill_rate)).otherwise(
        F.col("cohort_fill_rate")
    )

    gaps = features.withColumns(
        {
            "pace_gap": pace_gap,
            "pace_gap_normalized": F.coalesce(
                pace_gap / one_if_zero(expected_pace), F.lit(0.0)
            ),
            "_expected_fill": expected_fill,
            "fill_gap": at_least(expected_fill - projected, 0.0),
        }
    ).withColumn(
        "fill_gap_normalized",
        F.coalesce(F.col("fill_gap") / one_if_zero(F.col("_expected_fill")), F.lit(0.0)),
    )
    severity = clamp(
        F.lit(settings.pace_weight) * F.col("pace_gap_normalized")
        + F.lit(settings.fill_weight) * F.col("fill_gap_normalized"),
        0.0,
        1.0,
    )
    behind_pace = F.col("pace_gap_normalized") > 0
    behind_fill = F.col("fill_gap_normalized") > 0
    reason = (
        F.when(sparse, "sparse_cohort_fallback")
        .when(behind_pace & behind_fill, "pace_gap_and_fill_gap")
        .when(behind_pace, "pace_gap")
        .when(behind_fill, "fill_gap")
        .otherwise("healthy")
    )
    return (
        gaps.withColumn("severity_score", severity)
        .withColumns(
            {
                "underbooked": F.col("severity_score") >= settings.underbooking_threshold,
                "detection_reason": reason,
            }
        )
        .drop("_expected_fill")
    )


def underbooking_outputs(flagged: DataFrame) -> DataFrame:
    return flagged.select(*UNDERBOOKING_COLUMNS)
