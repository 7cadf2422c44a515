"""Read-side queries over recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openchair.params import RUN_KEY

RECOMMENDATION_COLUMNS = (
    *RUN_KEY,
    "slot_id",
    "business_id",
    "provider_id",
    "service_id",
    "effective_lead_time_band",
    "underbooked",
    "severity_score",
    "recommended_discount",
    "standard_price",
    "implied_price",
    "rationale_codes",
    "was_exploration",
)


def matching(
    business_id: str | None = None,
    provider_id: str | None = None,
    service_id: str | None = None,
    lead_time_band: str | None = None,
    discounted_only: bool = False,
    exploration_only: bool = False,
) -> Column:
    """Conjunction of the filters that are set."""
    condition = F.lit(True)
    wanted = {
        "business_id": business_id,
        "provider_id": provider_id,
        "service_id": service_id,
        "effective_lead_time_band": lead_time_band,
    }
    for column, value in wanted.items():
        if value:
            condition = condition & (F.col(column) == value)
    if discounted_only:
        condition = condition & (F.col("action_value") > 0)
    if exploration_only:
        condition = condition & F.col("was_exploration")
    return condition


def recommendations(decisions: DataFrame, **filters) -> DataFrame:
    """One row per action with slot, severity and the price after the discount."""
    price = F.col("standard_price") * (F.lit(1) - F.col("action_value") / F.lit(100.0))
    return (
        decisions.where(matching(**filters))
        .withColumns(
            {
                "recommended_discount": F.col("action_value"),
                "implied_price": F.floor(price * 100 + F.lit(0.5)).cast("double") / F.lit(100.0),
            }
        )
        .select(*RECOMMENDATION_COLUMNS)
    )


def sort_recommendations(
    rows: DataFrame, sort_field: str = "severity_score", descending: bool = True
) -> DataFrame:
    """Order by severity or discount; ties by larger discount, then slot id."""
    field = sort_field if sort_field == "recommended_discount" else "severity_score"
    first = F.desc_nulls_last(field) if descending else F.asc_nulls_last(field)
    return rows.orderBy(first, F.desc("recommended_discount"), F.asc("slot_id"))


def top_recommendations(rows: DataFrame, k: int, **order) -> DataFrame:
    """The first ``k`` rows of the sorted list; Spark keeps ``k`` rows per task only."""
    return sort_recommendations(rows, **order).limit(k)


def severity_distribution(flagged: DataFrame) -> DataFrame:
    severity = F.col("severity_score")
    band = (
        F.when(severity < 0.25, "0.00-0.24")
        .when(severity < 0.50, "0.25-0.49")
        .when(severity < 0.75, "0.50-0.74")
        .otherwise("0.75-1.00")
    )
    return (
        flagged.groupBy(*RUN_KEY, band.alias("severity_band"))
        .agg(F.count("*").alias("slot_count"))
        .orderBy("severity_band")
    )


def _counts(decisions: DataFrame, key: Column, filters: dict) -> DataFrame:
    return (
        decisions.where(matching(**filters))
        .groupBy(*RUN_KEY, key)
        .agg(F.count("*").alias("recommendation_count"))
    )


def summary_by_action(decisions: DataFrame, **filters) -> DataFrame:
    counts = _counts(decisions, F.col("action_value").alias("action_bucket"), filters)
    return counts.orderBy("action_bucket")


def summary_by_provider(decisions: DataFrame, **filters) -> DataFrame:
    counts = _counts(decisions, F.col("provider_id"), filters)
    return counts.orderBy(F.desc("recommendation_count"), "provider_id")


def summary_by_service(decisions: DataFrame, **filters) -> DataFrame:
    counts = _counts(decisions, F.col("service_id"), filters)
    return counts.orderBy(F.desc("recommendation_count"), "service_id")


def summary_by_lead_band(decisions: DataFrame, **filters) -> DataFrame:
    """Counts per lead-time band; actions without features have no band and are left out."""
    banded = decisions.where(F.col("effective_lead_time_band").isNotNull())
    counts = _counts(banded, F.col("effective_lead_time_band"), filters)
    return counts.orderBy("effective_lead_time_band")
