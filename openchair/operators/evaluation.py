"""Evaluation metrics and run summaries, long form and one row per run and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from openchair.functions.numbers import correlation, share
from openchair.params import RUN_KEY
from openchair.schemas import METRIC_NAMES

SIMILAR_KEY = ("provider_id", "service_id", "time_of_day_bucket")
EMPTY_VALUES = {"similar_slot_action_consistency": 1.0}


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.unpivot(list(RUN_KEY), names, "metric_name", "metric_value")


def _metrics(df: DataFrame, **values: Column) -> DataFrame:
    """One conditional aggregate over the table, turned into metric rows."""
    wide = df.groupBy(*RUN_KEY).agg(*[v.cast("double").alias(n) for n, v in values.items()])
    return _long(wide, list(values))


def similar_slot_groups(decisions: DataFrame) -> DataFrame:
    """Mean and spread of the discounts of alike slots, for groups of at least two."""
    return (
        decisions.groupBy(*RUN_KEY, *SIMILAR_KEY)
        .agg(
            F.avg("action_value").alias("avg_action"),
            F.stddev_samp("action_value").alias("std_action"),
            F.count("*").alias("n"),
        )
        .where(F.col("n") >= 2)
    )


def similar_slot_consistency(decisions: DataFrame) -> DataFrame:
    mean, spread = F.col("avg_action"), F.coalesce("std_action", F.lit(0.0))
    steady = F.when(spread == 0, 1.0).otherwise(0.0)
    score = F.when(mean == 0, steady).otherwise(F.greatest(F.lit(0.0), 1.0 - spread / mean))
    return _metrics(
        similar_slot_groups(decisions), similar_slot_action_consistency=F.avg(score)
    )


def evaluation(
    slots: DataFrame, flagged: DataFrame, scores: DataFrame, decisions: DataFrame
) -> DataFrame:
    """All metrics of every run that has slots.

    ``slots`` is the whole slot table, ``flagged`` the feature rows with underbooking,
    ``scores`` the scored rows and ``decisions`` the decided rows (or ``decision_view`` over
    stored tables). The metric rows of each input are merged, so nothing is joined.
    """
    gap, under = F.col("pace_gap_normalized"), F.col("underbooked")
    discount = F.col("action_value")
    healthy = ~F.coalesce("underbooked", F.lit(False))
    complies = F.array_contains("eligible", discount.cast("int"))
    discounted = discount > 0
    counts = _metrics(slots, core_slots_count=F.count("*"))
    defaults = counts.select(
        *RUN_KEY,
        F.explode(F.array(*[F.lit(n) for n in METRIC_NAMES])).alias("metric_name"),
        F.lit(None).cast("double").alias("metric_value"),
    )
    flags = _metrics(
        flagged,
        feature_snapshot_count=F.count("*"),
        underbooked_rate=share(under),
        low_demand_flag_rate=share((gap >= 0.30) & under),
        healthy_overflag_rate=share((gap <= 0.05) & under),
    )
    actions = _metrics(
        decisions,
        pricing_action_count=F.count("*"),
        discounted_action_rate=share(discounted),
        healthy_zero_rate=share(healthy & (discount == 0)),
        rationale_coverage=share(F.size("rationale") > 0),
        eligible_discount_compliance_rate=share(complies),
        eligible_underbooked_discount_rate=share(under & complies & discounted),
    )
    drift = _metrics(
        decisions.where(discounted & F.col("shortfall_score").isNotNull()),
        discount_shortfall_correlation=correlation(discount, F.col("shortfall_score")),
    )
    merged = (
        defaults.unionByName(counts)
        .unionByName(_metrics(scores, scoring_output_count=F.count("*")))
        .unionByName(flags)
        .unionByName(actions)
        .unionByName(drift)
        .unionByName(similar_slot_consistency(decisions))
    )
    empty = F.lit(0.0)
    for name, value in EMPTY_VALUES.items():
        empty = F.when(F.col("metric_name") == name, F.lit(value)).otherwise(empty)
    return (
        merged.groupBy(*RUN_KEY, "metric_name")
        .agg(F.max("metric_value").alias("metric_value"))
        .withColumn("metric_value", F.coalesce("metric_value", empty))
    )


def metrics_of_run(results: DataFrame, scenario_id: str, run_id: str) -> DataFrame:
    """Stored metrics of one run."""
    wanted = (F.col("scenario_id") == scenario_id) & (F.col("run_id") == run_id)
    return results.where(wanted).select("metric_name", "metric_value")


def run_summary(
    slots: DataFrame, flagged: DataFrame, scores: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Counts per run and the observed exploration share."""
    parts = [
        _metrics(slots, total_slots=F.count("*")),
        _metrics(flagged, underbooked_slots=F.count_if("underbooked")),
        _metrics(scores, scored_slots=F.count("*")),
        _metrics(
            decisions,
            pricing_actions=F.count("*"),
            exploration_share_observed=share(F.col("was_exploration")),
        ),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)

    def value(name: str) -> Column:
        picked = F.max(F.when(F.col("metric_name") == name, F.col("metric_value")))
        return F.coalesce(picked, F.lit(0.0))

    names = ("total_slots", "underbooked_slots", "scored_slots", "pricing_actions")
    return merged.groupBy(*RUN_KEY).agg(
        *[value(n).cast("bigint").alias(n) for n in names],
        value("exploration_share_observed").alias("exploration_share_observed"),
    )


def latest_runs(slots: DataFrame) -> DataFrame:
    """Runs present in the slot table, newest snapshot first."""
    return (
        slots.groupBy(*RUN_KEY)
        .agg(F.max("effective_ts").alias("effective_ts"), F.count("*").alias("slot_count"))
        .orderBy(F.desc("effective_ts"), "run_id")
    )
