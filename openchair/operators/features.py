"""The feature snapshot of every visible slot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from openchair.operators.baselines import (
    CELL_KEY,
    COHORT_KEY,
    PATTERN_EVENTS,
    cohort_baselines,
    slot_cells,
)
from openchair.operators.joins import attach
from openchair.params import RUN_KEY, Settings
from openchair.schemas import FEATURE_SNAPSHOT_COLUMNS, TRAILING_DAYS

DAY_MICROS = 86_400_000_000
DENSITY_MICROS = 2 * 3_600_000_000

Stage = Callable[[DataFrame, str], DataFrame]


def no_stage(df: DataFrame, label: str) -> DataFrame:
    return df


def _rate(part: str, name: str) -> str:
    return f"sum({part}) / sum(n_slots) AS {name}"


def _provider_measures() -> list[str]:
    measures = []
    for days in TRAILING_DAYS:
        started, kept = f"sum(n_started_{days}d)", f"sum(n_kept_{days}d)"
        measures += [
            f"IF({started} > 0, {kept} / {started}, 0.0D) AS provider_utilization_{days}d",
            f"CAST(sum(n_fresh_{days}d) AS DOUBLE) AS booking_volume_{days}d",
        ]
    return measures


# Group keys and aggregates of the features that are means or counts over a group.
GROUP_STATISTICS: dict[str, tuple[tuple[str, ...], list[str]]] = {
    "similar": (COHORT_KEY, [_rate("n_booked", "hist_fill_rate_similar")]),
    "provider_service": (
        ("provider_id", "service_type"),
        [_rate("n_booked", "fill_rate_provider_service")],
    ),
    "business_service": (
        ("business_id", "service_type"),
        [_rate("n_booked", "fill_rate_business_service")],
    ),
    "pattern": (
        ("business_id", *COHORT_KEY),
        [
            *[_rate(f"n_first_{name}", f"{name}_rate_pattern") for name in PATTERN_EVENTS],
            "sum(n_future) AS remaining_service_slots_window",
        ],
    ),
    "provider": (("provider_id",), _provider_measures()),
    "business": (
        ("business_id",),
        [
            _rate("n_booked", "business_fill_trend"),
            _rate("pace_total", "business_booking_trend"),
        ],
    ),
}
GROUPS = tuple(GROUP_STATISTICS)


def cell_statistics(cells: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Every group statistic side by side on the cell it applies to.

    The joins run between cells and ever coarser groups, so the slots themselves are
    joined only once, to the result. Groups over a null service stay null.
    """
    out = cells.select(*CELL_KEY)
    for name in groups:
        keys, measures = GROUP_STATISTICS[name]
        table = cells.groupBy(*RUN_KEY, *keys).agg(*[F.expr(m) for m in measures])
        out = attach(out, table, (*RUN_KEY, *keys), CELL_KEY)
    return out


def add_cohorts(statistics: DataFrame, baselines: DataFrame) -> DataFrame:
    """Baseline columns beside the cells; here a null service matches its null cohort."""
    known = baselines.selectExpr(
        *RUN_KEY,
        *COHORT_KEY,
        "fill_rate AS _cohort_fill",
        "expected_booking_pace_per_day AS _cohort_pace",
        "avg_lead_time_hours AS _cohort_lead",
        "completion_rate AS _cohort_completion",
        "is_sparse AS _cohort_sparse",
    )
    return attach(
        statistics, known, (*RUN_KEY, *COHORT_KEY), CELL_KEY, null_safe=("service_type",)
    )


def add_cells(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    return attach(rows, statistics, CELL_KEY, ("slot_id",), null_safe=("service_type",))


def add_group_features(
    rows: DataFrame, cells: DataFrame, groups: Sequence[str] = GROUPS
) -> DataFrame:
    """Only the features of the named groups beside the rows."""
    return _mask_past(add_cells(rows, cell_statistics(cells, groups)))


def inventory_density(base: DataFrame) -> DataFrame:
    """Slots of the same business and service starting within two hours, per start time.

    Counts per distinct start time are summed over a sliding range. A start near midnight
    is also handed to the neighbouring day, so each (business, service, day) is a window of
    its own and even a business holding a third of all slots is cut into days.
    """
    counts = base.groupBy(*RUN_KEY, "business_id", "service_type", "slot_start_at").agg(
        F.count("*").alias("n_starts")
    )
    micros = F.unix_micros(F.col("slot_start_at").cast("timestamp"))

    def day_of(column: Column) -> Column:
        return F.floor(column / F.lit(DAY_MICROS))

    at = F.col("start_micros")
    near = F.array_distinct(
        F.array(day_of(at - DENSITY_MICROS), day_of(at), day_of(at + DENSITY_MICROS))
    )
    spread = counts.withColumn("start_micros", micros).withColumn("window_day", F.explode(near))
    around = (
        Window.partitionBy(*RUN_KEY, "business_id", "service_type", "window_day")
        .orderBy("start_micros")
        .rangeBetween(-DENSITY_MICROS, DENSITY_MICROS)
    )
    return (
        spread.withColumn("inventory_density_2h", F.sum("n_starts").over(around).cast("double"))
        .where(F.col("window_day") == day_of(at))
        .select(*RUN_KEY, "business_id", "service_type", "slot_start_at", "inventory_density_2h")
    )


def remaining_same_day(base: DataFrame) -> DataFrame:
    """Slots of a provider on a date that start at or after the snapshot."""
    future = base.where(F.col("slot_start_at") >= F.col("effective_ts"))
    return future.groupBy(
        *RUN_KEY, "provider_id", F.to_date("slot_start_at").alias("slot_date")
    ).agg(F.count("*").alias("remaining_provider_slots_same_day"))


def add_density(rows: DataFrame, base: DataFrame, stage: Stage = no_stage) -> DataFrame:
    key = (*RUN_KEY, "business_id", "service_type", "slot_start_at")
    joined = attach(rows, stage(inventory_density(base), "density"), key, ("slot_id",), fanout=1)
    return joined.withColumn(
        "inventory_density_2h", F.coalesce("inventory_density_2h", F.lit(0.0))
    )


def add_remaining_same_day(rows: DataFrame, base: DataFrame, stage: Stage = no_stage) -> DataFrame:
    dated = rows.withColumn("slot_date", F.to_date("slot_start_at"))
    key = (*RUN_KEY, "provider_id", "slot_date")
    joined = attach(dated, stage(remaining_same_day(base), "same_day"), key, ("slot_id",), fanout=1)
    count = F.coalesce("remaining_provider_slots_same_day", F.lit(0))
    return joined.withColumn(
        "remaining_provider_slots_same_day", _if_future(count).cast("int")
    ).drop("slot_date")


def _if_future(count: Column) -> Column:
    return F.when(F.col("slot_start_at") >= F.col("effective_ts"), count).otherwise(F.lit(0))


def _mask_past(rows: DataFrame) -> DataFrame:
    """A slot already started has no remaining slots in its window."""
    name = "remaining_service_slots_window"
    if name not in rows.columns:
        return rows
    return rows.withColumn(name, _if_future(F.coalesce(name, F.lit(0))).cast("int"))


def build_features(
    base: DataFrame,
    settings: Settings,
    baselines: DataFrame | None = None,
    stage: Stage = no_stage,
    scarcity: bool = True,
) -> DataFrame:
    """Base rows with all features beside them.

    ``stage`` may write an intermediate table that several branches read. ``baselines``
    takes stored cohort baselines instead of computing them. ``scarcity=False`` leaves out
    local density and same-day counts, which scoring and recommendation do not read.
    """
    base = stage(base, "base")
    cells = stage(slot_cells(base), "cells")
    if baselines is None:
        baselines = cohort_baselines(cells, settings)
    # Staged, so that the planner sees its size and need not shuffle the rows to meet it.
    statistics = stage(add_cohorts(cell_statistics(cells), baselines), "statistics")
    rows = base
    if scarcity:  # before the statistics: these joins may shuffle rows, and base rows are half as wide
        rows = add_remaining_same_day(add_density(rows, base, stage), base, stage)
    rows = _mask_past(add_cells(rows, statistics)).withColumns(
        {
            "cohort_fill_rate": F.coalesce("_cohort_fill", "hist_fill_rate_similar"),
            "expected_booking_pace_per_day": F.coalesce(
                "_cohort_pace", "observed_booking_pace_per_day"
            ),
            "avg_lead_time_hours": F.coalesce("_cohort_lead", "lead_time_hours"),
            "cohort_completion_rate": F.coalesce("_cohort_completion", F.lit(0.0)),
            "cohort_is_sparse": F.coalesce("_cohort_sparse", F.lit(True)),
        }
    ).withColumn(
        "pace_deviation",
        F.col("observed_booking_pace_per_day") - F.col("expected_booking_pace_per_day"),
    )
    return rows.drop(
        "_cohort_fill", "_cohort_pace", "_cohort_lead", "_cohort_completion", "_cohort_sparse"
    )


def feature_snapshots(features: DataFrame) -> DataFrame:
    """The stored columns of the feature table."""
    return features.select(*FEATURE_SNAPSHOT_COLUMNS)
