"""Named queries over the given tables. Each takes a session and a folder of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.functions import calendar, ids, text
from openchair.operators import (
    availability,
    baselines,
    evaluation,
    explorer,
    features,
    history,
    normalize,
    quality,
    recommend,
    scoring,
    snapshot,
    timeline,
    underbooking,
)
from openchair.params import RUN_KEY, SLOT_KEY, RunSpec, Settings
from openchair.plans.snapshot_job import SnapshotJob
from openchair.plans.staging import new_folder, staged
from openchair.plans.stored import RunTables
from openchair.schemas import SLOTS
from openchair.sources import commerce, tables

Query = Callable[[SparkSession, str], DataFrame]

RUN = RunSpec("scn_main", "run_19980601", datetime(1998, 6, 1))
BACKFILL = (
    RunSpec("scn_main", "run_19970601", datetime(1997, 6, 1)),
    RUN,
    RunSpec("scn_main", "run_19990601", datetime(1999, 6, 1)),
)
# A snapshot at each midnight of the year that ends with the main run.
YEAR = tuple(
    RunSpec("scn_main", f"day_{ts:%Y%m%d}", ts)
    for ts in (RUN.effective_ts - timedelta(days=back) for back in reversed(range(365)))
)
SOURCE_SYSTEM, SOURCE_RUN, CONFIG_HASH = "orders_feed", "feed_001", "cfg_default"
DEFAULTS = Settings()
# Fitted weights have no SQL twin, so queries compared value by value take the constant-rate path.
CONSTANT_RATE = replace(DEFAULTS, use_model=False)
# Rules set tight enough that every one of them removes steps somewhere.
STRICT = replace(CONSTANT_RATE, excluded_services=("svc_5",), price_floor_pct=0.85)
# Rows of the dimensions that a faulty batch does not send.
UNSENT = {
    "businesses": "source_business_id = 'biz_1'",
    "locations": "source_location_id = 'loc_2'",
    "services": "source_service_id = 'svc_3'",
    "customers": "first_name = 'BUILDING'",
}
EXPLORING = replace(CONSTANT_RATE, exploration_share=0.5)
ALWAYS_EXPLORING = replace(CONSTANT_RATE, exploration_share=1.0)
DIGITS = 6


def _session(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _slots(spark: SparkSession, sf_dir: str, runs=(RUN,)) -> DataFrame:
    return commerce.slots(_session(spark), sf_dir, runs)


def _events(spark: SparkSession, sf_dir: str, runs=(RUN,)) -> DataFrame:
    return commerce.events(_session(spark), sf_dir, runs)


def _seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a query that looks at no event after the snapshot."""
    return commerce.events(_session(spark), sf_dir, (RUN,), commerce.seen_starts((RUN,)))


def _job(spark, sf_dir, settings=CONSTANT_RATE, runs=(RUN,), **options) -> SnapshotJob:
    _session(spark)
    slots, events = commerce.slot_feed(spark, sf_dir), commerce.event_feed(spark, sf_dir)
    return SnapshotJob(slots, events, runs, settings, fanout=1, **options)


def _rounded(df: DataFrame) -> DataFrame:
    """Floating results to six digits: sums of doubles depend on the order of addition."""
    return df.withColumns(
        {n: F.round(F.col(n), DIGITS) for n, kind in df.dtypes if kind == "double"}
    )


def _pick(df: DataFrame, *columns: str) -> DataFrame:
    return _rounded(df.select(*columns))


# Sources, normalization and data quality ------------------------------------------------


def scan_slots(spark, sf_dir):
    stored = _slots(spark, sf_dir, BACKFILL)
    columns = ("slot_id", *RUN_KEY, "provider_id", "slot_start_at", "standard_price")
    return _rounded(tables.scan_scoped(stored, [RUN], columns))


def stable_ids(spark, sf_dir):
    orders = _session(spark).read.parquet(f"{sf_dir}/orders.parquet")
    key = F.concat(F.lit("slot_"), F.col("o_orderkey").cast("string"))
    return orders.select(
        "o_orderkey", ids.stable_id("slot", F.lit(RUN.scenario_id), key).alias("stable_id")
    )


def normalize_dims(spark, sf_dir):
    raw = commerce.raw_dimensions(_session(spark), sf_dir)
    dims = normalize.normalize_dimensions(raw, RUN.scenario_id)
    parts = []
    for table, (entity, *parents) in normalize.DIMENSION_IDS.items():
        location = F.col("location_id") if "location" in parents else F.lit("-")
        parts.append(
            dims[table].select(
                F.lit(table).alias("dimension"),
                F.col(f"{entity}_id").alias("entity_id"),
                "business_id",
                location.alias("location_id"),
                "scenario_id",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _normalized_slots(spark, sf_dir):
    raw = commerce.raw_slots(_session(spark), sf_dir)
    return normalize.normalize_slots(raw, RUN, SOURCE_SYSTEM, SOURCE_RUN)


def _normalized_events(spark, sf_dir):
    raw = commerce.raw_events(_session(spark), sf_dir)
    slots = _normalized_slots(spark, sf_dir)
    return normalize.normalize_events(raw, slots, RUN, SOURCE_SYSTEM, SOURCE_RUN)


def normalize_slots(spark, sf_dir):
    return _normalized_slots(spark, sf_dir)


def normalize_events(spark, sf_dir):
    return _normalized_events(spark, sf_dir)


def load_slots(spark, sf_dir):
    loaded = normalize.load_slots(_normalized_slots(spark, sf_dir), RUN, CONFIG_HASH)
    return loaded.withColumns(
        {
            "unavailable_at": F.col("unavailable_at").isNull(),
            "current_status": F.col("current_status").isNull(),
        }
    )


def load_events(spark, sf_dir):
    return normalize.load_events(_normalized_events(spark, sf_dir), RUN)


DIMENSION_VIEW = (
    "location_id",
    "name",
    "first_name",
    "last_name",
    "duration_minutes",
)


def _sent_dimensions(spark, sf_dir) -> dict[str, DataFrame]:
    """Dimensions as text, as a source sends them, with faults: one service's duration is a word, one's too long for its type,
    one's absent; the customers of one segment have no id."""
    raw = dict(commerce.raw_dimensions(_session(spark), sf_dir))
    word = "CASE source_service_id WHEN 'svc_1' THEN 'sixty' WHEN 'svc_2' THEN '99999999999' WHEN 'svc_3' THEN NULL"
    raw["services"] = raw["services"].withColumn(
        "duration_minutes", F.expr(f"{word} ELSE CAST(duration_minutes AS STRING) END")
    )
    raw["customers"] = raw["customers"].withColumn(
        "source_customer_id", F.when(F.col("first_name") != "BUILDING", F.col("source_customer_id"))
    )
    return normalize.normalize_dimensions(raw, RUN.scenario_id)


def _stacked(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def load_dims(spark, sf_dir):
    """All five dimensions in their stored types, without the rows that lose a value; a column that one lacks is null."""
    parts = []
    for table, normalized in _sent_dimensions(spark, sf_dir).items():
        loaded = normalize.load_dimension(normalized, table)
        kinds = {"duration_minutes": "int"}
        shared = [
            (F.col(c) if c in loaded.columns else F.lit(None).cast(kinds.get(c, "string"))).alias(c)
            for c in DIMENSION_VIEW
        ]
        own = F.col(loaded.columns[0]).alias("entity_id")
        parts.append(loaded.select(F.lit(table).alias("dimension"), own, "business_id", *shared, "scenario_id"))
    return _stacked(parts)


def load_rejects(spark, sf_dir):
    """The values that kept rows of the same dimensions out, each with its column."""
    sent = _sent_dimensions(spark, sf_dir)
    rejects = _stacked([normalize.dimension_rejects(df, table) for table, df in sent.items()])
    return rejects.select(
        "dimension",
        F.col("column").alias("column_name"),
        F.col("value").alias("sent_value"),
        F.get_json_object("record", "$.source_business_id").alias("source_business_id"),
        F.get_json_object("record", "$.last_name").alias("last_name"),
    )


def dq_nulls(spark, sf_dir):
    slots, events = _normalized_slots(spark, sf_dir), _normalized_events(spark, sf_dir)
    return quality.null_rules(slots, "slots").unionByName(
        quality.null_rules(events, "booking_events")
    )


def dq_types(spark, sf_dir):
    feed = commerce.feed_events(_session(spark), sf_dir)
    return quality.slot_type_rules(_normalized_slots(spark, sf_dir)).unionByName(
        quality.event_type_rules(feed)
    )


def dq_integrity(spark, sf_dir):
    raw = commerce.raw_dimensions(_session(spark), sf_dir)
    return quality.integrity_rules(
        raw, commerce.raw_slots(spark, sf_dir), commerce.raw_events(spark, sf_dir)
    )


def dq_integrity_faults(spark, sf_dir):
    """The rules over a batch in which every one of them is broken: one service's slots come again,
    of an unknown provider and published after their start; removals point to no slot and no-shows
    come twice; a business, a location, a service and one segment of the customers are not sent."""
    raw = dict(commerce.raw_dimensions(_session(spark), sf_dir))
    for table, fault in UNSENT.items():
        raw[table] = raw[table].where(f"NOT ({fault})")
    slots = commerce.raw_slots(spark, sf_dir)
    again = slots.where(F.col("source_service_id") == "svc_1").withColumns(
        {"source_provider_id": F.lit("prov_none"), "visible_at": F.col("slot_end_at")}
    )
    lost = F.when(F.col("event_type") == "removed", F.lit("slot_none"))
    events = commerce.raw_events(spark, sf_dir).withColumn(
        "source_slot_id", F.coalesce(lost, F.col("source_slot_id"))
    )
    twice = events.where("event_type = 'no_show'")
    return quality.integrity_rules(raw, slots.unionByName(again), events.unionByName(twice))


def dq_gate(spark, sf_dir):
    rules = dq_nulls(spark, sf_dir).unionByName(dq_types(spark, sf_dir))
    return quality.gate(rules.unionByName(dq_integrity(spark, sf_dir)))


def align_schema(spark, sf_dir):
    old = _slots(spark, sf_dir).select(*SLOT_KEY, "provider_id", "slot_start_at")
    aligned = normalize.align_schema(old, SLOTS)
    missing = [F.col(n).isNull().cast("int") for n in SLOTS.names]
    return aligned.select(
        *SLOT_KEY,
        "slot_start_at",
        F.lit(len(aligned.columns)).alias("column_count"),
        sum(missing[1:], missing[0]).alias("null_columns"),
    )


def dq_duplicates(spark, sf_dir):
    job, decisions = _decided(spark, sf_dir, runs=BACKFILL)
    version = "feature_snapshot_version"
    checked = {
        "cohort_baselines": (job.baselines, (*RUN_KEY, version, "cohort_id")),
        "feature_snapshots": (job.features, (*SLOT_KEY, version)),
        "underbooking_outputs": (job.flagged, (*SLOT_KEY, version)),
        "business_calibrations": (job.calibrations, (*RUN_KEY, version, "business_id")),
        "scoring_outputs": (decisions, (*SLOT_KEY, version)),
        "pricing_actions": (decisions, SLOT_KEY),
        "slots_over_all_runs": (job.slots, ("slot_id",)),
    }
    return quality.duplicate_rules(checked)


def dq_ranges(spark, sf_dir):
    job = _job(spark, sf_dir, slots_too=True)
    return quality.range_rules(job.available, job.scored, job.calibrations)


def dq_readiness(spark, sf_dir):
    job, decisions = _decided(spark, sf_dir, runs=BACKFILL, slots_too=True)
    return quality.readiness(job.available, job.features, decisions, job.calibrations, decisions)


# Availability and snapshot --------------------------------------------------------------


def effective_bookings(spark, sf_dir):
    return history.effective_bookings(_events(spark, sf_dir))


def slot_availability(spark, sf_dir):
    known = availability.availability(_slots(spark, sf_dir), _events(spark, sf_dir))
    return known.select(*SLOT_KEY, "unavailable_at", "current_status")


def availability_asof(spark, sf_dir):
    known = availability.availability(_slots(spark, sf_dir), _events(spark, sf_dir), asof=True)
    return known.select(*SLOT_KEY, "unavailable_at", "current_status")


def visible_slots(spark, sf_dir):
    slots = commerce.slots(_session(spark), sf_dir, (RUN,), commerce.visible_starts((RUN,)))
    return snapshot.visible_slots(slots).select(
        *SLOT_KEY, "visible_at", "slot_start_at"
    )


def events_asof(spark, sf_dir):
    return snapshot.events_asof(_seen_events(spark, sf_dir)).select(
        *SLOT_KEY, "event_id", "event_type", "event_at"
    )


def first_booking(spark, sf_dir):
    return snapshot.first_booking(_seen_events(spark, sf_dir))


def first_event(spark, sf_dir):
    return snapshot.first_event(_seen_events(spark, sf_dir))


def slot_event_rollup(spark, sf_dir):
    rollup = snapshot.slot_event_rollup(_seen_events(spark, sf_dir))
    return rollup.drop("first_booked_at")


def slot_calendar(spark, sf_dir):
    slots = snapshot.add_calendar(_slots(spark, sf_dir), DEFAULTS)
    return _pick(
        slots,
        *SLOT_KEY,
        "day_of_week",
        "time_of_day_bucket",
        "hours_until_slot",
        "days_until_slot",
        "effective_lead_time_band",
    )


def trailing_window(spark, sf_dir):
    starts = commerce.trailing_starts((RUN,), 28)
    slots = commerce.slots(_session(spark), sf_dir, (RUN,), starts)
    return snapshot.trailing_window(slots, 28).select(*SLOT_KEY, "slot_start_at")


def slot_flags(spark, sf_dir):
    return _pick(
        _job(spark, sf_dir).base,
        *SLOT_KEY,
        "booked_flag",
        "completed_flag",
        "booked_or_completed",
        "lead_time_hours",
        "active_days",
    )


# Baselines and features -----------------------------------------------------------------


def cohort_baselines(spark, sf_dir):
    return _rounded(_job(spark, sf_dir).baselines)


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _session(spark)
    return commerce.slot_feed(spark, sf_dir), commerce.event_feed(spark, sf_dir)


def backfill_cohort_baselines(spark, sf_dir):
    feeds = _feeds(spark, sf_dir)
    cells = timeline.cells_at_runs(*feeds, BACKFILL, DEFAULTS, timeline.cohort_changes())
    return _rounded(baselines.cohort_baselines(cells, DEFAULTS))


def daily_provider_windows(spark, sf_dir):
    """Trailing windows of every provider at the end of each day of a year."""
    return _rounded(timeline.provider_windows(*_feeds(spark, sf_dir), YEAR, DEFAULTS))


def daily_fill(spark, sf_dir):
    """Slots published, booked and completed, and those still to start, by business and service, each day of a year."""
    changes = [*timeline.cohort_changes(), *timeline.pattern_changes()]
    place = ("business_id", "service_type")
    cells = timeline.cells_at_runs(*_feeds(spark, sf_dir), YEAR, DEFAULTS, changes, place)
    return cells.select(
        *RUN_KEY,
        *place,
        *("n_slots", "n_booked", "n_completed", "n_future"),
        *(f"n_first_{name}" for name in baselines.PATTERN_EVENTS),
        F.col("lead_micros").cast("bigint").alias("lead_micros"),
        F.col("active_micros").cast("bigint").alias("active_micros"),
    )


def daily_provider_scarcity(spark, sf_dir):
    """Slots that each provider still has to come on each date, as seen at each midnight of a year."""
    feed, _ = _feeds(spark, sf_dir)
    return timeline.remaining_slots(feed, YEAR, DEFAULTS, ("provider_id", "slot_date"))


def daily_service_scarcity(spark, sf_dir):
    """Slots still to come by business, service, weekday and time of day, as seen at each midnight of a year."""
    feed, _ = _feeds(spark, sf_dir)
    place = ("business_id", "service_type", "day_of_week", "time_of_day_bucket")
    return timeline.remaining_slots(feed, YEAR, DEFAULTS, place)


def features_pace(spark, sf_dir):
    return _pick(_job(spark, sf_dir).base, *SLOT_KEY, "observed_booking_pace_per_day")


def _feature_group(*names: str, columns: tuple[str, ...]) -> Query:
    """Only the cell statistics of the named groups, joined back to the slots."""

    def query(spark, sf_dir):
        job = _job(spark, sf_dir)
        base = staged(job.base, "base")
        cells = staged(baselines.slot_cells(base), "cells")
        rows = features.add_group_features(base, cells, names)
        return _pick(rows, *SLOT_KEY, *columns)

    return query


features_fill = _feature_group(
    "similar",
    "provider_service",
    "business_service",
    columns=(
        "hist_fill_rate_similar",
        "fill_rate_provider_service",
        "fill_rate_business_service",
    ),
)
features_utilization = _feature_group(
    "provider",
    columns=tuple(
        f"{name}_{days}d"
        for name in ("provider_utilization", "booking_volume")
        for days in (7, 14, 28)
    ),
)
features_patterns = _feature_group(
    "pattern",
    columns=("cancel_rate_pattern", "no_show_rate_pattern", "reschedule_rate_pattern"),
)
features_business = _feature_group(
    "business", columns=("business_fill_trend", "business_booking_trend")
)


def features_scarcity(spark, sf_dir):
    job = _job(spark, sf_dir)
    base = staged(job.base, "base")
    cells = staged(baselines.slot_cells(base), "cells")
    rows = features.add_group_features(base, cells, ("pattern",))
    rows = features.add_remaining_same_day(rows, base)
    return rows.select(
        *SLOT_KEY, "remaining_provider_slots_same_day", "remaining_service_slots_window"
    )


def features_density(spark, sf_dir):
    slots = commerce.slots(_session(spark), sf_dir, (RUN,), commerce.visible_starts((RUN,)))
    slots = snapshot.visible_slots(slots)
    slots = slots.withColumn("service_type", F.col("service_id"))
    return features.add_density(slots, slots).select(*SLOT_KEY, "inventory_density_2h")


def feature_snapshots(spark, sf_dir):
    job = _job(spark, sf_dir, scarcity=True)
    return _rounded(features.feature_snapshots(job.features_once))


def underbooking_outputs(spark, sf_dir):
    return _rounded(underbooking.underbooking_outputs(_job(spark, sf_dir).flagged_once))


# Scoring and recommendation -------------------------------------------------------------


def training_set(spark, sf_dir):
    return _rounded(scoring.training_set(_job(spark, sf_dir).features_once))


def scoring_set(spark, sf_dir):
    rows = scoring.scoring_set(_job(spark, sf_dir).flagged_once)
    return _pick(
        rows,
        *SLOT_KEY,
        "business_id",
        "cohort_fill_rate",
        "severity_score",
        "underbooked",
        "hours_until_slot",
        "business_fill_trend",
    )


def business_calibration(spark, sf_dir):
    return _rounded(_job(spark, sf_dir).calibrations)


def score_fallback(spark, sf_dir):
    return _rounded(scoring.scoring_outputs(_job(spark, sf_dir).scored))


def score_model(spark, sf_dir):
    return _rounded(scoring.scoring_outputs(_job(spark, sf_dir, DEFAULTS).scored))


def model_checks(spark, sf_dir):
    """The fitted models of three runs: rows used, and whether each is at its optimum."""
    job = _job(spark, sf_dir, DEFAULTS, runs=BACKFILL)
    return scoring.model_checks(job.training, job.scored, job.models, job.settings)


def backfill_scores(spark, sf_dir):
    job = _job(spark, sf_dir, runs=BACKFILL)
    return _pick(
        job.scored, *SLOT_KEY, "booking_probability", "shortfall_score", "confidence_score"
    )


def decision_input(spark, sf_dir):
    job = _job(spark, sf_dir, slots_too=True)
    scored, flagged = staged(job.scored, "scores"), job.flagged
    rows = recommend.decision_input(job.available, job.features, flagged, scored)
    return _rounded(rows.drop("effective_ts"))


def eligible_actions(spark, sf_dir):
    rows = scoring.scoring_set(_job(spark, sf_dir, STRICT).flagged_once)
    eligible = text.number_list(recommend.eligible_actions(STRICT))
    return rows.select(*SLOT_KEY, eligible.alias("eligible_action_set"))


def select_discount(spark, sf_dir):
    rows = recommend.choose_discount(_job(spark, sf_dir, STRICT).scored, STRICT)
    return rows.select(*SLOT_KEY, "underbooked", "target", "chosen")


def explore(spark, sf_dir):
    return _job(spark, sf_dir, EXPLORING).decisions.select(
        *SLOT_KEY,
        "chosen",
        "final_discount",
        "was_exploration",
        "exploration_policy",
        "decision_reason",
    )


def rationale(spark, sf_dir):
    return _job(spark, sf_dir).decisions.select(*SLOT_KEY, "rationale_codes")


def rationale_mapped(spark, sf_dir):
    """The weekday-afternoon code switched on by naming days and bucket as features do."""
    days = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
    mapped = replace(CONSTANT_RATE, weekday_labels=days, afternoon_labels=("12-17",))
    return _job(spark, sf_dir, mapped).decisions.select(*SLOT_KEY, "rationale_codes")


def pricing_actions(spark, sf_dir):
    return _rounded(recommend.pricing_actions(_job(spark, sf_dir).decisions))


def policy_checks(spark, sf_dir):
    return quality.policy_rules(_job(spark, sf_dir, STRICT).decisions, STRICT)


def policy_faults(spark, sf_dir):
    """Decisions of three runs held against rules stricter than those they were made by; in one run discounts fall with severity."""
    return quality.policy_rules(_job(spark, sf_dir, runs=BACKFILL).decisions, STRICT)


# Evaluation and explorer ----------------------------------------------------------------


def _decided(spark, sf_dir, **options) -> tuple[SnapshotJob, DataFrame]:
    """The job and its decided rows as a table; these also hold every scored row."""
    job = _job(spark, sf_dir, **options)
    return job, staged(job.decisions, "decisions")


def evaluation_metrics(spark, sf_dir):
    job, decisions = _decided(spark, sf_dir)
    return _rounded(evaluation.evaluation(job.slots, job.flagged, decisions, decisions))


def backfill_evaluation(spark, sf_dir):
    job, decisions = _decided(spark, sf_dir, runs=BACKFILL)
    return _rounded(evaluation.evaluation(job.slots, job.flagged, decisions, decisions))


def similar_slot_consistency(spark, sf_dir):
    return _rounded(evaluation.similar_slot_consistency(_job(spark, sf_dir).decisions))


def recommendations(spark, sf_dir):
    return _rounded(explorer.recommendations(_job(spark, sf_dir).decisions))


def recommendations_model(spark, sf_dir):
    """The list with the fitted model, as a user gets it without settings."""
    return _rounded(explorer.recommendations(_job(spark, sf_dir, DEFAULTS).decisions))


def recommendations_filtered(spark, sf_dir):
    decisions = _job(spark, sf_dir).decisions
    return _rounded(
        explorer.recommendations(decisions, service_id="svc_2", discounted_only=True)
    )


def recommendations_of_business(spark, sf_dir):
    decisions = _job(spark, sf_dir).decisions
    return _rounded(explorer.recommendations(decisions, business_id="biz_1"))


def recommendations_explored(spark, sf_dir):
    decisions = _job(spark, sf_dir, ALWAYS_EXPLORING).decisions
    return _rounded(explorer.recommendations(decisions, exploration_only=True))


def recommendations_sorted(spark, sf_dir):
    """The whole list, smallest discount first."""
    rows = _rounded(explorer.recommendations(_job(spark, sf_dir).decisions))
    return explorer.sort_recommendations(rows, "recommended_discount", descending=False)


def recommendations_top(spark, sf_dir):
    rows = explorer.recommendations(_job(spark, sf_dir).decisions)
    # Rounded first, so that both sides order by the same numbers.
    return explorer.top_recommendations(_rounded(rows), 20)


def recommendations_of_provider(spark, sf_dir):
    decisions = _job(spark, sf_dir).decisions
    return _rounded(explorer.recommendations(decisions, provider_id="prov_103"))


def recommendations_of_lead_band(spark, sf_dir):
    decisions = _job(spark, sf_dir).decisions
    return _rounded(explorer.recommendations(decisions, lead_time_band="gt_168h"))


def _stored(spark, sf_dir) -> RunTables:
    """The tables of three runs, written for joins to a folder of their own."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    job = _job(spark, sf_dir, runs=BACKFILL, scarcity=True, slots_too=True, buckets=buckets)
    stored = RunTables(spark, f"openchair_{uuid.uuid4().hex}", buckets, new_folder(spark))
    stored.write(job)
    return stored


def stored_decision_input(spark, sf_dir):
    """One of three stored runs: slots, features, flags and scores joined bucket by bucket."""
    return _rounded(_stored(spark, sf_dir).decision_input(RUN).drop("effective_ts"))


def stored_recommendations(spark, sf_dir):
    """The list of an earlier one of three stored runs, read back from its tables."""
    return _rounded(explorer.recommendations(_stored(spark, sf_dir).decisions(BACKFILL[0])))


def stored_runs(spark, sf_dir):
    """The runs found in the stored tables, newest first."""
    return _stored(spark, sf_dir).runs()


def severity_distribution(spark, sf_dir):
    return explorer.severity_distribution(_job(spark, sf_dir).flagged_once)


def summary_by_action(spark, sf_dir):
    return explorer.summary_by_action(_job(spark, sf_dir).decisions)


def summary_by_provider(spark, sf_dir):
    return explorer.summary_by_provider(_job(spark, sf_dir).decisions)


def summary_by_service(spark, sf_dir):
    return explorer.summary_by_service(_job(spark, sf_dir).decisions)


def summary_by_lead_band(spark, sf_dir):
    return explorer.summary_by_lead_band(_job(spark, sf_dir).decisions)


def summary_by_provider_of_service(spark, sf_dir):
    return explorer.summary_by_provider(_job(spark, sf_dir).decisions, service_id="svc_2")


def summary_by_service_of_business(spark, sf_dir):
    return explorer.summary_by_service(_job(spark, sf_dir).decisions, business_id="biz_1")


def latest_runs(spark, sf_dir):
    return evaluation.latest_runs(_slots(spark, sf_dir, BACKFILL))


def run_summary(spark, sf_dir):
    job, decisions = _decided(spark, sf_dir, runs=BACKFILL)
    return _rounded(evaluation.run_summary(job.slots, job.flagged, decisions, decisions))


QUERIES: dict[str, Query] = {
    "scan_slots": scan_slots,
    "stable_ids": stable_ids,
    "normalize_dims": normalize_dims,
    "normalize_slots": normalize_slots,
    "normalize_events": normalize_events,
    "load_slots": load_slots,
    "load_events": load_events,
    "load_dims": load_dims,
    "load_rejects": load_rejects,
    "dq_nulls": dq_nulls,
    "dq_types": dq_types,
    "dq_integrity": dq_integrity,
    "dq_integrity_faults": dq_integrity_faults,
    "dq_gate": dq_gate,
    "align_schema": align_schema,
    "dq_duplicates": dq_duplicates,
    "dq_ranges": dq_ranges,
    "dq_readiness": dq_readiness,
    "effective_bookings": effective_bookings,
    "availability": slot_availability,
    "availability_asof": availability_asof,
    "visible_slots": visible_slots,
    "events_asof": events_asof,
    "first_booking": first_booking,
    "first_event": first_event,
    "slot_event_rollup": slot_event_rollup,
    "slot_calendar": slot_calendar,
    "trailing_window": trailing_window,
    "slot_flags": slot_flags,
    "cohort_baselines": cohort_baselines,
    "backfill_cohort_baselines": backfill_cohort_baselines,
    "daily_provider_windows": daily_provider_windows,
    "daily_fill": daily_fill,
    "daily_provider_scarcity": daily_provider_scarcity,
    "daily_service_scarcity": daily_service_scarcity,
    "features_pace": features_pace,
    "features_fill": features_fill,
    "features_scarcity": features_scarcity,
    "features_density": features_density,
    "features_utilization": features_utilization,
    "features_patterns": features_patterns,
    "features_business": features_business,
    "feature_snapshots": feature_snapshots,
    "underbooking": underbooking_outputs,
    "training_set": training_set,
    "scoring_set": scoring_set,
    "business_calibration": business_calibration,
    "score_fallback": score_fallback,
    "score_model": score_model,
    "model_checks": model_checks,
    "backfill_scores": backfill_scores,
    "decision_input": decision_input,
    "eligible_actions": eligible_actions,
    "select_discount": select_discount,
    "explore": explore,
    "rationale": rationale,
    "rationale_mapped": rationale_mapped,
    "pricing_actions": pricing_actions,
    "policy_checks": policy_checks,
    "policy_faults": policy_faults,
    "evaluation": evaluation_metrics,
    "backfill_evaluation": backfill_evaluation,
    "similar_slot_consistency": similar_slot_consistency,
    "recommendations": recommendations,
    "recommendations_model": recommendations_model,
    "recommendations_filtered": recommendations_filtered,
    "recommendations_of_business": recommendations_of_business,
    "recommendations_explored": recommendations_explored,
    "recommendations_sorted": recommendations_sorted,
    "recommendations_top": recommendations_top,
    "recommendations_of_provider": recommendations_of_provider,
    "recommendations_of_lead_band": recommendations_of_lead_band,
    "stored_decision_input": stored_decision_input,
    "stored_recommendations": stored_recommendations,
    "stored_runs": stored_runs,
    "severity_distribution": severity_distribution,
    "summary_by_action": summary_by_action,
    "summary_by_provider": summary_by_provider,
    "summary_by_service": summary_by_service,
    "summary_by_lead_band": summary_by_lead_band,
    "summary_by_provider_of_service": summary_by_provider_of_service,
    "summary_by_service_of_business": summary_by_service_of_business,
    "latest_runs": latest_runs,
    "run_summary": run_summary,
}
