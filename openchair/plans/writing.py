"""Write the result tables of a job: check all of them, then replace each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.operators import evaluation, quality, recommend, scoring, underbooking
from openchair.operators.features import feature_snapshots
from openchair.params import RUN_KEY, SLOT_KEY, VERSIONED_SLOT_KEY
from openchair.plans.snapshot_job import SnapshotJob
from openchair.plans.staging import staged
from openchair.sources.tables import replace_scope

VERSIONED_RUN_KEY = (*RUN_KEY, "feature_snapshot_version")
NEEDED = ("slots_loaded", "scoring_complete", "ready_to_recommend")

TABLE_KEYS = {
    "cohort_baselines": (*VERSIONED_RUN_KEY, "cohort_id"),
    "feature_snapshots": VERSIONED_SLOT_KEY,
    "underbooking_outputs": VERSIONED_SLOT_KEY,
    "business_calibrations": (*VERSIONED_RUN_KEY, "business_id"),
    "scoring_outputs": VERSIONED_SLOT_KEY,
    "pricing_actions": SLOT_KEY,
}


def _require_ready(job: SnapshotJob, slots: DataFrame, tables: dict[str, DataFrame]) -> None:
    """Raise unless every run of the job has what its steps need. One row per run is read."""
    known = quality.readiness(
        slots,
        tables["feature_snapshots"],
        tables["scoring_outputs"],
        tables["business_calibrations"],
        tables["pricing_actions"],
    )
    found = {(row["scenario_id"], row["run_id"]): row for row in known.collect()}
    for run in job.runs:
        row = found.get((run.scenario_id, run.run_id))
        lacking = [name for name in NEEDED if row is None or not row[name]]
        if lacking:
            raise ValueError(f"run {run.run_id} is not complete: {', '.join(lacking)} not met")


def write_run(job: SnapshotJob, root: str) -> None:
    """Write baselines, features, flags, calibrations, scores, actions and metrics under ``root``.

    Readiness, repeated keys, ranges and the discount policy are checked on staged tables, so
    what was checked is what is written; if one rule fails in one run, nothing is written. Then
    each table is replaced run by run, also by no rows. A failure between two tables leaves the
    later ones as they were; writing again repairs it.
    """
    if not job.scarcity:
        raise ValueError("the stored features hold the scarcity columns: build the job with scarcity=True")
    decisions = staged(job.decisions, "decisions", RUN_KEY)
    slots = staged(job.available, "slots", RUN_KEY) if job.derive_availability else job.slots
    tables = {
        "cohort_baselines": staged(job.baselines, "baselines", RUN_KEY),
        "feature_snapshots": feature_snapshots(job.features),
        "underbooking_outputs": underbooking.underbooking_outputs(job.flagged),
        "business_calibrations": staged(job.calibrations, "calibrations", RUN_KEY),
        "scoring_outputs": scoring.scoring_outputs(decisions),
        "pricing_actions": recommend.pricing_actions(decisions),
    }
    _require_ready(job, slots, tables)
    policy = quality.policy_rules(decisions, job.settings)
    repeated = {name: (df, TABLE_KEYS[name]) for name, df in tables.items()}
    quality.require_clean(
        quality.duplicate_rules(repeated)
        .unionByName(quality.range_rules(slots, decisions, tables["business_calibrations"]))
        .unionByName(policy.select(F.concat_ws(" ", "run_id", "rule").alias("rule"), "bad_rows"))
    )
    metrics = evaluation.evaluation(slots, job.flagged, decisions, decisions)
    tables["evaluation_results"] = staged(metrics, "metrics", RUN_KEY)
    for name, df in tables.items():
        for run in job.runs:
            scope = {"scenario_id": run.scenario_id, "run_id": run.run_id}
            replace_scope(df, f"{root}/{name}", scope)
