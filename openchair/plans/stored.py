"""The tables of finished runs, laid out for joins, and the reads that need no exchange between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from openchair.operators import recommend, scoring, underbooking
from openchair.operators.features import feature_snapshots
from openchair.params import RUN_KEY, RunSpec
from openchair.plans.snapshot_job import SnapshotJob
from openchair.plans.staging import staged
from openchair.sources import run_tables

SLOT_TABLES = ("slots", "features", "flags", "scores", "actions")
# Within a run a slot is named by its id, and a join on it keeps the buckets.
IN_RUN = ("slot_id",)


class RunTables:
    """Five tables that share partitions and buckets. ``prefix`` tells them from other sets of the catalog."""

    def __init__(self, spark: SparkSession, prefix: str, buckets: int, root: str | None = None) -> None:
        self.spark, self.prefix, self.buckets, self.root = spark, prefix, buckets, root

    def name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def write(self, job: SnapshotJob) -> None:
        """Replace the runs of the job in all five tables, also by no rows; other runs stay.

        Each table is one write of all runs. A failure between two tables leaves the later ones as they were; writing again
        repairs it.
        """
        decisions = staged(job.decisions, "decisions", RUN_KEY)
        tables = {
            "slots": job.available,
            "features": feature_snapshots(job.features),
            "flags": underbooking.underbooking_outputs(job.flagged),
            "scores": scoring.scoring_outputs(decisions),
            "actions": recommend.pricing_actions(decisions),
        }
        for table, rows in tables.items():
            path = f"{self.root}/{table}" if self.root else None
            run_tables.write_runs(rows, self.name(table), self.buckets, path)
            # The rows come from staged tables, for all but the slots of these partitions, so this reads little.
            held = {tuple(row) for row in rows.select(*RUN_KEY).distinct().collect()}
            for run in job.runs:
                if (run.scenario_id, run.run_id) not in held:
                    run_tables.clear_run(self.spark, self.name(table), run)

    def _read(self, table: str, run: RunSpec) -> DataFrame:
        return run_tables.read_run(self.spark, self.name(table), run)

    def decision_input(self, run: RunSpec) -> DataFrame:
        """Open future slots of a run beside their features, flags and scores."""
        tables = [self._read(table, run) for table in ("slots", "features", "flags", "scores")]
        return run_tables.tag_run(recommend.decision_input(*tables, key=IN_RUN), run)

    def decisions(self, run: RunSpec) -> DataFrame:
        """Actions of a run beside the columns that explorer and evaluation read."""
        tables = [self._read(table, run) for table in ("actions", "slots", "features", "flags", "scores")]
        return run_tables.tag_run(recommend.decision_view(*tables, key=IN_RUN), run)

    def runs(self) -> DataFrame:
        return run_tables.stored_runs(self.spark, self.name("slots"))
