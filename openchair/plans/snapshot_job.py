"""From slots and events to recommendations, as one lazily built job.

Each attribute is a DataFrame built on first use. Tables read by several branches (base
rows, cells, features) are staged once; everything after the features is row-local except
three small aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from openchair.operators import (
    availability,
    baselines,
    features,
    history,
    logistic,
    recommend,
    scoring,
    snapshot,
    underbooking,
)
from openchair.operators.joins import FANOUT
from openchair.params import RUN_KEY, RunSpec, Settings
from openchair.plans.staging import staged


# Time differences are taken in the session zone; another one would skip or repeat hours.
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


class SnapshotJob:
    """Slots and events are stored tables of the runs, or feeds without run columns that every run looks at.

    ``slots_too`` is for jobs whose ``available`` slots are read beside what is derived from them: slots and
    events are joined once, for both. Events that lie by slot take ``fanout=1``. With ``buckets`` the staged tables
    of slots lie by slot, so that writing them to tables of as many buckets shuffles nothing.
    """

    def __init__(
        self,
        slots: DataFrame,
        events: DataFrame,
        runs: Sequence[RunSpec],
        settings: Settings | None = None,
        derive_availability: bool = True,
        scarcity: bool = False,
        slots_too: bool = False,
        fanout: int = FANOUT,
        buckets: int = 0,
    ) -> None:
        zone = slots.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in UTC_NAMES:
            raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {zone}")
        self.feed = slots
        self.slots = snapshot.assign_runs(slots, runs) if snapshot.is_feed(slots) else slots
        self.events = events
        self.runs = list(runs)
        self.settings = settings or Settings()
        self.derive_availability = derive_availability
        self.scarcity = scarcity
        self.slots_too = slots_too
        self.fanout = fanout
        self.buckets = buckets

    @cached_property
    def known(self) -> DataFrame:
        """Slots of every run with their event history. A feed is joined and staged before it meets the runs."""
        joined = availability.join_history(self.feed, self.events, self.fanout)
        joined = staged(joined.drop(*history.WORKING), "known", buckets=self.buckets)
        return snapshot.assign_runs(joined, self.runs) if snapshot.is_feed(joined) else joined

    @cached_property
    def available(self) -> DataFrame:
        """The slots of every run, unseen ones too, with both availability columns."""
        if not self.derive_availability:
            return self.slots
        return availability.availability(self.slots, self.events, joined=self.known)

    @cached_property
    def base(self) -> DataFrame:
        return snapshot.snapshot_base(
            self.feed,
            self.events,
            self.settings,
            derive=self.derive_availability,
            runs=self.runs,
            joined=self.known if self.slots_too else None,
            fanout=self.fanout,
        )

    @cached_property
    def cells(self) -> DataFrame:
        return baselines.slot_cells(self.base)

    @cached_property
    def baselines(self) -> DataFrame:
        return baselines.cohort_baselines(self.cells, self.settings)

    @cached_property
    def features_once(self) -> DataFrame:
        """Features for a job that reads them a single time."""
        return features.build_features(
            self.base, self.settings, stage=self._stage, scarcity=self.scarcity
        )

    def _stage(self, df: DataFrame, label: str) -> DataFrame:
        """Base rows are by slot; the other tables that features stage are by group."""
        return staged(df, label, buckets=self.buckets if label == "base" else 0)

    @cached_property
    def flagged_once(self) -> DataFrame:
        return underbooking.add_underbooking(self.features_once, self.settings)

    @cached_property
    def features(self) -> DataFrame:
        return staged(self.features_once, "features", RUN_KEY, self.buckets)

    @cached_property
    def flagged(self) -> DataFrame:
        return underbooking.add_underbooking(self.features, self.settings)

    @cached_property
    def training(self) -> DataFrame:
        return scoring.training_set(self.features)

    @cached_property
    def scoring_set(self) -> DataFrame:
        return scoring.scoring_set(self.flagged)

    @cached_property
    def training_summary(self) -> DataFrame:
        return scoring.training_summary(self.training, self.settings)

    @cached_property
    def calibrations(self) -> DataFrame:
        return scoring.business_calibration(
            self.scoring_set, self.training_summary, self.settings
        )

    @cached_property
    def models(self) -> dict[logistic.Key, logistic.Logistic]:
        return scoring.fit_models(self.training, self.training_summary, self.settings)

    @cached_property
    def scored(self) -> DataFrame:
        rows = self.scoring_set
        if self.models:
            rows = scoring.with_model_probability(rows, self.models)
        return scoring.add_scores(rows, self.calibrations)

    @cached_property
    def decisions(self) -> DataFrame:
        return recommend.decide(self.scored, self.settings)
