"""Keys, run descriptions and tunable settings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

RUN_KEY = ("scenario_id", "run_id")
SLOT_KEY = (*RUN_KEY, "slot_id")
VERSIONED_SLOT_KEY = (*SLOT_KEY, "feature_snapshot_version")


def slot_key(columns: Iterable[str]) -> tuple[str, ...]:
    """The slot key as far as a table has it: a feed that all runs look at has no run columns."""
    present = set(columns)
    return tuple(name for name in SLOT_KEY if name in present)


@dataclass(frozen=True)
class RunSpec:
    """One snapshot to compute. A job takes a short list of these from its caller."""

    scenario_id: str
    run_id: str
    effective_ts: datetime

    @property
    def feature_snapshot_version(self) -> str:
        return f"fsv_{self.effective_ts:%Y%m%dT%H%M%SZ}"


@dataclass(frozen=True)
class Settings:
    """The default thresholds, weights and ladders."""

    random_seed: int = 42
    bucket_boundaries: tuple[int, ...] = (0, 12, 17, 24)
    min_cohort_observations: int = 3
    pace_weight: float = 0.6
    fill_weight: float = 0.4
    underbooking_threshold: float = 0.35
    sparse_baseline_fill_rate: float = 0.6
    use_model: bool = True
    training_min_rows: int = 10
    l2_c: float = 1.0
    model_max_iter: int = 1000
    model_tol: float = 1e-6
    model_version: str = "pooled_logistic_v1"
    action_ladder: tuple[int, ...] = (0, 5, 10, 15, 20)
    max_discount_lead_time_hours: int = 168
    max_discount_pct: int = 20
    excluded_services: tuple[str, ...] = ()
    price_floor_pct: float = 0.7
    healthy_zero_only: bool = True
    severity_breakpoints: tuple[float, ...] = (0.2, 0.4, 0.7)
    discount_steps: tuple[int, ...] = (5, 10, 15, 20)
    exploration_share: float = 0.1
    # The weekday-afternoon rationale compares against these labels. Features hold
    # full day names and hour ranges, so it stays silent until a caller maps them.
    weekday_labels: tuple[str, ...] = ("mon", "tue", "wed", "thu", "fri")
    afternoon_labels: tuple[str, ...] = ("afternoon",)

    def __post_init__(self) -> None:
        if not 0.0 <= self.exploration_share <= 1.0:
            raise ValueError("exploration_share must be in [0, 1]")
        if len(self.discount_steps) != len(self.severity_breakpoints) + 1:
            raise ValueError("discount_steps needs one entry more than severity_breakpoints")

    @property
    def price_floor(self) -> float:
        return max(min(self.price_floor_pct, 1.0), 0.0)

    @property
    def ladder(self) -> tuple[int, ...]:
        """Allowed steps in ascending order; no discount is always one of them."""
        return tuple(sorted({0} | {s for s in self.action_ladder if 0 <= s <= self.max_discount_pct}))
