"""L2 logistic regression of many groups at once, by Newton steps over built-in sums.

One aggregate a step gives the loss, slope and curvature of every group still moving; only these sums (for thirteen weights,
a hundred and six numbers a group) reach the driver, which solves one small system for each. No group waits for another, and
a step is one pass over the rows whatever their number of groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.operators.joins import attach

Key = tuple[str, ...]
_HALVINGS = 40
# Rounding of a sum of losses, relative to it.
_NOISE = 1e-12


@dataclass(frozen=True)
class Logistic:
    """Weights at the optimum. ``slope`` is the largest one left, in units of the curvature's root."""

    coefficients: tuple[float, ...]
    intercept: float
    rows: int
    steps: int
    slope: float


@dataclass
class _Search:
    at: np.ndarray
    trial: np.ndarray
    loss: float = np.inf
    move: np.ndarray | None = None
    steps: int = 0
    halvings: int = 0


def probability(features: Sequence[str], weights: str = "_weights") -> str:
    """SQL: the modelled probability, the intercept being the last weight."""
    terms = " + ".join(f"{name} * {weights}[{i}]" for i, name in enumerate(features))
    return f"1.0D / (1.0D + exp(-({terms} + {weights}[{len(features)}])))"


def add_weights(
    rows: DataFrame, weights: Mapping[Key, Iterable[float]], key: Sequence[str], spread_on: Sequence[str], how: str = "left"
) -> DataFrame:
    """A column ``_weights`` beside the rows, out of a table of one row per group."""
    kinds = ", ".join(f"{name} string" for name in key)
    table = rows.sparkSession.createDataFrame(
        [(*group, [float(w) for w in values]) for group, values in weights.items()],
        f"{kinds}, _weights array<double>",
    )
    return attach(rows, table, key, spread_on, how)


def sums(rows: DataFrame, weights: Mapping[Key, np.ndarray], features: Sequence[str], key, spread_on) -> dict:
    """Per group: rows, loss, slope and curvature of the unpenalized loss at the given weights."""
    known = add_weights(rows, weights, key, spread_on, "inner")
    terms = " + ".join(f"{name} * _weights[{i}]" for i, name in enumerate(features))
    scored = known.selectExpr(*key, *features, "label", f"{terms} + _weights[{len(features)}] AS _z")
    scored = scored.selectExpr("*", "1.0D / (1.0D + exp(-_z)) AS _p").selectExpr(
        "*", "_p - label AS _error", "_p * (1.0D - _p) AS _spread"
    )
    columns = [*features, None]

    def total(*factors: str | None) -> str:
        return f"sum({' * '.join(f for f in factors if f)})"

    measures = [
        "count(*)",
        "sum(greatest(_z, 0.0D) - label * _z + log1p(exp(-abs(_z))))",
        *[total("_error", a) for a in columns],
        *[total("_spread", a, b) for i, a in enumerate(columns) for b in columns[i:]],
    ]
    found = scored.groupBy(*key).agg(*[F.expr(m).alias(f"_s{i}") for i, m in enumerate(measures)])
    width, upper = len(columns), np.triu_indices(len(columns))
    out = {}
    for row in found.collect():
        group, values = tuple(row[: len(key)]), row[len(key) :]
        curvature = np.zeros((width, width))
        curvature[upper] = values[2 + width :]
        curvature += np.triu(curvature, 1).T
        out[group] = values[0], values[1], np.array(values[2 : 2 + width]), curvature
    return out


def fit(
    rows: DataFrame,
    groups: Iterable[Key],
    features: Sequence[str],
    key: Sequence[str],
    spread_on: Sequence[str],
    c: float,
    most_steps: int,
    tolerance: float,
) -> dict[Key, Logistic]:
    """The minimum of ``c`` times the loss plus half the squared weights, for each group; the intercept is free.

    A step that does not lower the loss is halved. A group is done when no slope exceeds ``tolerance`` in units of the
    root of its curvature; one that is not after ``most_steps`` raises, so no unfinished model is ever used.
    """
    width = len(features) + 1
    penalty = np.append(np.ones(width - 1), 0.0)
    moving = {group: _Search(np.zeros(width), np.zeros(width)) for group in groups}
    done: dict[Key, Logistic] = {}
    while moving:
        found = sums(rows, {g: s.trial for g, s in moving.items()}, features, key, spread_on)
        for group, search in list(moving.items()):
            n, loss, slope, curvature = found[group]
            x = search.trial
            loss = c * loss + 0.5 * float(penalty @ (x * x))
            slope = c * slope + penalty * x
            curvature = c * curvature + np.diag(penalty)
            if loss > search.loss * (1 + _NOISE) + _NOISE:
                search.halvings += 1
                if search.halvings > _HALVINGS:
                    raise RuntimeError(f"the model of {group} did not converge: no step lowers its loss")
                search.trial = search.at + search.move / 2**search.halvings
                continue
            scale = 1.0 / np.sqrt(np.maximum(np.diag(curvature), np.finfo(float).tiny))
            left = float(np.abs(slope * scale).max())
            if left <= tolerance:
                done[group] = Logistic(tuple(x[:-1].tolist()), float(x[-1]), n, search.steps, left)
                del moving[group]
                continue
            if search.steps >= most_steps:
                raise RuntimeError(f"the model of {group} did not converge in {most_steps} steps")
            move = -scale * np.linalg.lstsq(curvature * np.outer(scale, scale), slope * scale, rcond=None)[0]
            moving[group] = _Search(x, x + move, loss, move, search.steps + 1)
    return done
